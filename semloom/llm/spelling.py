"""Spelling variants: words one edit apart, found by merging subtrees of a trie with an error.

Two different words one insertion, deletion or replacement apart part at exactly one
node of the vocabulary's trie, that of their longest common prefix ``p``: they are
``p a s`` and ``p b s`` (replaced), or ``p a s`` and ``p s`` (skipped). So at each
node the words of the light children, without their next character, are merged
into an errata trie; where its ends coincide, with each other or with ends under the heavy
child, one character is replaced; with ends under the node itself, one is skipped; and
the light children are laid over the heavy child for words that skip the heavy character.
The heavy child (most words) is never copied, so a word is merged at no more nodes
than the logarithm of the words, the small ones into the large ones. Each pair comes out once.

At scale a trie is cut by counts. Nodes with more than ``LIMIT`` words are merged by a
shuffle: words under a node that branches meet by what is left without the character at its
depth. The subtrees below, of at most ``LIMIT`` words, are dealt out over the tasks and
merged there. A prefix that a third of all words share is therefore cut as deep as need be,
and no task holds more than one subtree; counts of words are combined before the shuffle.

Defined cases: a null text has no words; a null doc_id counts as an empty one; repeated rows count
each; ties between near words go to the smallest in code-point order; words may be of any length;
an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, written

LETTERS = "a-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LIMIT = 8192
#: Large nodes (16 bytes each) up to which every task gets all of them.
LARGE_NODES = 1 << 20
MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
NOISE = 31


class Node:
    """A node of the trie with two words or more under it; a subtree of one word is just its number."""

    __slots__ = ("end", "kids", "size")

    def __init__(self, size: int):
        self.kids, self.end, self.size = {}, -1, size


def trie(words: list[str], skip: int) -> Node | int:
    """The trie of sorted, distinct words, from their character ``skip`` on."""
    if len(words) == 1:
        return 0
    root = Node(len(words))
    todo = [(root, 0, len(words), skip)]
    while todo:
        node, lo, hi, depth = todo.pop()
        if len(words[lo]) == depth:
            node.end = lo
            lo += 1
        while lo < hi:
            c, at = words[lo][depth], lo + 1
            while at < hi and words[at][depth] == c:
                at += 1
            if at - lo == 1:
                node.kids[c] = lo
            else:
                kid = node.kids[c] = Node(at - lo)
                todo.append((kid, lo, at, depth + 1))
            lo = at
    return root


def _find(words: list[str], tree: Node | int, depth: int, rest: str) -> int:
    """The word under ``tree`` whose characters from ``depth`` on are ``rest``, or -1."""
    at = 0
    while type(tree) is not int:
        if at == len(rest):
            return tree.end
        tree = tree.kids.get(rest[at], -1)
        at += 1
    return tree if tree >= 0 and words[tree][depth + at :] == rest[at:] else -1


class Errata:
    """A trie of words that each lost one character; a branch of one ending is kept as (rest, words)."""

    def __init__(self):
        self.root = {}

    def add(self, rest: str, word: int) -> list[int]:
        """Merge one more ending; the words that already end there."""
        node = self.root
        for i, c in enumerate(rest):
            kid = node.get(c)
            if kid is None:
                node[c] = (rest[i + 1 :], [word])
                return []
            if type(kid) is tuple:
                left, same = kid
                if left == rest[i + 1 :]:
                    same.append(word)
                    return same[:-1]
                kid = node[c] = {left[0]: (left[1:], same)} if left else {"": same}
            node = kid
        same = node.setdefault("", [])
        same.append(word)
        return same[:-1]

    def meet(self, words: list[str], tree: Node | int, depth: int) -> Iterator[tuple[list[int], int]]:
        """Ends that coincide with words under ``tree``, whose characters count from ``depth`` on."""
        todo = [(self.root, tree, depth)]
        while todo:
            mine, tree, depth = todo.pop()
            if type(mine) is tuple:
                found = _find(words, tree, depth, mine[0])
                if found >= 0:
                    yield mine[1], found
            elif type(tree) is int:
                rest, at = words[tree], depth
                while type(mine) is dict and at < len(rest):
                    mine = mine.get(rest[at])
                    at += 1
                if type(mine) is dict:
                    mine = ("", mine.get("", []))
                if mine is not None and mine[0] == rest[at:] and mine[1]:
                    yield mine[1], tree
            else:
                if "" in mine and tree.end >= 0:
                    yield mine[""], tree.end
                theirs = tree.kids
                for c in mine if len(mine) < len(theirs) else theirs:
                    if c and c in mine and c in theirs:
                        todo.append((mine[c], theirs[c], depth + 1))


def _meet(words: list[str], a: Node | int, da: int, b: Node | int, db: int) -> Iterator[tuple[int, int]]:
    """Words under two subtrees that end alike."""
    todo = [(a, da, b, db)]
    while todo:
        a, da, b, db = todo.pop()
        if type(a) is int or type(b) is int:
            if type(a) is int:
                found = _find(words, b, db, words[a][da:])
                if found >= 0:
                    yield a, found
            else:
                found = _find(words, a, da, words[b][db:])
                if found >= 0:
                    yield found, b
            continue
        if a.end >= 0 and b.end >= 0:
            yield a.end, b.end
        for c in a.kids if len(a.kids) < len(b.kids) else b.kids:
            if c in a.kids and c in b.kids:
                todo.append((a.kids[c], da + 1, b.kids[c], db + 1))


def _below(tree: Node | int) -> Iterator[int]:
    todo = [tree]
    while todo:
        tree = todo.pop()
        if type(tree) is int:
            yield tree
        else:
            if tree.end >= 0:
                yield tree.end
            todo.extend(tree.kids.values())


def one_edit_pairs(words: list[str], skip: int = 0) -> Iterator[tuple[int, int]]:
    """Pairs of sorted, distinct words exactly one edit apart, once each; all share their first ``skip`` characters."""
    todo = [(trie(words, skip), skip)] if words else []
    while todo:
        node, depth = todo.pop()
        if type(node) is int:
            continue
        kids = node.kids
        heavy = max(kids, key=lambda c: 1 if type(kids[c]) is int else kids[c].size)
        todo.extend((kid, depth + 1) for kid in kids.values())
        if len(kids) == 1 and node.end < 0:
            continue
        errata = Errata()
        for c, kid in kids.items():
            if c != heavy:
                for word in _below(kid):
                    for same in errata.add(words[word][depth + 1 :], word):
                        yield same, word
        if len(kids) > 1:
            for mine, found in errata.meet(words, kids[heavy], depth + 1):
                for word in mine:
                    yield word, found
            for mine, found in errata.meet(words, node, depth):
                for word in mine:
                    if words[found][depth : depth + 1] != words[word][depth]:
                        yield word, found
        large = kids[heavy]
        if node.end >= 0:
            found = _find(words, large, depth + 1, "")
            if found >= 0:
                yield node.end, found
        for c, kid in kids.items():
            if c == heavy:
                continue
            if type(large) is int:
                if words[large][depth + 1 : depth + 2] == c:
                    yield from _meet(words, kid, depth + 1, large, depth + 2)
            elif c in large.kids:
                yield from _meet(words, kid, depth + 1, large.kids[c], depth + 2)


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n) of all texts: maximal runs of letters, where a hash of document and run says so without one of theirs."""
    runs = docs.select(
        F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("doc"),
        F.explode(F.expr(f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[{LETTERS}]{{{min_length},}}', 0)")).alias("run"),
    )
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    lost = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % noise == 0, lost).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _cut(words: DataFrame, limit: int) -> DataFrame:
    """(word, n, depth, skips): the depth of the word's first node of at most ``limit`` words (null: none), and the depths of larger nodes at which its way branches."""
    heads = words.select("word", "n", F.expr("posexplode(transform(sequence(0, length(word)), i -> xxhash64(i, substring(word, 1, i))))").alias("at", "head"))
    large = written(heads.groupBy("head").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > limit), "spelling-large")
    if large.count() <= LARGE_NODES:  # all words share the root, so a join by key would send them to one task
        large = F.broadcast(large)
    ways = heads.join(large, "head").groupBy("word").agg(F.sort_array(F.collect_list(F.struct("at", "size"))).alias("way"))
    depth = F.size("way")
    skips = F.expr("transform(filter(way, x -> x.at < length(word) and (x.at + 1 >= size(way) or x.size > way[x.at + 1].size)), x -> x.at)")
    found = words.join(ways, "word", "left").withColumn("way", F.coalesce("way", F.expr("array()")))
    return found.select("word", "n", F.when(depth <= F.length("word"), depth).alias("depth"), skips.alias("skips"))


def _above(cut: DataFrame) -> DataFrame:
    """Near words that part at a large node: (word, n, near, near_n), one direction of each pair."""
    lost = cut.select("word", "n", F.explode("skips").alias("at")).select(F.expr("concat(substring(word, 1, at), substring(word, at + 2))").alias("rest"), "word", "n", "at")
    whole = cut.where(F.col("depth").isNull() | (F.col("depth") > 0)).select(F.col("word").alias("rest"), "word", "n", F.lit(-1).alias("at"))
    met = lost.union(whole).groupBy("rest").agg(F.collect_list(F.struct("at", "word", "n")).alias("all")).where(F.size("all") > 1)
    two = met.select("all", F.explode("all").alias("x")).select("x", F.explode("all").alias("y"))
    replaced = (F.col("x.at") >= 0) & (F.col("x.at") == F.col("y.at")) & (F.col("x.word") < F.col("y.word"))
    # a character that the next one repeats is skipped at the last of its run, where the words part
    skipped = (F.col("x.at") >= 0) & (F.col("y.at") == -1) & (F.expr("substring(x.word, x.at + 1, 1)") != F.expr("substring(x.word, x.at + 2, 1)"))
    return two.where(replaced | skipped).select(F.col("x.word").alias("word"), F.col("x.n").alias("n"), F.col("y.word").alias("near"), F.col("y.n").alias("near_n"))


def _inside(cut: DataFrame) -> DataFrame:
    """Near words that part inside a subtree of at most ``limit`` words, one direction of each pair."""

    def merged(head: str, found: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
        found.sort()
        words = [w for w, _ in found]
        rows = []
        for a, b in one_edit_pairs(words, len(head)):
            rows.append((words[a], found[a][1], words[b], found[b][1]))
            if len(rows) == 10_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, found = None, []
        for batch in batches:
            for this, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if this != head:
                    if len(found) > 1:
                        yield from merged(head, found)
                    head, found = this, []
                found.append((word, n))
        if len(found) > 1:
            yield from merged(head, found)

    heads = cut.where(F.col("depth").isNotNull()).select(F.expr("substring(word, 1, depth)").alias("head"), "word", "n")
    return heads.repartition("head").sortWithinPartitions("head").mapInArrow(run, "word string, n long, near string, near_n long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["word", "n", "near", "near_n"])


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """All pairs of words (word, n) one edit apart, in both directions: (word, n, near, near_n)."""
    cut = written(_cut(words, limit), "spelling-cut")
    once = _above(cut).union(_inside(cut))
    turned = F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return once.select(F.explode(F.array(F.struct("word", "n", "near", "near_n"), turned)).alias("pair")).select("pair.*")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) by doubling the steps along (word, form); counts grow tenfold on each step, so it ends."""
    now = written(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        old, now = now, written(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        discard(old)
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, limit: int = LIMIT) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word (word, n)."""
    words = written(words, "spelling-words")
    one = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))))
    all_ = one.union(near_words(words, limit)).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    takes = -F.col("best.less") >= ratio * F.col("n")
    found = written(all_.select("word", "n", "n_near", F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n")), "spelling-forms")
    roots = _roots(found.where(F.col("form").isNotNull()))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    """The spelling variants of all texts."""
    return variants(vocabulary(docs))


ORACLE_SQL = rf"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), runs AS (
  SELECT d, r, count(*) AS times FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[{LETTERS}]{{{MIN_LENGTH},}}')) AS r FROM documents)
  GROUP BY ALL
), bytes AS (
  SELECT d, r, times, hex(encode(d || ':' || r)) AS x FROM runs
), hashed AS (
  SELECT r, times, xor(4294967295, list_reduce([4294967295] || list_transform(range(CAST(length(x) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INT), 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, crc[CAST((xor(c, b) & 255) + 1 AS INT)]))) AS h
  FROM bytes, t
), words AS MATERIALIZED (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT times, CASE WHEN h % {NOISE} = 0 THEN substr(r, 1, CAST(h % length(r) AS INT)) || substr(r, CAST(h % length(r) AS INT) + 2) ELSE r END AS word FROM hashed)
  WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(times) >= {MIN_COUNT}
), lost AS (
  SELECT word, n, i, substr(word, 1, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest FROM words, unnest(range(CAST(length(word) AS BIGINT))) AS u(i)
), once AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM lost a JOIN lost b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM lost a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM lost a JOIN words b ON a.rest = b.word
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM once
), forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= {RATIO} * w.n THEN r.near END AS form, CASE WHEN r.near_n >= {RATIO} * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.place = 1
), steps AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON s.at = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN steps s ON f.word = s.word JOIN forms e ON s.at = e.word WHERE e.form IS NULL
"""
