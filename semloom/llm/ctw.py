"""Language-model scoring by context-tree weighting over bytes.

A text is its bytes, A-Z lower-cased, between begin and end marks (0xFF, which
UTF-8 never has). Each byte is eight binary decisions; the node of a decision is
the context of the last d bytes (d from 0 to ``DEPTH``) with the bits so far. Each
node has Krichevsky-Trofimov counts, and context-tree weighting mixes the nodes'
estimates over all depths; a context never seen leaves the choice to the longest
one that was. The result is a code length for each byte: score / n_bytes.

Training counts all training texts: tasks count distinct (DEPTH + 1)-grams and
words in bounded memory and emit partial counts, which one shuffle adds up. A
gram's key has its context first, the last byte foremost, so the nodes of a
subtree share a prefix. The block probability of a node depends on its counts
alone, so the weights follow bottom-up from the summed counts.

No node is left out, and no task holds them all:

1. Shards go by the last three context bytes; a shard weighs its nodes of depth 3
   and more, and passes sums on to the nodes of depths 0 to 2. Those (fewer than
   2^24 whatever the input) are weighed on the driver and broadcast.
2. Texts are cut into blocks of ``BLOCK_BYTES`` where they are read and written to
   the shared folder, together with each block's distinct grams and words, by
   shard: what the block asks for.
3. Each shard meets its counts and all blocks' questions in one sorted stream,
   weighs its nodes once, and answers with a value for each gram: the log
   probability of its last byte after the others. Shards of words answer with counts.
4. Answers and texts meet again by block, and each text's values are summed.

So what the model gathers grows with the corpus, and a task holds one shard or one
block's answers. The base is an add-one unigram model of words by the same counts.

Defined cases: null text is empty (its end token alone); a null doc_id is not held
out and trains; repeated rows each train and each get their row; without training
rows every bit has probability one half; a text of any length is counted and
scored whole (one longer than a block is a block of its own); an empty table gives
no row; ties don't arise; other columns of ``docs`` are not read, whatever their
names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .text import LOWER, mix, raw, release, signed, slices, word_hashes, words

DEPTH = 5
#: Depth from which on nodes belong to one shard; the nodes above are broadcast.
SHARED_DEPTH = 3
#: Bytes of text whose distinct grams and words are asked for together.
BLOCK_BYTES = 32 << 20
#: Distinct grams or words of a shard, on average.
SHARD_KEYS = 250_000
MERGE_AT = 3_000_000
_END = np.uint64(0x5DEECE66D)  # stands for the end token among the word hashes
_WORD, _GRAM = 0, 1
_STEP = 1 << 19
_U = np.uint64


def held_out(doc_id: "F.Column") -> "F.Column":
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def stream(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all rows in order, and the rows' offsets in them (a row has its bytes and the end).

    A gram is its context from the last byte back, then its own byte.
    """
    size = np.diff(offs)
    end = np.cumsum(size + DEPTH + 1)  # a row is DEPTH begin marks, its bytes and the end mark
    total = int(end[-1]) if len(end) else 0
    marks = (end - size - DEPTH - 1)[:, None] + np.arange(DEPTH)
    own = np.ones(total, bool)
    own[marks] = False
    own[end - 1] = False
    out = np.full(total, 0xFF, np.uint8)
    out[own] = LOWER[buf]
    own[end - 1] = True
    two = out[:-1].astype(np.uint16)
    two |= out[1:].astype(np.uint16) << np.uint16(8)
    n = max(0, total - DEPTH)
    g = out[DEPTH:].astype(np.uint64)
    for j in range(0, DEPTH, 2):  # DEPTH is odd: a context is pairs of bytes and the nearest one
        part = (two[j : j + n] if j < DEPTH - 1 else out[j : j + n]).astype(np.uint64)
        part <<= _U(8 * (j + 1))
        g |= part
    del two
    return g[own[DEPTH:]], np.append(0, np.cumsum(size + 1))


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys; the given array is sorted in its place."""
    keys.sort()
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n): words and grams of the training texts."""

    def run(batches):
        held: dict[int, list] = {_WORD: [], _GRAM: []}
        size = {_WORD: 0, _GRAM: 0}

        def merge(kind):
            keys, n = summed(np.concatenate([x[0] for x in held[kind]]), np.concatenate([x[1] for x in held[kind]]))
            held[kind], size[kind] = [(keys, n)], len(keys)
            return keys, n

        def rows(kind):
            if held[kind]:
                keys, n = merge(kind)
                held[kind], size[kind] = [], 0
                for i in range(0, len(keys), 500_000):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[i : i + 500_000]), kind, np.int32)), pa.array(signed(keys[i : i + 500_000])), pa.array(n[i : i + 500_000])], ["kind", "key", "n"])

        for batch in batches:
            for part in slices(batch):
                buf, offs = raw(part.column(0))
                starts, ends, _ = words(buf, offs)
                found = word_hashes(buf, starts, ends)
                held[_WORD].append(np.unique(np.append(found, np.full(part.num_rows, _END)), return_counts=True))
                held[_GRAM].append(np.unique(stream(buf, offs)[0], return_counts=True))
                for kind in (_WORD, _GRAM):
                    size[kind] += len(held[kind][-1][0])
                    if size[kind] > MERGE_AT:
                        merge(kind)
                        if size[kind] > MERGE_AT // 2:
                            yield from rows(kind)
        for kind in (_WORD, _GRAM):
            yield from rows(kind)

    got = docs.where(~held_out(docs["doc_id"])).select(docs["text"]).mapInArrow(run, "kind int, key long, n long")
    return got.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, shifted by 8."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the block probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - 1.1447298858494002


def shorter(keys: np.ndarray) -> np.ndarray:
    """Keys of grams or nodes without their context's farthest byte."""
    return ((keys >> _U(16)) << _U(8)) | (keys & _U(0xFF))


def at_depth(grams: np.ndarray, depth: int) -> np.ndarray:
    """Grams with the last ``depth`` bytes of their context."""
    return ((grams >> _U(8 * (DEPTH + 1 - depth))) << _U(8)) | (grams & _U(0xFF))


def level_nodes(keys: np.ndarray, n: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of one bit's decisions: keys (context and bits so far), zeros, ones."""
    byte = keys & _U(0xFF)
    node = (keys & ~_U(0xFF)) | _U(1 << bit) | (byte >> _U(8 - bit))
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    one = np.add.reduceat(n * ((byte >> _U(7 - bit)) & _U(1)).astype(np.int64), first)
    return node[first], np.add.reduceat(n, first) - one, one


Level = tuple[np.ndarray, np.ndarray, np.ndarray]  # of nodes: sorted keys, probability of a one, weight of stopping


def weighed(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, kids: np.ndarray | None) -> tuple[Level, np.ndarray]:
    """A level of nodes, and the logs of their weighted block probabilities; ``kids`` has their children's (none: leaves)."""
    own = log_kt(zeros.astype(float), ones.astype(float))
    p = (ones + 0.5) / (zeros + ones + 1)
    if kids is None:
        return (node, p, np.ones(len(node))), own
    return (node, p, 1 / (1 + np.exp(np.clip(kids - own, -700, 700)))), np.logaddexp(own, kids) - np.log(2)


def subtrees(keys: np.ndarray, n: np.ndarray) -> tuple[list[list[Level]], tuple[np.ndarray, ...]]:
    """From a shard's grams and counts: for each bit the levels from depth ``DEPTH`` up to ``SHARED_DEPTH``,
    and for the nodes just above: their keys, zeros, ones and children's logs, as far as this shard knows."""
    by_depth = [(keys, n)]
    for _ in range(DEPTH - SHARED_DEPTH):
        by_depth.append(summed(shorter(by_depth[-1][0]), by_depth[-1][1]))
    levels, above = [], []
    for bit in range(8):
        of_bit, log_pw, below = [], None, None
        for counted in by_depth:
            node, zeros, ones = level_nodes(*counted, bit)
            kids = None if below is None else np.bincount(np.searchsorted(node, shorter(below)), log_pw, len(node))
            level, log_pw = weighed(node, zeros, ones, kids)
            of_bit.append(level)
            below = node
        levels.append(of_bit)
        up, back = np.unique(shorter(below), return_inverse=True)
        above.append((up, *(np.bincount(back, x, len(up)) for x in (zeros, ones, log_pw))))
    return levels, tuple(np.concatenate(x) for x in zip(*above, strict=True))


def top_levels(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, kids: np.ndarray) -> list[Level]:
    """The levels of depth 2, 1 and 0 from the sums for depth 2."""
    out = []
    order = np.argsort(node)
    node, zeros, ones, kids = (x[order] for x in (node, zeros, ones, kids))
    for depth in range(SHARED_DEPTH - 1, -1, -1):
        level, log_pw = weighed(node, zeros, ones, kids)
        out.append(level)
        if depth:
            node, back = np.unique(shorter(node), return_inverse=True)
            zeros, ones, kids = (np.bincount(back, x, len(node)) for x in (zeros, ones, log_pw))
    return out


def log10_values(grams: np.ndarray, levels: list[list[Level]], top: list[Level]) -> np.ndarray:
    """Log10 probability of each gram's last byte after the others; ``levels`` of its shard."""
    total = np.zeros(len(grams))
    byte = grams & _U(0xFF)
    for bit in range(8):
        step = _U(1 << bit) | (byte >> _U(8 - bit))
        p, seen = np.full(len(grams), 0.5), np.zeros(len(grams), bool)
        for depth, (keys, own, stop) in zip(range(DEPTH, -1, -1), [*levels[bit], *top] if levels else [(np.zeros(0, np.uint64),) * 3] * (DEPTH + 1 - SHARED_DEPTH) + top, strict=True):
            if not len(keys):
                continue
            node = (at_depth(grams, depth) & ~_U(0xFF)) | step
            at = np.minimum(np.searchsorted(keys, node), len(keys) - 1)
            here = keys[at] == node
            p = np.where(here, np.where(seen, stop[at] * own[at] + (1 - stop[at]) * p, own[at]), p)
            seen |= here
        one = (byte >> _U(7 - bit)) & _U(1) == 1
        total += np.log10(np.where(one, p, 1 - p))
    return total


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys in few bytes: their differences, byte by byte of equal weight."""
    step = np.diff(keys, prepend=_U(0)).astype("<u8")
    width = max(1, (int(step.max()).bit_length() + 7) // 8) if len(step) else 1
    return zlib.compress(bytes([width]) + step.view(np.uint8).reshape(-1, 8).T[:width].tobytes(), 1)


def unpack_keys(data: bytes) -> np.ndarray:
    data = zlib.decompress(data)
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    step = np.zeros((planes.shape[1], 8), np.uint8)
    step[:, : data[0]] = planes.T
    return np.cumsum(step.reshape(-1).view("<u8")).astype(np.uint64)


class Lookup:
    """Places of keys among distinct ones, by an open table at most half full."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.table = np.full((1 << self.bits) + 1, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            lost = self.table[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """Each one's place; a key that isn't there is an error."""
        slot = self._slot(wanted)
        out = self.table[slot]
        left = np.flatnonzero(self.keys[out] != wanted) if len(self.keys) else np.arange(len(wanted))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            out[left] = self.table[slot[left]]
            if (out[left] < 0).any():
                raise LookupError("a block asks for a key without an answer")
            left = left[self.keys[out[left]] != wanted[left]]
        return out


def shard_of(kind: int, keys: np.ndarray, shards: tuple[int, int]) -> np.ndarray:
    """Shards of words come first, then those of grams, which go by the last three context bytes."""
    h = mix(keys) if kind == _WORD else mix(keys >> _U(8 * (DEPTH + 1 - SHARED_DEPTH)))
    return ((h >> _U(1)).astype(np.int64) % shards[kind] + (shards[0] if kind == _GRAM else 0)).astype(np.int32)


def _counted_by_shard(counted: DataFrame, shards: tuple[int, int]) -> DataFrame:
    def run(batches):
        for batch in batches:
            kind, key = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            shard = np.where(kind == _WORD, shard_of(_WORD, key, shards), shard_of(_GRAM, key, shards))
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), batch.column(1), batch.column(2)], ["shard", "key", "n"])

    return counted.where(F.col("kind") >= 0).select("kind", "key", "n").mapInArrow(run, "shard int, key long, n long")


def _top(counted: DataFrame, shards: tuple[int, int]) -> list[Level]:
    """The levels above the shards: sums of all shards for depth ``SHARED_DEPTH`` - 1, weighed up to the root."""

    def weigh(batches):
        def done():
            _, above = subtrees(*summed(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])))
            return pa.RecordBatch.from_arrays([pa.array(above[0].astype(np.int32)), *(pa.array(x) for x in above[1:])], ["node", "zeros", "ones", "kids"])

        now, held = None, []
        for batch in batches:
            shard = batch.column(0).to_numpy()
            edge = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
            for a, b in zip(edge, [*edge[1:], len(shard)], strict=True):
                if shard[a] != now:
                    if held:
                        yield done()
                    now, held = shard[a], []
                held.append((batch.column(1).to_numpy()[a:b].view(np.uint64), batch.column(2).to_numpy()[a:b]))
        if held:
            yield done()

    grams = _counted_by_shard(counted.where(F.col("kind") == _GRAM), shards)
    parts = grams.repartitionById(shards[1], F.col("shard") - shards[0]).sortWithinPartitions("shard").mapInArrow(weigh, "node int, zeros double, ones double, kids double")
    got = parts.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("kids").alias("kids")).toArrow()
    return top_levels(got["node"].to_numpy().astype(np.uint64), *(got[c].to_numpy() for c in ("zeros", "ones", "kids")))


def _in_blocks(docs: DataFrame, shards: tuple[int, int]) -> DataFrame:
    """Texts (block, doc_id, text) and what each block asks for (block, shard, keys)."""
    names = ["block", "doc_id", "text", "shard", "keys"]

    def run(batches):
        block, size = TaskContext.get().partitionId() << 32, 0
        held: dict[int, list[np.ndarray]] = {_WORD: [], _GRAM: []}

        def questions():
            shard, keys = [], []
            for kind in (_WORD, _GRAM):
                asked = distinct(np.concatenate(held[kind]))
                of = shard_of(kind, asked, shards)
                order = np.argsort(of, kind="stable")
                found, first = np.unique(of[order], return_index=True)
                for s, part in zip(found.tolist(), np.split(asked[order], first[1:]), strict=True):
                    shard.append(s)
                    keys.append(pack_keys(part))
            n = len(shard)
            return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array(shard, pa.int32()), pa.array(keys, pa.binary())], names)

        for batch in batches:
            for part in slices(batch):
                buf, offs = raw(part.column(1))
                if size and size + len(buf) > BLOCK_BYTES:
                    yield questions()
                    block, size, held = block + 1, 0, {_WORD: [], _GRAM: []}
                size += len(buf) + part.num_rows
                starts, ends, _ = words(buf, offs)
                for kind in (_WORD, _GRAM):
                    held[kind].append(distinct(np.append(word_hashes(buf, starts, ends), _END) if kind == _WORD else stream(buf, offs)[0]))
                    if sum(map(len, held[kind])) > MERGE_AT:
                        held[kind] = [distinct(np.concatenate(held[kind]))]
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), part.column(0), part.column(1), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if held[_GRAM]:
            yield questions()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, "block long, doc_id long, text string, shard int, keys binary")


class Shard:
    """One shard's counts; it answers for words with counts and for grams with log10 probabilities, each worked out once."""

    def __init__(self, kind: int, keys: np.ndarray, n: np.ndarray, top: list[Level]):
        self.kind, self.top = kind, top
        if kind == _WORD:
            order = np.argsort(keys)
            self.keys, self.values = keys[order], n[order].astype("<u8")
        else:
            self.levels = subtrees(*summed(keys, n))[0] if len(keys) else []
            self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, "<f4")

    def __call__(self, wanted: np.ndarray) -> bytes:
        at = np.searchsorted(self.keys, wanted)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == wanted if len(self.keys) else np.zeros(len(wanted), bool)
        if not known.all() and self.kind == _GRAM:
            new = wanted[~known]
            self.values = np.insert(self.values, at[~known], log10_values(new, self.levels, self.top).astype("<f4"))
            self.keys = np.insert(self.keys, at[~known], new)
            at, known = np.searchsorted(self.keys, wanted), np.ones(len(wanted), bool)
        out = np.zeros(len(wanted), self.values.dtype)
        out[known] = self.values[at[known]]
        return out.tobytes()


def _answers(counted: DataFrame, asked: DataFrame, shards: tuple[int, int], top) -> DataFrame:
    """(block, shard, keys, found): the blocks' questions with their answers."""

    def run(batches):
        now, held, shard = None, [], None

        def ready() -> Shard:
            none = [np.zeros(0, np.int64)]
            return Shard(int(now >= shards[0]), np.concatenate([x[0] for x in held] or none).view(np.uint64), np.concatenate([x[1] for x in held] or none), top.value)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            edge = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            out = []
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(ids)], strict=True):
                if ids[a] != now:
                    now, held, shard = int(ids[a]), [], None
                part = batch.slice(a, b - a)
                counts_here = part.column(1).null_count
                if counts_here:  # they come first
                    held.append((part.column(2).slice(0, counts_here).to_numpy(), part.column(3).slice(0, counts_here).to_numpy()))
                if counts_here < part.num_rows:
                    shard = shard or ready()
                    held = []
                    for block, keys in zip(part.column(1).slice(counts_here).to_pylist(), part.column(4).slice(counts_here).to_pylist(), strict=True):
                        out.append((block, now, keys, shard(unpack_keys(keys))))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["block", "shard", "keys", "found"])
        release()

    train = _counted_by_shard(counted, shards).select("shard", F.lit(None).cast("long").alias("block"), "key", "n", F.lit(None).cast("binary").alias("keys"))
    both = train.unionByName(asked.select("shard", "block", F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("n"), "keys"))
    met = both.repartitionById(sum(shards), F.col("shard")).sortWithinPartitions("shard", F.col("block").asc_nulls_first())
    return met.mapInArrow(run, "block long, shard int, keys binary, found binary")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_bytes of every document."""
    spark = docs.sparkSession
    counted = written(counts(docs), "counts")
    size = {r["kind"]: r for r in counted.groupBy("kind").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n")).collect()}
    shards = tuple(1 + (size[k]["keys"] if k in size else 0) // SHARD_KEYS for k in (_WORD, _GRAM))
    tokens, kinds = (size[_WORD]["n"], size[_WORD]["keys"]) if _WORD in size else (0, 0)
    top = spark.sparkContext.broadcast(_top(counted, shards))
    cut = written(_in_blocks(docs, shards), "blocks")
    blocks = cut.agg(F.countDistinct("block")).first()[0]
    answers = _answers(counted, cut.where("shard is not null").select("block", "shard", "keys"), shards, top)
    per_token = float(np.log10(tokens + kinds + 1))

    def run(batches):
        now, answered, ready = None, [], None

        def tables():
            out = []
            for kind, form in ((_WORD, "<u8"), (_GRAM, "<f4")):
                mine = [x for x in answered if (x[0] >= shards[0]) == kind]
                keys = [unpack_keys(x[1]) for x in mine] or [np.zeros(0, np.uint64)]
                found = np.frombuffer(b"".join(x[2] for x in mine), form).astype(float)
                out.append((Lookup(np.concatenate(keys)), found))
            return out

        for batch in batches:
            ids = batch.column(0).to_numpy()
            edge = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(ids)], strict=True):
                if ids[a] != now:
                    now, answered, ready = int(ids[a]), [], None
                group = batch.slice(a, b - a)
                first = group.num_rows - group.column(1).null_count
                answered += zip(*(group.column(i).slice(0, first).to_pylist() for i in (1, 2, 3)), strict=True)
                for part in slices(group.slice(first), "text"):
                    if ready is None:
                        ready, answered = tables(), []
                    (word_at, times), (gram_at, value) = ready
                    buf, offs = raw(part.column(5))
                    grams, at = stream(buf, offs)
                    upto = np.zeros(len(grams) + 1)
                    for i in range(0, len(grams), _STEP):
                        upto[i + 1 : i + 1 + _STEP] = value[gram_at(grams[i : i + _STEP])]
                    np.cumsum(upto, out=upto)
                    del grams
                    starts, ends, row = words(buf, offs)
                    n = part.num_rows
                    c = times[word_at(np.append(word_hashes(buf, starts, ends), np.full(n, _END)))]
                    row = np.append(row, np.arange(n))
                    n_tokens = np.bincount(row, minlength=n)
                    base = np.bincount(row, np.log10(c + 1), n) - n_tokens * per_token
                    columns = [n_tokens, np.bincount(row[c > 0], minlength=n), base, upto[at[1:]] - upto[at[:-1]], np.diff(offs)]
                    yield pa.RecordBatch.from_arrays([part.column(4), *(pa.array(x) for x in columns)], ["doc_id", "n_tokens", "n_known", "base_score", "score", "n_bytes"])

    told = answers.select("block", "shard", "keys", "found", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    none = F.lit(None)
    texts = cut.where("shard is null").select("block", none.cast("int").alias("shard"), none.cast("binary").alias("keys"), none.cast("binary").alias("found"), "doc_id", "text")
    met = told.unionByName(texts).repartition(max(1, blocks), "block").sortWithinPartitions("block", F.col("shard").asc_nulls_last())
    done = met.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes")
