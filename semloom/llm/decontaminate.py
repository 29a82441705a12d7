"""Benchmark decontamination with an Aho-Corasick automaton.

Every benchmark text is normalised to words and cut into windows of ``window``
words (a shorter text is one window). All windows go into one automaton, and each
document is normalised and scanned once; matches are mapped back to word indexes
and to code-point offsets of the original text. No shuffle: documents are mapped
where they are read.

The automaton is broadcast, so the benchmark's size is measured first. Beyond
``BLOCK_BYTES`` of text it is cut by a hash into blocks of about that size; the
documents then pass through one narrow stage per block, each with its own
automaton, and the hits add up. Only one block is held by a stage at a time.

Defined cases: null, empty or word-less text has 0 words and no hits; a null
``item_id`` counts as an item named ``""``; repeated items count once; repeated
documents each get their row; an empty benchmark hits nothing, an empty table gives no row; texts of any length are
scanned whole; hits in just 5 % of the words contaminate; other columns, whatever their
names, are handed on unread.
"""

from __future__ import annotations

import math
import uuid
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fresh_names
from .text import slices, texts, words

WINDOW = 13
#: Bytes of benchmark text per automaton (13 words of window make about 13 times as many nodes).
BLOCK_BYTES = 1 << 20
#: Bytes that separate words: the contract's class outside 0-9, a-z (after lower-casing A-Z) and non-ASCII.
GAPS = np.array([b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)])
GAPS[65:91] = False
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if GAPS[b] else b for b in range(256))
SPAN = "array<struct<start:long,end:long>>"


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def window_patterns(items: list[tuple[str, bytes]], window: int) -> dict[str, tuple[int, set[str]]]:
    """Pattern to (number of words, ids of the items that have it)."""
    out: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        w = normal_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            out.setdefault(f" {b' '.join(w[i : i + n]).decode('latin-1')} ", (n, set()))[1].add(item)
    return out


@lru_cache(maxsize=1)
def _automaton(key, held) -> ahocorasick.Automaton | None:
    items, window = held.value
    patterns = window_patterns(items, window)
    if not patterns:
        return None
    auto = ahocorasick.Automaton()
    for pattern, (n, ids) in patterns.items():
        auto.add_word(pattern, (n, tuple(ids)))
    auto.make_automaton()
    return auto


class _Held:
    """A broadcast that the cache ignores in its key, so a worker builds each automaton once."""

    def __init__(self, broadcast):
        self.broadcast = broadcast

    def __hash__(self):
        return 0

    def __eq__(self, other):
        return isinstance(other, _Held)

    @property
    def value(self):
        return self.broadcast.value


def scan(auto, w: list[bytes]) -> tuple[np.ndarray, set[str]]:
    """Which words are hit, and the items with occurring windows."""
    hit, items = np.zeros(len(w) + 1, np.int32), set()
    if auto is None or not w:
        return hit[:-1] > 0, items
    text = f" {b' '.join(w).decode('latin-1')} "
    found = list(auto.iter(text))
    if found:
        at = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
        last = np.searchsorted(at, [e for e, _ in found])
        for j, (_, (n, ids)) in zip(last, found, strict=True):
            hit[j - n] += 1
            hit[j] -= 1
            items.update(ids)
    return np.cumsum(hit)[:-1] > 0, items


def char_spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as code-point ranges of the original text."""
    if not hit.any():
        return []
    buf = np.frombuffer(text, np.uint8)
    starts, ends, _ = words(buf, np.array([0, len(buf)]), GAPS)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return [{"start": int(points[starts[a]]), "end": int(points[ends[b - 1]])} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, name: str = "_bench") -> DataFrame:
    """All of ``docs`` with the column ``name`` = (n_words, n_hit, items, spans, hits) added.

    ``items`` are the sorted item ids as strings, ``spans`` the hit code-point
    ranges, ``hits`` the hit ranges in words.
    """
    benchmark = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("item_id"), benchmark["text"].alias("text")).distinct()
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(size / block_bytes))
    columns = docs.columns
    out = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast(SPAN).alias("hits"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    for block in range(n):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block) if n > 1 else benchmark
        items = [(r[0], (r[1] or "").encode()) for r in part.collect()]
        out = _stage(out, docs.sparkSession.sparkContext.broadcast((items, window)), block == n - 1)
    return out.select("row.*", F.struct("n_words", "n_hit", "items", "spans", "hits").alias(name))


def _stage(df: DataFrame, shared, last: bool) -> DataFrame:
    key = uuid.uuid4().hex

    def run(batches):
        auto = _automaton(key, _Held(shared))
        for batch in batches:
            for part in slices(batch):
                n_words, n_hit, items, spans, hits = [], [], [], [], []
                had = zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)
                for text, (old_items, old_hits) in zip(texts(part.column(3)), had, strict=True):
                    w = normal_words(text)
                    hit, found = scan(auto, w)
                    for x in old_hits or ():
                        hit[x["start"] : x["end"]] = True
                    n_words.append(len(w))
                    n_hit.append(int(hit.sum()))
                    items.append(sorted(found.union(old_items or ())))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist() if n_hit[-1] else []
                    hits.append([{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                    spans.append(char_spans(text, hit) if last else [])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                names = ["row", "items", "hits", "text", "n_words", "n_hit", "spans"]
                arrays = [part.column(0), pa.array(items, pa.list_(pa.string())), pa.array(hits, kind), part.column(3), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, kind)]
                if last:
                    arrays[3] = pa.array([""] * part.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = df.select("row", "items", "hits", "text").schema.add("n_words", "long").add("n_hit", "long")
    schema = schema.add("spans", df.schema["hits"].dataType)
    return df.select("row", "items", "hits", "text").mapInArrow(run, schema)


def contaminated(name: str = "_bench") -> "F.Column":
    """The contract's rule on the added column: some hit, and at least 5 % of the words."""
    return (F.col(name)["n_hit"] > 0) & (20 * F.col(name)["n_hit"] >= F.col(name)["n_words"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that the rule leaves, columns of any name as they came; null and empty texts stay, repeated rows each by themselves."""
    (name,) = fresh_names(docs, "bench")
    return find_passages(docs, benchmark, name=name).where(~contaminated(name)).drop(name)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: the counts, and a digest of the items found."""
    found = find_passages(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        F.col("_bench.n_words").alias("n_words"),
        F.col("_bench.n_hit").alias("n_hit"),
        F.size("_bench.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_bench.items"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0
), dw AS (
  SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM d, (SELECT DISTINCT n FROM bw) AS ns, unnest(range(1, len(w) - n + 2)) AS t(i)
), found AS (
  SELECT k, i, dw.n, item FROM dw JOIN bw USING (n, s)
), hit AS (
  SELECT k, count(DISTINCT i + o) AS n_hit FROM found, unnest(range(0, n)) AS t(o) GROUP BY k
), items AS (
  SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY k
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN items USING (k)
"""
