"""Line deduplication: repeated runs of lines leave the texts, except where they first stand.

A text's lines are split at ``\\n``; lines without words take no part. A rolling hash
over the hashes of two neighbouring lines chooses boundaries: a chunk ends between them where
it is 0 modulo ``MODULUS``. So boundaries hang on the lines beside them alone, and equal
passages are cut alike wherever they stand. A chunk of two lines or more that occurs again
anywhere leaves, but for its first occurrence (least doc_id, first place in it).

What boundaries cut off is found by splitting: chunks that stay (those that
occur once, and first occurrences) fall into their pairs of neighbouring lines, and so do the places where
a boundary lies; pairs that an earlier document has, or the same one earlier without
overlap, leave as well. A chunk that left is never split, so large groups of copies cost one hash and
one comparison for each chunk. In sum a line goes if and only if it stands in a run of two or more lines with words that
stands earlier; the first place of each line that is in a removed run always stays.
Chunks and pairs are equal only if their bytes are, blank lines between included.

A table of line hashes is written once; chunks and pairs are counted from it, and only hashes
are shuffled for that. Hashes that occur again go into a bitmap of fixed
size (``BITMAP_BITS``), which is broadcast: the next pass ships bytes just for
what has its bit set, and groups by the bytes themselves, with partial counts
on the map side, so a chunk that is in a third of all rows arrives as one row per
task. Decisions go back to the rows by a join on doc_id and the text's hash.

Defined cases: null text stays null; rows that share a doc_id are one document
for the choice of the first occurrence, and each keeps its own first; a null
doc_id comes after all others, as the id 2^63 - 1 does; single lines are never removed; blank lines before
and after a removed run stay, unless no line with words is left in the text; a
text of any length is read whole; an empty table gives no row; other columns are
handed on unread, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bit_of, bitmap, fresh_names, written
from .text import slices, texts

_LAST = 2**63 - 1
_MASK = 2**64 - 1
_PRIME = 0x9E3779B97F4A7C15
MODULUS = 4


def _mixed(h: int) -> int:
    h = ((h ^ h >> 29) * 0xBF58476D1CE4E5B9) & _MASK
    return h ^ h >> 32


def line_hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line, seed=7)


def chunks(hashes: list[int]) -> list[tuple[int, int]]:
    """Ranges of lines between boundaries, which the rolling hash over each two lines' hashes chooses."""
    out, start = [], 0
    for i in range(1, len(hashes)):
        if _mixed((hashes[i - 1] * _PRIME + hashes[i]) & _MASK) % MODULUS == 0:
            out.append((start, i))
            start = i
    return [*out, (start, len(hashes))] if hashes else out


def pairs(hashes: list[int], gone: set[int]) -> Iterator[int]:
    """First lines of the pairs at boundaries, and of those inside chunks but the ``gone`` ones (numbers among the chunks)."""
    for number, (a, b) in enumerate(chunks(hashes)):
        if number not in gone:
            yield from range(a, b - 1)
        if b < len(hashes):
            yield b - 1


def _joint(hashes: list[int], a: int, b: int) -> int:
    """The hash of the lines from a to b, as a long."""
    h = 0
    for x in hashes[a:b]:
        h = (h * _PRIME + x) & _MASK
    return _mixed(h) - 2**63


def _worded(text: bytes) -> tuple[list[bytes], list[int], list[int]]:
    """A text's lines, the places of those with words, and their hashes."""
    if b"\n" not in text:
        return [text], [], []
    lines = text.split(b"\n")
    at = [i for i, x in enumerate(lines) if x.strip()]
    return lines, at, [line_hash(lines[i]) for i in at]


def _gone(ranges, lines: list[bytes], at: list[int]) -> np.ndarray:
    """Which lines go with these ranges of lines with words."""
    drop = np.zeros(len(lines), bool)
    for a, b in ranges:
        drop[at[a] : at[b - 1] + 1] = True
    return drop if any(x.strip() for x, d in zip(lines, drop, strict=True) if not d) else np.ones(len(lines), bool)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(docs["text"]).alias("version"), docs["text"].alias("text"))


def _line_hashes(keyed: DataFrame) -> DataFrame:
    """(doc, version, hashes) of the texts with two lines with words or more."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = [(d, v, h) for d, v, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts(part.column(2)), strict=True) if len(h := _worded(t)[2]) > 1]
                flat = np.array([x for _, _, h in rows for x in h], np.uint64).view(np.int64)
                offsets = np.cumsum([0, *(len(h) for _, _, h in rows)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc", "version", "hashes"])

    return keyed.mapInArrow(run, "doc long, version long, hashes array<long>")


def _pieces(hashes: list[int], gone: list[int] | None) -> Iterator[tuple[int, int, int]]:
    """Number, first and last line (exclusive) of each multi-line chunk; of each pair that is left to compare, where chunks are gone (even none)."""
    if gone is None:
        yield from ((number, a, b) for number, (a, b) in enumerate(chunks(hashes)) if b - a > 1)
    else:
        yield from ((i, i, i + 2) for i in pairs(hashes, set(gone)))


def _again(table: DataFrame, split: bool) -> DataFrame:
    """Hashes ``h`` of chunks, or of the pairs left by (doc, version, hashes, gone), that occur twice or more."""

    def run(batches):
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                hashes = [x & _MASK for x in batch.column("hashes")[row].as_py()]
                gone = (batch.column("gone")[row].as_py() or []) if split else None
                found += [_joint(hashes, a, b) for _, a, b in _pieces(hashes, gone)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["h"])

    return table.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _candidates(keyed: DataFrame, shared, split: bool, with_bytes: bool) -> DataFrame:
    """Chunks, or all pairs, whose bit is set: (h, doc, piece) or (h, digest, doc, version, number, start, stop, again)."""

    def run(batches):
        bits = memoryview(shared.value.tobytes())
        for batch in batches:
            for part in slices(batch):
                rows = []
                for d, v, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts(part.column(2)), strict=True):
                    lines, at, hashes = _worded(t)
                    seen = {}
                    for number, a, b in ((i, i, i + 2) for i in range(len(hashes) - 1)) if split else _pieces(hashes, None):
                        h = _joint(hashes, a, b)
                        bit = bit_of(h)
                        if bits[bit >> 3] >> (7 - (bit & 7)) & 1:
                            piece = b"\n".join(lines[at[a] : at[b - 1] + 1])
                            if with_bytes:
                                rows.append((h, d, piece))
                            else:
                                digest = hashlib.sha256(piece).digest()
                                rows.append((h, digest, d, v, number, a, b, a >= seen.setdefault(digest, b)))
                kinds = [pa.int64(), pa.int64(), pa.binary()] if with_bytes else [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
                names = ["h", "doc", "piece"] if with_bytes else ["h", "digest", "doc", "version", "number", "start", "stop", "again"]
                columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "h long, doc long, piece binary" if with_bytes else "h long, digest binary, doc long, version long, number int, start int, stop int, again boolean"
    return keyed.mapInArrow(run, schema)


def _repeats(keyed: DataFrame, table: DataFrame, split: bool) -> DataFrame:
    """Places (doc, version, number, start, stop) of the chunks, or of the pairs, that stand earlier, compared by bytes."""
    shared = keyed.sparkSession.sparkContext.broadcast(bitmap(_again(table, split)))
    same = _candidates(keyed, shared, split, True).groupBy("h", "piece").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    firsts = same.select("h", F.unhex(F.sha2("piece", 256)).alias("digest"), "first")
    found = _candidates(keyed, shared, split, False).join(firsts, ["h", "digest"]).where((F.col("doc") != F.col("first")) | F.col("again"))
    return found.select("doc", "version", "number", "start", "stop")


def _removed(keyed: DataFrame) -> DataFrame:
    """(doc, version, removed): the ranges of lines with words that go; of chunks first, then of pairs where chunks stay."""
    hashes = written(_line_hashes(keyed), "lines-hashes")
    whole = written(_repeats(keyed, hashes, False), "lines-chunks")
    gone = whole.groupBy("doc", "version").agg(F.collect_set("number").alias("gone"))
    rest = _repeats(keyed, hashes.join(gone, ["doc", "version"], "left"), True)
    return whole.union(rest).groupBy("doc", "version").agg(F.collect_set(F.struct("start", "stop")).alias("removed"))


def _without(text: pa.Array, removed: pa.Array) -> pa.Array:
    out, n_lines, n_removed = [], [], []
    for t, gone in zip(text.to_pylist(), removed.to_pylist(), strict=True):
        lines, at, _ = _worded((t or "").encode()) if gone else ((t or "").encode().split(b"\n"), [], [])
        n_lines.append(len(lines) if t else 0)
        drop = _gone([(r["start"], r["stop"]) for r in gone], lines, at) if gone else np.zeros(len(lines), bool)
        n_removed.append(int(drop.sum()))
        out.append(b"\n".join(x for x, d in zip(lines, drop, strict=True) if not d).decode() if drop.any() else t)
    return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], ["text", "n_lines", "n_removed"])


def without_repeats(docs: DataFrame, name: str = "_lines") -> DataFrame:
    """All rows and columns of ``docs``, repeated chunks taken out of ``text``, and the column ``name`` = (n_lines, n_removed)."""
    gone = _removed(_keyed(docs))
    columns = docs.columns
    left = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(docs["text"]).alias("version"))
    done = left.join(gone, ["doc", "version"], "left").select("row", F.arrow_udf(_without, "struct<text:string,n_lines:long,n_removed:long>")(F.col("row.text"), F.col("removed")).alias("_lines"))
    return done.select(*[F.col("_lines.text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in columns], F.struct(F.col("_lines.n_lines"), F.col("_lines.n_removed")).alias(name))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, lines before, lines removed and the remaining text of every document."""
    done = without_repeats(docs.select("doc_id", "text"))
    return done.select("doc_id", F.col("_lines.n_lines").alias("n_lines"), F.col("_lines.n_removed").alias("n_removed"), "text")


def dedup_stage(docs: DataFrame) -> DataFrame:
    """Documents without repeated chunks, columns of any name as they came; one that lost all its words goes.

    Null and empty texts have no chunk and stay; ``n_chars``, where there is one, follows the text.
    """
    (name,) = fresh_names(docs, "lines")
    done = without_repeats(docs, name)
    kept = done.where((F.col(name)["n_removed"] == 0) | F.col("text").rlike("[^ \\t-\\r]"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)
