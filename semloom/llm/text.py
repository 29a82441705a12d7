"""Batched text helpers shared by the corpus operators.

Everything works on Arrow batches: the UTF-8 bytes of a whole batch sit in one
numpy buffer with row offsets, so word splitting and hashing are vectorised.
A batch is cut into row slices of at most ``CHUNK_BYTES`` (one row at least), so
the temporary arrays stay bounded whatever the row sizes are.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

CHUNK_BYTES = 2 << 20

#: Word separators of the contracts: space and the characters 0x09 to 0x0D.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MIX = np.random.default_rng(20240607).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_LONG_WORD = 48
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _LIBC = None


def release() -> None:
    """Hand freed memory back to the system: a worker is reused, and its executor counts what it holds."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and its row offsets."""
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(offs) or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def texts(column: pa.Array) -> list[bytes]:
    """The rows of a string column as bytes (null: empty)."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch with at most ``limit`` bytes of text each, or one row.

    Memory that the slices' arrays took goes back to the system after the batch.
    """
    if not batch.num_rows:
        return
    _, offs = raw(batch.column(batch.schema.get_field_index(name)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    release()


def map_text(df: DataFrame, columns: list[str], make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """Narrow ``df`` to ``columns`` and map its text slices with Arrow, without a shuffle.

    ``make`` runs once per task and gives the function from a slice to columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            for part in slices(batch, columns[-1]):
                step = step or make()
                if out := step(part):
                    yield from (pa.RecordBatch.from_pydict(x) for x in (out if isinstance(out, list) else [out]))

    return df.select(*columns).mapInArrow(run, schema)


def words(buf: np.ndarray, offs: np.ndarray, spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never cross a row's end."""
    none = np.zeros(0, np.int64)
    if not len(buf):
        return none, none, none
    gap = spaces[buf]
    before = np.empty(len(buf), bool)
    before[0], before[1:] = True, gap[:-1]
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = True, gap[1:]
    full = offs[:-1][offs[1:] > offs[:-1]]
    before[full] = True
    after[full[full > 0] - 1] = True
    starts = np.flatnonzero(before & ~gap)
    ends = np.flatnonzero(after & ~gap) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z lower-cased on demand."""
    table = _MIX[LOWER] if lower else _MIX
    size = ends - starts
    h = np.full(len(starts), 0x1234567, np.uint64)
    act = np.flatnonzero(size <= _LONG_WORD)
    j = 0
    while len(act):
        act = act[size[act] > j]
        h[act] = h[act] * _MUL + table[buf[starts[act] + j]]
        j += 1
    for i in np.flatnonzero(size > _LONG_WORD):
        word = bytes(LOWER[buf[starts[i] : ends[i]]] if lower else buf[starts[i] : ends[i]])
        h[i] = xxhash.xxh64_intdigest(word)
    return mix(h + size.astype(np.uint64))


def spans(row: np.ndarray, n_rows: int) -> np.ndarray:
    """Offsets of each row's words in the word arrays."""
    return np.searchsorted(row, np.arange(n_rows + 1))


def windows(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows inside rows, and the index of their first words."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(row[k - 1 :] == row[: len(row) - k + 1])
    out = np.zeros(len(first), np.uint64)
    for j in range(k):
        out = out * _MUL + h[first + j]
    return mix(out), first


def signed(h: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the long of the same bits."""
    return h.view(np.int64)
