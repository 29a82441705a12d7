"""Packing documents into token sequences by the online sum-of-squares rule.

Each task tokenises the documents it reads and packs them; nothing is shuffled.
Whole windows are cut off a long document first. What is left goes to the fill
level h that makes the sum of squared counts of partially filled windows least;
the counts are one level array: taking level h to h + s changes the sum by
2 * (N[h + s] - N[h] + 1), where a window that gets full counts as nothing, and
opening a window by 2 * N[s] + 1. Ties take the fullest window.

At a task's end the partial windows are settled: as many windows as their tokens
can fill are kept, the fullest ones, with all that the rule put into them; the
emptiest windows are given up, and their pieces, cut where need be, fill the kept
windows' gaps. What is left, under one window, is cut into sequences whose lengths
are powers of two. So no sequence needs padding. Open windows hold ids in memory;
a task with more than ``MAX_OPEN`` of them settles them the same way and goes on.

Tokens are the library's: its rules never join text across ASCII white space, so
words are encoded once, remembered by each worker up to ``REMEMBER`` entries (by a
64-bit hash), and their ids are strung together.

Defined cases: null text is empty and packs as its end id alone; a null doc_id
stays null; repeated rows are packed each on its own; of equally good fill levels
the fullest is taken; a text of any length is tokenised whole and cut into
windows; an empty table gives no row; other columns of ``docs`` are not read,
whatever their names; sequence ids hold the task's number in their upper half.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .text import LOWER, raw, release, slices, word_hashes, words

CAPACITY = 4096
END_ID = 2
MAX_OPEN = 4096
REMEMBER = 600_000
_MARK = "<|endoftext|>"  # the library cuts a text at it before all else
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """Token ids of texts, as one array with row offsets, by remembered units.

    A unit is a word, ASCII lower-cased as the library does, without a full stop or
    comma that follows an ASCII letter; that is a unit of its own. The library
    always cuts there and at white space. Words with ``<|`` stay as they are, as the
    library looks for special tokens before it lower-cases, and so do words with
    combining marks, which it composes before. Units are remembered as sorted hashes
    with ranges of one array of ids; a slice's distinct units are looked up and
    its ids gathered in numpy.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would hold memory of their own
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.mark = self.tokenizer.token_to_id(_MARK)
        self.forget()

    def forget(self) -> None:
        self.keys, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _encode(self, units: list[str]) -> list[np.ndarray]:
        """The library's ids of each unit; many go in one call, with a special token between them."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(units)
        plain = [i for i, u in enumerate(units) if "<|" not in u or self.mark is None]
        odd = sorted(set(range(len(units))) - set(plain))
        for i, e in zip(odd, self.tokenizer.encode_batch_fast([units[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        groups = [plain[i : i + 64] for i in range(0, len(plain), 64)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([_MARK.join(units[i] for i in g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            at = np.flatnonzero(ids == self.mark)
            for i, a, b in zip(group, np.append(0, at + 1).tolist(), np.append(at, len(ids)).tolist(), strict=True):
                out[i] = ids[a:b]
        return out

    def _learn(self, keys: np.ndarray, units: list[bytes]) -> None:
        text = [u.decode("utf-8", "replace") for u in units]
        found = [x for i in range(0, len(text), 4096) for x in self._encode(text[i : i + 4096])]  # the library's encodings are large
        size = np.array([len(x) for x in found], np.int64)
        flat = np.concatenate(found)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        start = self.used + np.cumsum(size) - size
        self.used += len(flat)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.size = np.insert(self.keys, at, keys), np.insert(self.start, at, start), np.insert(self.size, at, size)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and each row's offsets in them."""
        starts, ends, row = words(buf, offs)
        buf = _lowered(buf, starts, ends)
        last = buf[np.maximum(ends - 1, 0)] if len(ends) else np.zeros(0, np.uint8)
        before = buf[np.maximum(ends - 2, 0)] if len(ends) else last
        tail = ((last == 44) | (last == 46)) & (ends - starts > 1) & (before >= 97) & (before <= 122)
        if tail.any():
            place = np.repeat(np.arange(len(starts)), 1 + tail)
            second = np.append(False, place[1:] == place[:-1])
            starts, ends = np.where(second, ends[place] - 1, starts[place]), np.where(tail[place] & ~second, ends[place] - 1, ends[place])
            row = row[place]
        h = word_hashes(buf, starts, ends, lower=False)
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBER:
            self.forget()
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            pick = first[new]
            self._learn(keys[new], [buf[a:b].tobytes() for a, b in zip(starts[pick].tolist(), ends[pick].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        size = self.size[at][back] if len(keys) else np.zeros(0, np.int64)
        to = np.cumsum(size)
        total = int(to[-1]) if len(to) else 0
        from_ = self.start[at][back] - (to - size) if len(keys) else size
        ids = self.ids[np.repeat(from_, size) + np.arange(total)]
        return ids, np.append(0, to)[np.searchsorted(row, np.arange(len(offs)))]


def _lowered(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A-Z in lower case, but not in words with ``<|`` or a combining mark (UTF-8's 0xCC leads all that compose with A-Z)."""
    out = LOWER[buf]
    odd = buf == 0xCC
    odd[:-1] |= (buf[:-1] == 60) & (buf[1:] == 124)
    at = np.flatnonzero(odd)
    if len(at):
        word = np.unique(np.searchsorted(starts, at, "right") - 1)
        edge = np.zeros(len(buf) + 1, np.int8)
        edge[starts[word]] += 1
        edge[ends[word]] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
        out[inside] = buf[inside]
    return out


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class SumOfSquares:
    """Online packing of (doc_id, start, ids, doc_tokens) pieces; ids as 4-byte units."""

    def __init__(self, capacity: int = CAPACITY, first_id: int = 0, max_open: int = MAX_OPEN):
        self.capacity, self.next_id, self.max_open = capacity, first_id, max_open
        self.level = np.zeros(capacity + 1)  # partial windows at each fill level
        self.level[capacity] = -0.5  # a window that gets full leaves the sum
        self.open: dict[int, list[list]] = {}  # level: windows, each a list of pieces
        self.n_open = 0

    def choose(self, size: int) -> int:
        """The fill level to use, 0 for a new window."""
        had = self.level[1 : self.capacity - size + 1]
        change = np.where(had > 0, 2 * (self.level[size + 1 : self.capacity + 1] - had) + 2, np.inf)
        at = len(change) - 1 - int(np.argmin(change[::-1])) if len(change) else 0
        return at + 1 if len(change) and change[at] <= 2 * self.level[size] + 1 else 0

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        total, room = len(ids) // 4, self.capacity
        for start in range(0, total - room + 1, room):
            yield from self._close([(doc, start, ids[4 * start : 4 * (start + room)], total)])
        start = total - total % room
        if start < total:
            yield from self._place((doc, start, ids[4 * start :], total))

    def _place(self, piece: tuple) -> Iterator[tuple]:
        size = len(piece[2]) // 4
        at = self.choose(size)
        window = []
        if at:
            window = self.open[at].pop()
            self.level[at] -= 1
            self.n_open -= 1
        window.append(piece)
        if at + size == self.capacity:
            yield from self._close(window)
            return
        self.open.setdefault(at + size, []).append(window)
        self.level[at + size] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            yield from self.settle(rest=False)

    def _close(self, window: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in window:
            yield doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next_id, offset
            offset += len(ids) // 4
        self.next_id += 1

    def settle(self, rest: bool = True) -> Iterator[tuple]:
        """Fill the fullest partial windows with the pieces of the emptiest; with ``rest``, cut what is left into powers of two."""
        windows = [(at, window) for at in sorted(self.open, reverse=True) for window in self.open[at]]
        self.open, self.n_open = {}, 0
        self.level[: self.capacity] = 0
        full = sum(at for at, _ in windows) // self.capacity
        spare = [p for _, window in windows[full:] for p in reversed(window)]  # taken from the end: the emptiest window first

        def take(room: int) -> Iterator[tuple]:
            while room:
                doc, start, ids, total = spare.pop()
                n = min(room, len(ids) // 4)
                yield doc, start, ids[: 4 * n], total
                if 4 * n < len(ids):
                    spare.append((doc, start + n, ids[4 * n :], total))
                room -= n

        for at, window in windows[:full]:
            yield from self._close([*window, *take(self.capacity - at)])
        left = sum(len(p[2]) // 4 for p in spare)
        while rest and left:
            room = 1 << (left.bit_length() - 1)
            yield from self._close(list(take(room)))
            left -= room
        for piece in reversed(spare):
            yield from self._place(piece)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document, see the module; ``docs`` are packed where they are read."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        from .tokens import model_path

        ids = word_ids(path or model_path("word_bpe_49k.json"))
        packer = SumOfSquares(capacity, TaskContext.get().partitionId() << 32)
        kinds = [pa.int64()] * 7
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def rows(found):
            columns = list(zip(*found, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for part in slices(batch):
                found = []
                flat, at = ids.encode(*raw(part.column(1)))
                flat, at = flat.astype("<u4").tobytes(), (4 * at).tolist()
                for i, doc in enumerate(part.column(0).to_pylist()):
                    found += packer.add(doc, flat[at[i] : at[i + 1]] + end)
                del flat
                release()
                yield rows(found)
        yield rows(list(packer.settle()))

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, SCHEMA)
