"""Token counts of a sentencepiece BPE model by rank-synchronous merging of ragged arrays.

The model's pieces hold the word mark only at their start, so a text (with the
mark put before it and in place of spaces) falls into pre-tokens that never merge
with each other: a run of marks and what follows up to the next mark. Distinct
pre-tokens are kept as one ragged numpy array of symbols; in each round every
sequence merges its pairs of least rank, from the left where they overlap, all sequences at once, until no
pair is left, and the surviving symbols are counted. A symbol outside the
vocabulary costs its UTF-8 bytes (byte fallback). This is the library's order, as long as
all pairs with the new symbol rank after those that make it; where a longer piece has the better
rank, a sequence merges its leftmost pair alone in that round. Pre-tokens of any
length go this way; rounds grow with the number of different ranks in a sequence, not with its length. Counts of
pre-tokens are remembered by each worker, up to ``REMEMBER`` entries, then forgotten.

Defined cases: null text is empty and has 0 tokens; special strings in a text are
plain text, as the library takes them; texts of any length are counted whole, one of more than a
slice by itself; just ``LIMIT`` tokens aren't over the limit; repeated rows are counted
each; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import map_text, texts

LIMIT = 4096
REMEMBER = 1_000_000
_MARK = "▁"
_RUN = re.compile(rb" +[^ ]*")
_NONE = np.int64(2**62)


class RankedMerges:
    """The merge table of a sentencepiece BPE model, made from its file's pieces and scores."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                pieces[model.id_to_piece(i)] = -model.get_score(i)
        if any(_MARK in p.lstrip(_MARK) for p in pieces):
            raise ValueError("a piece holds the word mark after its start; texts can't be cut before marks")
        self.known = set(pieces)
        self.symbol = {p: i for i, p in enumerate(dict.fromkeys([*pieces, *(c for p in pieces for c in p)]))}
        self.cost = np.array([1 if p in pieces else len(p.encode()) for p in self.symbol], np.int64)
        # scores order pieces; equal scores share a rank, then the leftmost pair wins
        level = {s: r for r, s in enumerate(sorted(set(pieces.values())))}
        keys, ranks, made = [], [], []
        for p, score in pieces.items():
            for i in range(1, len(p)):
                a, b = self.symbol.get(p[:i]), self.symbol.get(p[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(level[score])
                    made.append(self.symbol[p])
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = np.array(ranks, np.int64)[order]
        self.made = np.array(made, np.int64)[order]
        self.settled = _settled(self.keys, self.ranks, self.made, len(self.symbol))
        self.memory: dict[bytes, int] = {}

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.ranks[at], _NONE), self.made[at]

    def count(self, tokens: list[str]) -> np.ndarray:
        """Surviving symbols of each pre-token, merged in step."""
        total = np.zeros(len(tokens), np.int64)
        size = np.array([len(t) for t in tokens], np.int64)
        get = self.symbol.get
        # a character outside every piece gets a negative symbol: minus its bytes
        sym = np.array([get(c) if c in self.symbol else -len(c.encode()) for t in tokens for c in t], np.int64)
        seq = np.repeat(np.arange(len(tokens)), size)
        while len(sym) > 1:
            rank, made = self.look_up(sym[:-1], sym[1:])
            rank = np.where(seq[:-1] == seq[1:], rank, _NONE)
            rank = np.append(rank, _NONE)
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            least = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(seq)))
            going = least < _NONE
            keep = np.repeat(going, length)
            done = ~keep
            if done.any():
                np.add.at(total, seq[done], self._costs(sym[done]))
            if not going.any():
                return total
            hit = np.flatnonzero(keep & (rank == np.repeat(least, length)))
            lead = np.append(True, seq[hit[1:]] != seq[hit[:-1]])
            start = np.append(True, (hit[1:] != hit[:-1] + 1) | lead[1:])  # of each run of overlapping pairs, of which every second one merges
            odd = (hit - hit[start][np.cumsum(start) - 1]) % 2
            alone = np.logical_or.reduceat(~self.settled[made[hit]], np.flatnonzero(lead))[np.cumsum(lead) - 1]
            hit = hit[lead | ((odd == 0) & ~alone)]
            sym[hit] = made[hit]
            keep[hit + 1] = False
            sym, seq = sym[keep], seq[keep]
        np.add.at(total, seq, self._costs(sym))
        return total

    def _costs(self, sym: np.ndarray) -> np.ndarray:
        return np.where(sym >= 0, self.cost[np.maximum(sym, 0)], -sym)

    def pre_tokens(self, text: bytes) -> list[bytes]:
        """Pre-tokens without their first mark."""
        if not text:
            return []
        if b"\xe2\x96\x81" in text:
            text = text.replace(b"\xe2\x96\x81", b" ")
        if b"  " not in text and text[0] != 32:
            return text.split(b" ")
        return [x[1:] for x in _RUN.findall(b" " + text)]

    def learn(self, tokens: set[bytes]) -> None:
        """Count the pre-tokens that aren't remembered yet."""
        if len(self.memory) > REMEMBER:
            self.memory.clear()
        new = list(tokens) if not self.memory else [t for t in tokens if t not in self.memory]
        text = [(_MARK + t.decode("utf-8", "replace")).replace(" ", _MARK) for t in new]
        for at in range(0, len(text), 50_000):
            self.memory.update(zip(new[at : at + 50_000], self.count(text[at : at + 50_000]).tolist(), strict=True))

    def counts(self, many: list[bytes]) -> list[int]:
        cut = [self.pre_tokens(t) for t in many]
        self.learn(set().union(*cut))
        get = self.memory.__getitem__
        return [sum(map(get, c)) for c in cut]


def _settled(keys: np.ndarray, ranks: np.ndarray, made: np.ndarray, symbols: int) -> np.ndarray:
    """For each symbol, whether all pairs with it rank after all pairs that make it."""
    most, least = np.full(symbols, -1, np.int64), np.full(symbols, _NONE)
    np.maximum.at(most, made, ranks)
    np.minimum.at(least, keys >> 32, ranks)
    np.minimum.at(least, keys & 0xFFFFFFFF, ranks)
    return least > most


@lru_cache(maxsize=1)
def merges(path: str) -> RankedMerges:
    return RankedMerges(path)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document, mapped where it is read."""

    def make():
        table = merges(path or model_path())

        def step(part):
            many = texts(part.column(1))
            n = np.array(table.counts(many), np.int64)
            return {"doc_id": part.column(0), "n_bytes": pa.array([len(t) for t in many], pa.int64()), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)}

        return step

    return map_text(docs, ["doc_id", "text"], make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
