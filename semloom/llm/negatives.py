"""Hard negatives by sorting every anchor's scores.

Vectors become whole numbers (floor of 256 times each component), so scores are exact
inner products. Rows are dealt into blocks by their id; each block meets all
anchors, some thousand at a time. For an anchor the block's scores
are sorted by score, then id. A binary search finds where a positive's upper limit
falls in that order; the first k rows of other labels from there on, as long as they hold the lower
limit, are the block's answer. Answers of all blocks are ranked again, so the first k of all rows remain.
An anchor's positives come from an earlier pass over the same blocks, in which only rows
of the anchor's label are sorted.

The work is that of the query set against all rows; a block of rows and one of anchors are
all that a task holds (``BLOCK_BYTES`` each), scores of ``TILE`` anchors at a time. No
block grows with a label, so a label of a third of all rows is no special case, and what blocks
answer is at most k rows for an anchor and positive.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no
part; of rows with the same id the one with the least label, then the least vector, counts once; a shorter
vector lacks nothing but zeros; limits that no score meets, such as those of a negative positive
score, give no row; so do a table without rows and anchors without positives; scores beyond
64 bits raise an error; other columns are not read.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

BLOCK_BYTES = 16 << 20
LEAST_ROWS = 1024
BLOCKS = 24
TILE = 64
SCALE = 256
ANCHOR_EVERY = 50
RELABEL_EVERY = 7
LABELS = 10
POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies between these parts of the positive's, in hundredths.
LOWER, UPPER = 50, 95


def clean(rows: DataFrame) -> DataFrame:
    """(id, label, vector) of the rows that take part, one of each id."""
    whole = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    named = rows.select(rows["vec_id"].cast("long").alias("id"), rows["label"].cast("int").alias("label"), rows["embedding"].cast("array<double>").alias("vector"))
    kept = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & whole)
    return kept.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.label", "row.vector")


def relabelled(rows: DataFrame) -> DataFrame:
    """Labels one further for every ``RELABEL_EVERY``-th id."""
    return rows.withColumn("label", F.when(F.col("id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")))


def _vectors(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of whole numbers, zeros after the end of shorter vectors."""
    out = np.zeros((len(column), width))
    at = 0
    for chunk in column.chunks:
        flat, offs = chunk.flatten().to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        size = np.diff(offs)
        row = np.repeat(np.arange(at, at + len(chunk)), size)
        out[row, np.arange(len(flat)) - np.repeat(offs[:-1] - offs[0], size)] = np.floor(SCALE * flat)
        at += len(chunk)
    return out


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products, in floating point where all sums are whole numbers below 2^53."""
    if anchors.size and rows.size and np.abs(anchors).max() * np.abs(rows).max() * rows.shape[1] >= 2**53:
        exact = np.array([[int(x) for x in r] for r in anchors], object) @ np.array([[int(x) for x in r] for r in rows], object).T
        return exact.astype(np.int64)
    return (anchors @ rows.T).astype(np.int64)


class Sorted:
    """A block of rows, whose scores for a tile of anchors are sorted by falling score, then id."""

    def __init__(self, table: pa.Table, width: int):
        order = np.argsort(table["id"].to_numpy(), kind="stable")
        self.ids, self.labels = table["id"].to_numpy()[order], table["label"].to_numpy()[order]
        self.vectors = _vectors(table["vector"], width)[order]

    def where(self, rows: np.ndarray) -> "Sorted":
        """The block's chosen rows."""
        out = copy.copy(self)
        out.ids, out.labels, out.vectors = self.ids[rows], self.labels[rows], self.vectors[rows]
        return out

    def rank(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor the rows' places in order, and their negated scores, which rise."""
        less = -_scores(anchors, self.vectors)
        places = np.broadcast_to(np.arange(len(self.ids)), less.shape)
        if less.size and np.abs(less).max() < 2**62 // len(self.ids):
            keys = np.sort(less * len(self.ids) + places, axis=1)  # one number holds both sort keys
            return keys % len(self.ids), keys // len(self.ids)
        order = np.stack([np.lexsort((p, s)) for p, s in zip(places, less, strict=True)])
        return order, np.take_along_axis(less, order, 1)


def _positives(block: Sorted, anchors: pa.Table, width: int, k: int) -> list[tuple]:
    """(anchor, score, id) of the block's best k rows of each anchor's label."""
    out, labels = [], anchors["label"].to_numpy()
    ids, vectors = anchors["id"].to_numpy(), _vectors(anchors["vector"], width)
    for label in np.unique(labels):
        mine = block.where(block.labels == label)
        at = np.flatnonzero(labels == label)
        for lo in range(0, len(at) if len(mine.ids) else 0, TILE):
            tile = at[lo : lo + TILE]
            order, less = mine.rank(vectors[tile])
            for i, places, scores in zip(tile, order[:, : k + 1], less[:, : k + 1], strict=True):
                others = mine.ids[places] != ids[i]
                out += [(int(ids[i]), int(-s), int(x)) for x, s in zip(mine.ids[places][others][:k], scores[others][:k], strict=True)]
    return out


def _negatives(block: Sorted, anchors: pa.Table, width: int, k: int) -> list[tuple]:
    """(anchor, positive, positive score, score, id) of the block's first k rows within each positive's limits."""
    out = []
    ids, labels, vectors = anchors["id"].to_numpy(), anchors["label"].to_numpy(), _vectors(anchors["vector"], width)
    wanted = anchors["positives"].to_pylist()
    for lo in range(0, len(ids), TILE):
        order, less = block.rank(vectors[lo : lo + TILE])
        for i, places, scores in zip(range(lo, len(ids)), order, less, strict=False):
            other = block.labels[places] != labels[i]
            places, scores = places[other], scores[other]
            for p in wanted[i]:
                top, bottom = UPPER * p["score"] // 100, -(-LOWER * p["score"] // 100)
                at = int(np.searchsorted(scores, -top, "left"))
                out += [(int(ids[i]), p["id"], p["score"], int(-s), int(block.ids[x])) for x, s in zip(places[at : at + k], scores[at : at + k], strict=True) if -s >= bottom]
    return out


def _met(rows: DataFrame, anchors: DataFrame, shape: tuple[int, int, int], answer, k: int, schema: str) -> DataFrame:
    """Every block of rows with every block of anchors, one pair a task's turn."""
    blocks, groups, width = shape
    names = [x.split()[0] for x in schema.split(", ")]

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        found = answer(Sorted(left, width), right, width, k) if left.num_rows and right.num_rows else []
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*found, strict=True) if found else [[]] * len(names), strict=True)})

    mine = rows.select("*", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    theirs = anchors.select(*[F.col(c).alias(c) for c in anchors.columns], F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int").alias("group"), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"))
    return mine.groupBy("block", "group").cogroup(theirs.groupBy("block", "group")).applyInArrow(one, schema)


def hard_negatives(rows: DataFrame, anchors, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """The hard negatives of rows (id, label, vector) that ``anchors``, a condition on them, selects."""
    rows = written(rows, "negatives-rows")
    n, width, asked = rows.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.count(F.when(anchors, 1))).first()
    width = max(1, width or 0)
    fit = max(1, BLOCK_BYTES // (8 * width))
    shape = (max(1, -(-n // fit), min(BLOCKS, n // LEAST_ROWS)), max(1, -(-asked // fit)), width)
    chosen = rows.where(anchors)
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    found = _met(rows, chosen, shape, _positives, positives, "anchor long, score long, id long").withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    wanted = found.groupBy("anchor").agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    asking = wanted.withColumnRenamed("anchor", "id").join(chosen, "id").select("id", "label", "vector", "positives")
    last = _met(rows, asking, shape, _negatives, negatives, "anchor_id long, positive_id long, positive_score long, negative_score long, negative_id long")
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = last.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def report(rows: DataFrame) -> DataFrame:
    """The contract's anchors and labels over a table of (vec_id, embedding, label)."""
    return hard_negatives(relabelled(clean(rows)), F.col("id") % ANCHOR_EVERY == 0)


ORACLE_SQL = f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % {RELABEL_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {ANCHOR_EVERY} = 0
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}
)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INT) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND {LOWER} * p.score <= 100 * n.score AND 100 * n.score <= {UPPER} * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
