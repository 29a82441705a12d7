"""Vectors in cells: similarity joins and searches that leave out what a bound rules out.

Vectors are brought to length one, so a cosine s is a distance sqrt(2 - 2 s). Centres come from
k-means over a bounded sample (``SAMPLE_BYTES``, the rows with the least hashes); all rows are then dealt to
their nearest centre, and each cell keeps how far its rows are from it at most. By the triangle inequality
a row of a cell is no nearer to a query than the query's distance to the centre less that radius, so a
cell whose bound is over the wanted distance is never opened.

Rows and queries are packed in the order of their cells into blocks of at most ``BLOCK`` rows, each written once.
Blocks meet by a product without a shuffle: a task reads its blocks of both sides, so nothing is copied
for each cell or pair, and a cell of a third of all rows is many blocks. A pair of blocks none of whose cells is
opened is dropped by the join's condition. Scores are found roughly in 32 bits with a bound on the error; only
pairs that may count are scored exactly. Rows without a direction (null, empty or zero vectors) are kept apart.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

MAX_CELLS = 1024
SAMPLE_BYTES = 32 << 20
ROUNDS = 5
#: Rows of a block at most, and bytes of its vectors.
BLOCK, BLOCK_BYTES = 4096, 4 << 20
#: Bytes of the vectors in a written part of the queries' and of the rows' blocks.
LEFT_BYTES, RIGHT_BYTES = 8 << 20, 32 << 20
#: Scores held at once, and pairs scored exactly at once.
TILE, EXACT = 1 << 20, 1 << 16
#: Cells that a search opens first to learn how far it has to go.
FIRST_CELLS = 8
#: Distances are compared with this much room for rounding; similarities are rounded alike, so equal vectors tie.
ROOM = 1e-7
DIGITS = 12


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in column], float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def directed(column: str = "vector"):
    """Whether a vector has a direction: nothing missing in it, and something not zero."""
    return F.coalesce((F.size(column) > 0) & F.forall(column, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(column, lambda x: x != 0), F.lit(False))


class Cells:
    """Centres, and the size and radius of each cell of the rows they were made for."""

    def __init__(self, rows: DataFrame):
        """``rows`` have a ``vector`` with a direction each; they must be the same whenever they are read."""
        self.n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
        self.width = max(1, width or 0)
        fit = max(1, SAMPLE_BYTES // (8 * self.width))
        cells = max(1, min(MAX_CELLS, round(self.n**0.5), fit))
        few = rows.select("vector").orderBy(F.xxhash64("vector")).limit(min(16 * cells, fit)).collect()
        self.centres = _k_means(unit(matrix([r["vector"] for r in few])), cells) if few else np.zeros((1, self.width))
        self.rows = self.placed(rows)
        self.size, self.radius = np.zeros(len(self.centres), np.int64), np.zeros(len(self.centres))
        for r in self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():  # one row a centre
            self.size[r["cell"]], self.radius[r["cell"]] = r["n"], r["far"]

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their ``cell`` and how ``far`` they are from its centre."""
        centres = self.centres

        def place(v: pd.Series) -> pd.DataFrame:
            x = unit(matrix(v))
            d = _distances(x, centres) if len(x) else np.zeros((0, 1))
            at = d.argmin(1)
            return pd.DataFrame({"cell": at.astype(np.int32), "far": d[np.arange(len(x)), at]})

        return rows.withColumn("__at", F.pandas_udf(place, "cell int, far double")("vector")).select(*rows.columns, "__at.cell", "__at.far")

    def bounds(self):
        """A function of unit vectors (and cells): the least distance that a row of each cell can have; infinite for empty cells."""
        centres, radius, size = self.centres, self.radius, self.size

        def run(x: np.ndarray, cells=slice(None)) -> np.ndarray:
            return np.where(size[cells] > 0, np.maximum(0, _distances(x, centres[cells]) - radius[cells] - ROOM), np.inf)

        return run

    def blocks(self, rows: DataFrame, key: str, width: int, part: int, reach=None) -> DataFrame:
        """Blocks of rows (``key``, vector, cell, perhaps floor): their keys, unit vectors and cells with their ends.

        With ``reach(bounds, floor)``, the distance up to which each row asks, blocks of queries: with reaches, floors and the cells opened.
        """
        bounds, fit = self.bounds(), max(1, min(BLOCK, BLOCK_BYTES // (8 * width)))
        kind = rows.schema[key].dataType.simpleString()

        def pack(batches):
            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += batch.num_rows
                while size >= fit:
                    table = pa.Table.from_batches(held)
                    yield block(table.slice(0, fit))
                    held, size = table.slice(fit).to_batches(), size - fit
            if size:
                yield block(pa.Table.from_batches(held))

        def block(t: pa.Table) -> pa.RecordBatch:
            x, cell = unit(matrix(t["vector"].to_numpy())), t["cell"].to_numpy()
            ends = np.append(np.flatnonzero(np.diff(cell)) + 1, len(cell))
            keys = t[key].combine_chunks()
            out = {"block": pa.array([uuid.uuid4().bytes], pa.binary()), "keys": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), "vectors": pa.array([x.tobytes()], pa.binary())}
            if reach is None:
                out |= {"cells": _list(cell[ends - 1]), "ends": _list(ends)}
            else:
                b, floor = bounds(x), t["floor"].to_numpy()
                far = np.asarray(reach(b, floor), float)
                out |= {"cells": _list(np.flatnonzero((np.isfinite(b) & (b <= far[:, None])).any(0))), "reaches": pa.array([far.tobytes()], pa.binary()), "floors": pa.array([floor.astype(float).tobytes()], pa.binary())}
            return pa.RecordBatch.from_arrays(list(out.values()), list(out))

        more = "ends array<int>" if reach is None else "reaches binary, floors binary"
        dealt = rows.repartitionByRange(part, "cell", F.xxhash64(key)).sortWithinPartitions("cell")
        return written(dealt.mapInArrow(pack, f"block binary, keys array<{kind}>, vectors binary, cells array<int>, {more}"), "cells-blocks")

    def parts(self, n: int, most: int, least: int = 1) -> int:
        return max(1, -(-n * 8 * self.width // most), min(least, n // 1024))

    def met(self, queries: DataFrame, key: str, own: str, reach, answer, schema: str) -> DataFrame:
        """``answer`` over all pairs of a block of queries (key, vector, floor) and one of rows (own, vector) that may hold what is asked.

        It takes an iterator of (block, keys, unit vectors, reaches, floors; keys, unit vectors, cells, ends) and gives batches.
        """
        width, cores = self.width, queries.sparkSession.sparkContext.defaultParallelism
        left = self.blocks(self.placed(queries), key, width, self.parts(queries.count(), LEFT_BYTES, cores), reach)
        right = self.blocks(self.rows, own, width, self.parts(self.n, RIGHT_BYTES))
        l = left.select("block", "keys", "vectors", "reaches", "floors", F.col("cells").alias("opened"))
        r = right.select(F.col("keys").alias("own"), F.col("vectors").alias("rows"), "cells", "ends")
        pairs = l.join(r, F.exists("opened", lambda c: (c >= F.element_at("cells", 1)) & (c <= F.element_at("cells", -1)))).drop("opened")

        def run(batches):
            def each():
                for batch in batches:
                    for i in range(batch.num_rows):
                        c = {n: batch.column(n)[i] for n in batch.schema.names}
                        mine = [np.frombuffer(c[n].as_buffer(), np.float64) for n in ("vectors", "reaches", "floors")]
                        yield c["block"].as_py(), c["keys"].values, mine[0].reshape(-1, width), *mine[1:], c["own"].values, np.frombuffer(c["rows"].as_buffer(), np.float64).reshape(-1, width), c["cells"].values.to_numpy(), c["ends"].values.to_numpy()

            yield from answer(each())

        return pairs.mapInArrow(run, schema)


def _list(x: np.ndarray) -> pa.Array:
    return pa.array([x.astype(np.int32)], pa.list_(pa.int32()))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * x @ centres.T))


def _k_means(x: np.ndarray, cells: int) -> np.ndarray:
    """Centres of Lloyd's rounds, from rows spread over the sample."""
    centres = np.unique(x, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(cells, len(centres))).astype(int)]
    for _ in range(ROUNDS):
        at = _distances(x, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All cosines of two matrices' rows, rounded; 0 with a row of zeros."""
    return np.round(unit(a) @ unit(b).T, DIGITS)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of unit rows with each other, one by one, so that equal rows give equal numbers; rounded."""
    return np.round(np.einsum("ij,ij->i", a, b), DIGITS)


def rough_error(width: int) -> float:
    """What a product of unit vectors in 32 bits can be wrong by."""
    return (width + 8) * 2.0**-23


def opened(open_: np.ndarray, ends: np.ndarray):
    """(start, end, rows) of the rows of a block to be met and the queries that open them, where ``open_`` says which cells they open.

    Where most are open, the whole block is met at once: one large product takes less than many small ones.
    """
    if open_.mean() > 0.3:
        yield 0, int(ends[-1]), np.arange(len(open_))
        return
    for start, end, mine in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), open_.T, strict=True):
        if mine.any():
            yield start, end, np.flatnonzero(mine)


def candidates(x: np.ndarray, x32: np.ndarray, chosen: np.ndarray, y: np.ndarray, y32: np.ndarray, floor: np.ndarray, k: int | None = None):
    """(rows of x, rows of y, cosines) of the pairs of unit vectors (and their 32 bits) with a cosine of x's ``floor`` or more, in tiles.

    Only ``chosen`` rows of x are met. With ``k``, pairs that can't be among a row's first k in y may be left out.
    """
    room = rough_error(x.shape[1])
    step = max(1, TILE // max(1, len(y)))
    for lo in range(0, len(chosen) if len(y) else 0, step):
        mine = chosen[lo : lo + step]
        rough = x32[mine] @ y32.T
        low = floor[mine]
        least = low - room
        hits = rough >= least[:, None]
        if k is not None and len(y) > k and np.count_nonzero(hits) > 4 * k * len(rough):
            hits = rough >= np.maximum(least, np.partition(rough, len(y) - k, axis=1)[:, len(y) - k] - 2 * room)[:, None]
        flat = np.flatnonzero(hits)
        for i in range(0, len(flat), EXACT):
            at, of = np.divmod(flat[i : i + EXACT], len(y))
            sim = exact(x[mine[at]], y[of])
            keep = sim >= low[at]
            yield mine[at[keep]], of[keep], sim[keep]


class Best:
    """The first ``k`` rows of each query (unit vectors) among those met so far, ties by number."""

    def __init__(self, queries: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.x, self.x32, self.k = queries, queries.astype(np.float32), k
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor.copy()
        self.found, self.n = [], 0

    def meet(self, rows: np.ndarray, rows32: np.ndarray, numbers: np.ndarray, chosen: np.ndarray) -> None:
        for at, of, sim in candidates(self.x, self.x32, chosen, rows, rows32, self.floor, self.k):
            self.found.append((at, numbers[of], sim))
            self.n += len(at)
            if self.n > 4 * (self.k + 1) * len(self.x) + EXACT:
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, number, cosine) of what is kept, in order."""
        at, number, sim = (np.concatenate([f[i] for f in self.found]) if self.found else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, float)))
        order = np.lexsort((number, -sim, at))
        at, number, sim = at[order], number[order], sim[order]
        first = np.searchsorted(at, at)
        nth = np.arange(len(at)) - first
        full = nth == self.k - 1
        self.floor[at[full]] = sim[full]
        keep = nth < self.k
        self.found = [(at[keep], number[keep], sim[keep])]
        self.n = int(keep.sum())
        return self.found[0]


def similarities(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs`` (__l, __r, ...) with ``sim``, null where a side has no direction."""

    def sim(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([np.round(float((unit(matrix([x])) @ unit(matrix([y])).T)[0, 0]), DIGITS) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype=float)

    x = left.select("__l", F.when(directed(), F.col("vector")).alias("__lv"))
    y = right.select("__r", F.when(directed(), F.col("vector")).alias("__rv"))
    met = pairs.join(x, "__l").join(y, "__r")
    return met.withColumn("sim", F.when(F.col("__lv").isNotNull() & F.col("__rv").isNotNull(), F.pandas_udf(sim, "double")("__lv", "__rv"))).select(*pairs.columns, "sim")


def pairs_over(left: DataFrame, right: DataFrame, low: float) -> DataFrame:
    """(__l, __r, sim) of the pairs of (__l, vector) and (__r, vector) with a cosine of ``low`` or more, and of those without one."""
    return _pairs_over(left, right, low)[0]


def counted_pairs_over(left: DataFrame, right: DataFrame, low: float) -> tuple[DataFrame, int]:
    """The same, and how many pairs with a cosine are formed to find them."""
    out, cells, reach = _pairs_over(left, right, low)
    bounds, size = cells.bounds(), cells.size

    def formed(v: pd.Series) -> pd.Series:
        return pd.Series([int(size[np.isfinite(b) & (b <= reach)].sum()) for b in (bounds(unit(matrix(v))) if len(v) else [])], dtype="int64")

    return out, left.where(directed()).agg(F.coalesce(F.sum(F.pandas_udf(formed, "long")("vector")), F.lit(0))).first()[0]


def _pairs_over(left: DataFrame, right: DataFrame, low: float) -> tuple[DataFrame, Cells, float]:
    whole_l, whole_r = left.where(directed()), right.where(directed())
    blank_l, blank_r = left.where(~directed()).select("__l"), right.where(~directed()).select("__r")
    none = F.lit(None).cast("double").alias("sim")
    blank = blank_l.crossJoin(right.select("__r")).select("__l", "__r", none).union(whole_l.select("__l").crossJoin(blank_r).select("__l", "__r", none))
    cells = Cells(whole_r.select("__r", "vector"))
    reach = np.inf if low <= -1 else np.sqrt(max(0.0, 2 - 2 * low)) + ROOM
    bounds = cells.bounds()

    def near(pairs):
        for _, keys, x, _, _, own, y, which, ends in pairs:
            x32, y32, floor = x.astype(np.float32), y.astype(np.float32), np.full(len(x), low)
            for start, end, chosen in opened(bounds(x, which) <= reach, ends):
                for at, of, sim in candidates(x, x32, chosen, y[start:end], y32[start:end], floor):
                    if len(at):
                        yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), own.take(pa.array(of + start)), pa.array(sim)], ["__l", "__r", "sim"])

    asked = whole_l.select("__l", "vector", F.lit(float(low)).alias("floor"))
    found = cells.met(asked, "__l", "__r", lambda b, _: np.full(len(b), reach), near, "__l binary, __r binary, sim double")
    return found.union(blank), cells, reach


def _floors(cells: Cells, queries: DataFrame, k: int) -> DataFrame:
    """(rep, floor): a cosine that k rows reach at least, from a block of each of a query's most promising cells; null where they hold too few."""
    bounds, size = cells.bounds(), cells.size

    def first(v: pd.Series) -> pd.Series:
        out = []
        for b in bounds(unit(matrix(v))) if len(v) else []:
            order = np.argsort(b, kind="stable")[:FIRST_CELLS]
            order = order[np.isfinite(b[order])]
            out.append(order[: int(np.searchsorted(np.cumsum(size[order]), k)) + 1].astype(np.int32))
        return pd.Series(out, dtype=object)

    opened = queries.select("rep", "vector", F.explode(F.pandas_udf(first, "array<int>")("vector")).alias("cell"))
    opened = written(opened, "cells-opened")
    shapes = [(r["cell"], max(1, int(size[r["cell"]]) // BLOCK), -(-r["n"] // BLOCK)) for r in opened.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()]  # one row a centre
    shapes = F.broadcast(queries.sparkSession.createDataFrame([(c, rows, max(rows, asks)) for c, rows, asks in shapes], "cell int, blocks long, slots long"))
    left = opened.join(shapes, "cell").select("cell", F.pmod(F.xxhash64("rep"), "slots").alias("slot"), "rep", "vector")
    block = F.pmod(F.xxhash64("n"), "blocks")
    right = cells.rows.join(shapes, "cell").withColumn("slot", F.explode(F.sequence(block, F.col("slots") - 1, F.col("blocks")))).select("cell", "slot", "vector")

    def best(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return pa.table({"rep": pa.array([], pa.int64()), "sims": pa.array([], pa.list_(pa.float64()))})
        top = Best(unit(matrix(q["vector"].to_numpy())), k)
        rows = unit(matrix(r["vector"].to_numpy()))
        top.meet(rows, rows.astype(np.float32), np.arange(r.num_rows), np.arange(q.num_rows))
        at, _, sim = top.cut()
        ends = np.searchsorted(at, np.arange(q.num_rows + 1))
        return pa.table({"rep": q["rep"], "sims": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sim))})

    found = left.groupBy("cell", "slot").cogroup(right.groupBy("cell", "slot")).applyInArrow(best, "rep long, sims array<double>")
    return found.groupBy("rep").agg(F.sort_array(F.flatten(F.collect_list("sims")), False).alias("sims")).select("rep", F.get("sims", F.lit(k - 1)).alias("floor"))


def nearest(queries: DataFrame, index: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(q, id, value, sim) of the ``k`` rows (id, value, vector) most like each query (q, vector), ties by id.

    Exact without ``probes``: a first pass over a part of each query's most promising cells finds a cosine that k rows reach;
    it tells which cells have to be opened. With ``probes``, only so many cells are. Equal queries are searched once, and
    of equal vectors only the first k can be among any query's first k, so no more of them are searched.
    """
    asked = queries.where(F.col("vector").isNotNull() & (F.size("vector") > 0))
    blank_q, whole_q = asked.where(~directed()), asked.where(directed())
    rows = index.where(F.col("vector").isNotNull() & (F.size("vector") > 0))
    kind = {f.name: f.dataType.simpleString() for f in index.schema}
    copies = Window.partitionBy("vector").orderBy("id")
    few = rows.where(directed()).withColumn("__n", F.row_number().over(copies)).where(F.col("__n") <= k).drop("__n")
    numbered = written(few.orderBy("id").withColumn("n", F.monotonically_increasing_id()), "cells-rows")  # numbers rise with ids
    asking = written(whole_q.groupBy("vector").agg(F.count(F.lit(1)).alias("queries")).withColumn("rep", F.monotonically_increasing_id()), "cells-queries").select("rep", "vector")
    cells = Cells(numbered.select("n", "vector"))
    found = _found(cells, asking, k, probes) if cells.n else None
    best_first = Window.partitionBy("q").orderBy(F.desc("sim"), "id")

    def kept(df: DataFrame) -> DataFrame:
        return df.withColumn("__n", F.row_number().over(best_first)).where(F.col("__n") <= k).drop("__n")

    zero = rows.where(~directed()).select("id", "value", F.lit(0.0).alias("sim"))
    least = zero.orderBy("id").limit(k)  # rows of zeros are equally like any query, so the first k of them are enough
    out = whole_q.select("q").crossJoin(F.broadcast(least)).select("q", "id", "value", "sim")
    level = rows.select("id", "value", F.lit(0.0).alias("sim")).orderBy("id").limit(k)
    out = out.union(blank_q.select("q").crossJoin(F.broadcast(level)).select("q", "id", "value", "sim"))
    if found is not None:
        named = found.join(numbered.select("n", "id", "value"), "n").select("rep", "id", "value", "sim")
        whose = whole_q.join(asking, "vector").select("q", "rep")
        out = out.union(whose.join(named, "rep").select("q", "id", "value", "sim"))
    return kept(out).select("q", F.col("id").cast(kind["id"]).alias("id"), "value", "sim")


def _found(cells: Cells, asking: DataFrame, k: int, probes: int | None) -> DataFrame:
    """(rep, n, sim) of the first k rows of each query (rep, vector)."""
    bounds = cells.bounds()
    if probes is None:
        asked = asking.join(_floors(cells, asking, k), "rep", "left").select("rep", "vector", (F.coalesce("floor", F.lit(float("-inf"))) - 1e-9).alias("floor"))
    else:
        asked = asking.withColumn("floor", F.lit(float("-inf")))

    def reach(b: np.ndarray, floor: np.ndarray) -> np.ndarray:
        if probes is not None:
            return np.partition(b, min(probes, b.shape[1]) - 1, axis=1)[:, min(probes, b.shape[1]) - 1] + ROOM
        return np.where(np.isfinite(floor), np.sqrt(np.maximum(0, 2 - 2 * floor)) + ROOM, np.inf)

    def told(held: dict):
        for keys, best in held.values():
            at, n, sim = best.cut()
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(n), pa.array(sim)], ["rep", "n", "sim"])

    def search(pairs):
        held: dict = {}  # the queries' blocks of this task
        for block, keys, x, reaches, floors, own, y, which, ends in pairs:
            if block not in held:
                if sum(len(b.x) * (x.shape[1] + k) for _, b in held.values()) > TILE * 4:
                    yield from told(held)
                    held = {}
                held[block] = (pa.concat_arrays([keys]), Best(x.copy(), k, floors))
            best = held[block][1]
            numbers, y32 = own.to_numpy(), y.astype(np.float32)
            for start, end, chosen in opened(bounds(x, which) <= reaches[:, None], ends):
                best.meet(y[start:end], y32[start:end], numbers[start:end], chosen)
        yield from told(held)

    found = cells.met(asked, "rep", "n", reach, search, "rep long, n long, sim double")
    order = Window.partitionBy("rep").orderBy(F.desc("sim"), "n")
    return written(found.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).drop("__n"), "cells-found")
