"""Top-k retrieval from an index of vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import written
from .cells import Best, matrix, nearest, unit
from .provider import ModelProvider
from .relational import col

#: Index bytes up to which each task searches a broadcast copy; a larger index is searched in cells.
BROADCAST_BYTES = 64 << 20
#: Index rows from which queries are dealt to all cores, and queries searched and rows met at once.
DEAL_ROWS = 4096
QUERIES, ROWS = 4096, 16384


class VectorIndex:
    """A frame of (id, value, vector); ``search`` results are ordered by cosine, ties by id."""

    def __init__(self, df: DataFrame, id_col: str, value_col: str, vector_col: str):
        self.df = df.select(col(id_col).alias("id"), col(value_col).cast("string").alias("value"), col(vector_col).cast("array<double>").alias("vector"))  # ids keep their type, which orders ties

    def bytes(self) -> int:
        return self.df.agg(F.coalesce(F.sum(F.size("vector") * 8 + F.octet_length("value") + 16), F.lit(0))).first()[0]


def _shape(queries: list, found: list[list]) -> list:
    return found[0] if len(queries) == 1 else found


def sem_topk(df: DataFrame, index: VectorIndex, search_attr: str, fields: T.StructType, k: int, provider: ModelProvider | None = None, model: str = "local-embed", search_func: Callable | None = None) -> DataFrame:
    """``df`` with the output field: the k nearest values of each row's query.

    The query is a string (embedded), a list of strings (a list of results each),
    or a vector (searched as it is); anything else gives null. A failed search
    gives an empty list, a faulty search function raises. ``search_func(index_rows, query, k)`` replaces the search; it
    needs the index in memory, so that must fit ``BROADCAST_BYTES``. Otherwise only the first k rows of equal vectors
    count, texts are embedded in a stage of their own and a larger index is searched in cells, with the same result.
    """
    name = fields.fields[0].name
    kind = df.schema[search_attr].dataType
    held, large = index.df.where(F.col("vector").isNotNull() & (F.size("vector") > 0)), index.bytes() > BROADCAST_BYTES
    if large and search_func is not None:
        raise ValueError("the index is too large to be given to a search function")
    if search_func is None and k >= 0:
        held = _thinned(held, k)
    if large and k >= 0:
        copies = Window.partitionBy("vector").orderBy("id")
        held = written(held.withColumn("__n", F.row_number().over(copies)).where(F.col("__n") <= k).drop("__n"), "topk-index")
        index = VectorIndex(held, "id", "value", "vector")
        large = index.bytes() > BROADCAST_BYTES
    if large:
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
            return _joined(df, index, search_attr, name, k)
        if isinstance(kind, T.StringType):
            return _joined(_with_vectors(df, search_attr, provider, model), index, "__vector", name, k).drop("__vector")
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            return _several(df, index, search_attr, name, k, provider, model)
        return df.withColumn(name, F.lit(None).cast("array<string>"))
    rows = held.orderBy("id").select("value", "vector").toArrow()  # under the limit
    values, vectors = rows["value"].to_pylist(), matrix(rows["vector"].to_numpy())
    if search_func is None:
        kept = _first_copies(vectors, k)
        values, vectors = [values[i] for i in kept.tolist()], vectors[kept]
    shared = df.sparkSession.sparkContext.broadcast((values, vectors))
    many = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType)

    def asked(q):
        """The vectors that a query asks with; a failed one gives an empty list, no query null."""
        if q is None or not isinstance(q, (str, list, np.ndarray)):
            return None
        try:
            if search_func is not None:
                return list(search_func(shared.value, q, k))[:k]
            if isinstance(q, str):
                return [np.asarray(provider.embed([q], model), float)[0]]
            if many:
                return list(np.asarray(provider.embed(list(q), model), float))
            return [np.asarray(q, dtype=float)]
        except (NameError, AttributeError, TypeError, ImportError):  # a fault of the code, not of this search
            raise
        except Exception:
            return []

    def run(s: pd.Series) -> pd.Series:
        given = [asked(q) for q in s]
        if search_func is not None:
            return pd.Series(given, dtype=object)
        width = shared.value[1].shape[1] if len(shared.value[0]) else None
        given = [[] if vectors and width and any(v.shape != (width,) for v in vectors) else vectors for vectors in given]
        found = iter(_searched([v for vectors in given for v in vectors or []], *shared.value, k))
        lists = [None if vectors is None else [next(found) for _ in vectors] for vectors in given]
        return pd.Series([x if many or not x else x[0] for x in lists], dtype=object)

    if len(values) >= DEAL_ROWS:
        df = df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)
    made = F.pandas_udf(run, "array<array<string>>" if many else "array<string>").asNondeterministic()
    return df.withColumn(name, made(col(search_attr)))


def _equal(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row's index of each group of equal rows, and each row's group."""
    rows = np.ascontiguousarray(vectors + 0.0)
    return np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_index=True, return_inverse=True)[1:]


def _first_copies(vectors: np.ndarray, k: int) -> np.ndarray:
    """Indexes, in order, of the first k rows of each group of equal vectors: no query's first k hold others."""
    if k < 0 or not len(vectors):
        return np.arange(len(vectors))
    group = _equal(vectors)[1]
    order = np.argsort(group, kind="stable")
    nth = np.arange(len(order)) - np.searchsorted(group[order], group[order])
    return np.sort(order[nth < k])


def _thinned(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` (id, value, vector) without those that have k rows of the same vector and lesser ids in their batch: what equal rows leave is little."""

    def run(batches):
        for batch in batches:
            vectors = batch.column("vector")
            width = pc.list_value_length(vectors)
            if batch.num_rows and pc.min_max(width)["min"] == pc.min_max(width)["max"]:
                flat = pc.fill_null(vectors.flatten(), float("nan")).to_numpy(zero_copy_only=False)
                batch = batch.take(pa.array(_first_copies(flat.reshape(batch.num_rows, -1), k)))
            yield batch

    return rows.sortWithinPartitions("id").mapInArrow(run, rows.schema)


def _searched(queries: list, values: list, vectors: np.ndarray, k: int) -> list[list]:
    """The k nearest values of each query vector, ties by place; equal queries are searched once."""
    k = min(k, len(values)) if k >= 0 else max(0, len(values) + k)
    if not queries or not k:
        return [[] for _ in queries]
    one, group = _equal(np.stack(queries))
    found = []
    for lo in range(0, len(one), QUERIES):
        top = Best(_directions(np.stack([queries[i] for i in one[lo : lo + QUERIES]])), k)
        for at in range(0, len(vectors), ROWS):
            rows = _directions(vectors[at : at + ROWS])
            top.meet(rows, rows.astype(np.float32), np.arange(at, at + len(rows)), np.arange(len(top.x)))
            top.cut()
        at, place, _ = top.cut()
        found += [[values[i] for i in x.tolist()] for x in np.split(place, np.searchsorted(at, np.arange(1, len(top.x))))]
    return [found[g] for g in group.tolist()]


def _directions(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; zeros where there is no direction."""
    return unit(np.where(np.isfinite(vectors).all(1, keepdims=True), vectors, 0.0))


def _with_vectors(df: DataFrame, attr: str, provider: ModelProvider, model: str) -> DataFrame:
    """``df`` with each text's vector; null for null."""

    def run(s: pd.Series) -> pd.Series:
        given = [x for x in s if x is not None]
        found = iter(np.asarray(provider.embed(given, model), dtype=float)) if given else iter(())
        return pd.Series([None if x is None else next(found).tolist() for x in s], dtype=object)

    return df.withColumn("__vector", F.pandas_udf(run, "array<double>").asNondeterministic()(col(attr)))


def _several(df: DataFrame, index: VectorIndex, attr: str, name: str, k: int, provider: ModelProvider, model: str) -> DataFrame:
    """Lists of texts: each text is a query of its own, and a row's results come back in its list's order."""
    rows = written(df.withColumn("__row", F.monotonically_increasing_id()), "topk-rows")  # row ids must be the same on both sides
    single = rows.select("__row", F.posexplode(col(attr)).alias("__nth", "__text"))
    found = _joined(_with_vectors(single, "__text", provider, model), index, "__vector", "__near", k)
    lists = found.groupBy("__row").agg(F.transform(F.array_sort(F.collect_list(F.struct("__nth", "__near"))), lambda x: x["__near"]).alias(name))
    none = F.when(F.size(col(attr)) == 0, F.array().cast("array<array<string>>"))
    return rows.join(lists, "__row", "left").withColumn(name, F.coalesce(name, none)).drop("__row")


def _joined(df: DataFrame, index: VectorIndex, search_attr: str, name: str, k: int, probes: int | None = None) -> DataFrame:
    """A large index is searched in cells (see ``cells``); a query without a direction gets what the small search gives it."""
    queries = df.withColumn("__q", F.monotonically_increasing_id())
    queries = written(queries, "topk-queries")  # ids must be the same in the search and in the join
    asked = queries.select(F.col("__q").alias("q"), col(search_attr).cast("array<double>").alias("vector"))
    hits = nearest(asked, index.df, k, probes)
    merged = hits.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("d"), "id", "value"))).alias("hits"))  # k rows a query at most
    return queries.join(merged.select(F.col("q").alias("__q"), F.transform("hits", lambda h: h["value"]).alias(name)), "__q", "left").drop("__q")
