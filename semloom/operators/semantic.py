"""Semantic operators: one Arrow stage per operator calls the provider for batches of requests.

With a request log, an operator's distinct inputs are asked for once, in a job of their own, and rows get
their answers by a join (see ``ledger``). Without one, as on streams, the stage runs in place: it gets the fields
that the operator reads, as one struct, while all other columns stay in the JVM; its function is
marked nondeterministic, so Catalyst neither repeats it nor moves filters into it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.models import register, registered
from ..plans.physical import Implementation
from ..shared import written
from ..types import union_schemas
from . import cells
from .ledger import SPENT, STATS, RequestLog, content_key
from .provider import ModelProvider, Request
from .relational import col
from .strategies import extracted, extracted_many, verdicts

BATCH = 64
_SPENT_TYPE = f"struct<{SPENT.replace(' ', ':').replace(',:', ',')}>"


def _stage(read: list[str], call: Callable[[list[dict]], tuple[list, list]], batch: int = BATCH) -> Callable[[Column], Column]:
    """A column function over the struct of read fields: struct<answer, statistics, error>. JSON carries all answers."""

    cards = registered()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        for c in cards:
            register(c)
        rows = [{n: _plain(v) for n, v in zip(read, values, strict=True)} for values in zip(*(frame[n] for n in read), strict=True)] if read else [{} for _ in range(len(frame))]
        answers, spent = [], []
        for i in range(0, len(rows), batch):
            said, took = call(rows[i : i + batch])
            answers += said
            spent += took
        out = pd.DataFrame({"answer": pd.Series([None if a is None else a if isinstance(a, str) else json.dumps(a) for a in answers], dtype=object)})
        for k in STATS:
            out[k] = [getattr(s, k) for s in spent]
        out["error"] = pd.Series([s.error for s in spent], dtype=object)
        return out

    return F.pandas_udf(run, f"answer string, {SPENT}, error string").asNondeterministic()


def _plain(v):
    if isinstance(v, np.ndarray):
        return [_plain(x) for x in v]
    if isinstance(v, np.generic):
        v = v.item()
    return None if isinstance(v, float) and v != v else v


def media_of(schemas: list[T.StructType], names: list[str]) -> tuple[tuple[str, str, str], ...]:
    """Name, kind (image or audio) and form (path, base64, url) of the named fields that aren't text."""
    return tuple((f.name, f.metadata["modality"], f.metadata.get("form", "base64")) for s in schemas for f in s.fields if f.name in names and "modality" in f.metadata)


def _given(df: DataFrame, names: list[str]) -> Column:
    return F.struct(*[col(n) for n in names]) if names else F.struct(F.lit(0).alias("__none"))


def _answered(df: DataFrame, read: list[str], call, batch: int, log: RequestLog | None, stage: str | None, workers: int | None) -> DataFrame:
    """``df`` with the ``__answer`` of each row's request, and with ``__stats`` where it is asked in place."""
    asking = _stage(read, call, batch)
    if log is None:
        asked = df.select("*", asking(_given(df, read)).alias("__reply"))
        return asked.select(*[col(c) for c in df.columns], F.col("__reply.answer").alias("__answer"), F.struct(*[F.col("__reply")[k].alias(k) for k in STATS]).alias("__stats"))
    keyed = df.withColumn("__key", content_key(df, read))
    wanted = keyed.groupBy(F.col("__key").alias("key")).agg(F.first(_given(df, read)).alias("given"))
    log.ask(stage, wanted, asking, F.col("given"), workers)
    found = log.answers(stage).select(F.col("key").alias("__key"), F.col("answer").alias("__said"), F.lit(True).alias("__found"))
    said = F.when(F.col("__found"), F.col("__said")).otherwise(F.raise_error("a record isn't in the request log: the operator's input gives other values when it is computed again"))
    return keyed.join(found, "__key", "left").select(*[col(c) for c in df.columns], said.alias("__answer"), F.lit(None).cast(_SPENT_TYPE).alias("__stats"))


def sem_filter(df: DataFrame, condition: str, provider: ModelProvider, impl: Implementation, depends_on: list[str] | None = None, batch: int = BATCH, log: RequestLog | None = None, stage: str | None = None, workers: int | None = None) -> DataFrame:
    """``df`` with ``__passed`` and ``__stats``; a failed call doesn't pass."""
    read = list(depends_on) if depends_on else df.columns

    media = media_of([df.schema], read)

    def call(rows):
        return verdicts(provider, impl, [Request("filter", condition, r, media=media) for r in rows])

    done = _answered(df, read, call, batch, log, stage, workers)
    return done.select(*[col(c) for c in df.columns], F.coalesce(F.col("__answer") == "true", F.lit(False)).alias("__passed"), "__stats")


def _typed(value: Column, kind: T.DataType) -> Column:
    """A JSON value's text as the declared type, null if it isn't one."""
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        wrapped = F.when(value.startswith("["), value).otherwise(F.concat(F.lit("["), value, F.lit("]"))) if isinstance(kind, T.ArrayType) else value
        return F.from_json(wrapped, kind)
    if isinstance(kind, T.BooleanType):
        return F.lower(value).try_cast(kind)
    return value.try_cast(kind)


def sem_map(df: DataFrame, fields: T.StructType, provider: ModelProvider, impl: Implementation, depends_on: list[str] | None = None, many: bool = False, desc: str | None = None, batch: int = BATCH, log: RequestLog | None = None, stage: str | None = None, workers: int | None = None) -> DataFrame:
    """``df`` with the asked fields and ``__stats``; of a one-to-many answer each record makes a row, and none makes one with nulls."""
    new = [f for f in fields.fields if f.name not in df.columns]
    read = list(depends_on) if depends_on else df.columns
    asked = tuple((f.name, f.metadata.get("comment", "")) for f in new)
    verb, media = "flat_map" if many else "map", media_of([df.schema], read)
    instruction = desc or "; ".join(d for _, d in asked)

    def call(rows):
        found, spent = (extracted_many if many else extracted)(provider, impl, [Request(verb, instruction, r, asked, media=media) for r in rows])
        flat = [[{k: _text(v) for k, v in x.items()} for x in (f if many else [f])] for f in found]
        lost = [s.error and all(v is None for x in f for v in x.values()) for f, s in zip(flat, spent, strict=True)]
        return [None if gone else json.dumps(f, ensure_ascii=False) for f, gone in zip(flat, lost, strict=True)], spent

    shape = T.ArrayType(T.StructType([T.StructField(f.name, T.StringType()) for f in new]))
    out = _answered(df, read, call, batch, log, stage, workers)
    out = out.select(*[col(c) for c in df.columns], "__stats", F.from_json(F.col("__answer"), shape).alias("__rows"))
    if many:  # the call's stats stay with its first row
        out = out.select(*[col(c) for c in df.columns], "__stats", F.posexplode_outer("__rows").alias("__at", "__row"))
        out = out.withColumn("__stats", F.when(F.coalesce("__at", F.lit(0)) == 0, F.col("__stats")))
    else:
        out = out.select(*[col(c) for c in df.columns], "__stats", F.col("__rows")[0].alias("__row"))
    return out.select(*[col(c) for c in df.columns], *[_typed(F.col("__row")[f.name], f.dataType).alias(f.name, metadata=f.metadata) for f in new], "__stats")


def _text(v) -> str | None:
    return None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def sem_agg(df: DataFrame, field: T.StructField, instruction: str, provider: ModelProvider, impl: Implementation, depends_on: list[str] | None = None, per_call: int = 500) -> tuple[DataFrame, DataFrame]:
    """One row with one field over all records (no row for no input), and the calls' statistics.

    Records are read in calls of ``per_call``, each partition by itself; then a tree of merges grows
    from the number of answers: each level deals them by a hash into groups of about ``per_call``, each of
    which is one task's turn and one call (two, where the hash gave it more), until one answer is left. Every level is written, so a lost
    executor repeats the calls of its running tasks only.
    """
    if per_call < 2:
        raise ValueError("a call must take two records or more")
    read = list(depends_on) if depends_on else df.columns
    asked = ((field.name, field.metadata.get("comment", "")),)
    names, cards = ["answer", *STATS], registered()
    schema = f"answer string, {SPENT}"

    def answer(requests: list[Request]) -> pa.RecordBatch:
        for c in cards:
            register(c)
        found, spent = extracted(provider, impl, requests)
        return pa.RecordBatch.from_arrays([pa.array([_text(f[field.name]) for f in found], pa.string()), *[pa.array([getattr(s, k) for s in spent], pa.int64() if k in ("calls", "failures") else pa.float64()) for k in STATS]], names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            held += b.to_pylist()
            while len(held) >= per_call:
                yield answer([Request("agg", instruction, {"records": held[:per_call]}, asked)])
                held = held[per_call:]
        if held:
            yield answer([Request("agg", instruction, {"records": held}, asked)])

    def merged(group: pa.Table) -> pa.Table:
        held = group["answer"].to_pylist()
        parts = [held[i : i + per_call] for i in range(0, len(held), per_call)]
        asks = [Request("agg", instruction, {"partial": p}, asked, stage="merge", prior=tuple(json.dumps({field.name: x}) for x in p)) for p in parts]
        return pa.Table.from_batches([answer(asks)])

    level = written(df.select(*[col(n) for n in read]).mapInArrow(first, schema), "agg")
    spent, n = level, level.count()
    while n > 1:
        dealt = level.select("answer", F.pmod(F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(-(-n // per_call))).alias("group"))
        level = written(dealt.groupBy("group").applyInArrow(merged, schema), "agg")
        spent, n = spent.union(level), level.count()
    return level.select(_typed(F.col("answer"), field.dataType).alias(field.name, metadata=field.metadata)), spent.select(*STATS)


def embedded(df: DataFrame, names: list[str], provider: ModelProvider, model: str, out: str) -> DataFrame:
    """``df`` with the vector of the named fields' joined text."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([v.tolist() for v in np.asarray(provider.embed([x or "" for x in s], model), dtype=float)])

    vector = F.pandas_udf(run, "array<double>").asNondeterministic()
    return df.withColumn(out, vector(F.concat_ws(" ", *[col(n).cast("string") for n in names])))


def sem_join(left: DataFrame, right: DataFrame, condition: str, how: str, provider: ModelProvider, impl: Implementation, depends_on: list[str] | None = None, block: Callable[[DataFrame, DataFrame], Column] | None = None, batch: int = BATCH, log: RequestLog | None = None, stage: str | None = None, workers: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The join's rows, and the requests of the judged pairs, as the log has them.

    Pairs of distinct inputs are judged, not pairs of rows: each side's values of the read fields come
    once, and a pair is a request of the log. All pairs are, since the provider may match any two
    records, without a ``block`` condition, which makes it an equi- or band join of rows.
    With an embedding implementation, the first ``samples`` pairs by the hashes of their sides
    are judged to learn a similarity under which none matches and one over
    which all do; pairs under the first are never formed (see ``cells``), those over the second match
    unasked, and the others are judged. Unmatched rows come back by an anti join with the matches.
    """
    schema = union_schemas([left.schema, right.schema], join=True)
    names = schema.names[len(left.columns) :]
    log = log or RequestLog(left.sparkSession)
    stage = stage or log.stage("join", condition, impl.key)
    renamed = right.select(*[col(c).alias(n) for c, n in zip(right.columns, names, strict=True)])
    read = list(depends_on) if depends_on else schema.names
    l_read, r_read = [n for n in left.columns if n in read], [n for n in names if n in read or n.removesuffix("_right") in read]
    a, b = left.withColumn("__l", content_key(left, l_read)), renamed.withColumn("__r", content_key(renamed, r_read))
    l_once = a.groupBy("__l").agg(*[F.first(col(n)).alias(n) for n in l_read])
    r_once = b.groupBy("__r").agg(*[F.first(col(n)).alias(n) for n in r_read])
    judge, media = Implementation("nested", impl.models), media_of([left.schema, renamed.schema], [*l_read, *r_read])

    def call(rows):
        return verdicts(provider, judge, [Request("join", condition, r, media=media) for r in rows])

    def ask(pairs: DataFrame) -> DataFrame:
        """The verdicts of pairs (__l, __r): (__l, __r, match)."""
        given = pairs.join(l_once, "__l").join(r_once, "__r")
        key = F.unhex(F.sha2(F.concat("__l", "__r"), 256))
        wanted = given.select(key.alias("key"), F.col("__l").alias("left"), F.col("__r").alias("right"), F.struct(*[col(n) for n in [*l_read, *r_read]]).alias("given"))
        log.ask(stage, wanted, _stage([*l_read, *r_read], call, batch), F.col("given"), workers)
        asked = pairs.withColumn("key", key).join(log.answers(stage).select("key", "answer"), "key")
        return asked.select("__l", "__r", (F.col("answer") == "true").alias("match"))

    keys = a.join(b, block(a, b)).select("__l", "__r").distinct() if block else l_once.select("__l").crossJoin(r_once.select("__r"))
    if impl.kind == "embedding":
        lv = written(embedded(l_once, l_read, provider, impl.get("embedder"), "vector").select("__l", "vector"), "join-left")
        rv = written(embedded(r_once, r_read, provider, impl.get("embedder"), "vector").select("__r", "vector"), "join-right")
        few = impl.get("samples")
        if block:
            sample = keys.orderBy("__l", "__r").limit(few)
        else:  # the first pairs are pairs of the first records
            sample = lv.select("__l").orderBy("__l").limit(few).crossJoin(rv.select("__r").orderBy("__r").limit(few)).orderBy("__l", "__r").limit(few)
        seen = cells.similarities(ask(written(sample, "join-sample")), lv, rv).collect()
        low, high = thresholds([(r["sim"] or 0.0, bool(r["match"])) for r in seen])
        near = cells.similarities(keys, lv, rv) if block else cells.pairs_over(lv, rv, low)
        near = written(near.where(F.col("sim").isNull() | (F.col("sim") >= low)), "join-pairs")
        sure = F.coalesce(F.col("sim") > high, F.lit(False))
        matched = near.where(sure).select("__l", "__r").union(ask(near.where(~sure).select("__l", "__r")).where("match").select("__l", "__r"))
    else:
        matched = ask(keys).where("match").select("__l", "__r")
    matched = written(matched, "join-matches")

    def rows_of(side: DataFrame, key: str) -> DataFrame:
        """A side's rows with the other side's keys that they match."""
        return side.join(matched, key)

    near_b, near_a = rows_of(b, "__r"), rows_of(a, "__l")
    wanted = [*left.columns, *names]
    same = a["__l"] == near_b["__l"]
    out = a.join(near_b, same & block(a, near_b) if block else same).select(*[a[f"`{c}`"] for c in left.columns], *[near_b[f"`{n}`"] for n in names])
    if how in ("left", "outer"):
        alone = a.join(near_b, same & block(a, near_b) if block else same, "left_anti")
        out = out.unionByName(alone.select(*[col(c) for c in left.columns], *[F.lit(None).cast(schema[n].dataType).alias(n) for n in names]))
    if how in ("right", "outer"):
        same = b["__r"] == near_a["__r"]
        alone = b.join(near_a, same & block(near_a, b) if block else same, "left_anti")
        out = out.unionByName(alone.select(*[F.lit(None).cast(schema[c].dataType).alias(c) for c in left.columns], *[col(n) for n in names]))
    return out.select(*[col(c) for c in wanted]), log.calls(stage)


def thresholds(sample: list[tuple[float, bool]]) -> tuple[float, float]:
    """The similarity under which the sample has no match, and the one over which it has only matches."""
    low, high = float("-inf"), float("inf")
    for sim, match in sorted(sample):
        if match:
            break
        low = sim
    for sim, match in sorted(sample, reverse=True):
        if not match:
            break
        high = sim
    return low, high
