"""Relational operators as DataFrame operations; Catalyst does the rest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.groupby import GroupBySig
from ..types import union_schemas


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def with_places(df: DataFrame, name: str) -> DataFrame:
    """``df`` with each row's place from 0, counted from the partitions' sizes: no sort, and one row a partition is broadcast."""
    part = "__part"
    numbered = df.withColumn(part, F.spark_partition_id()).withColumn(name, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = df.groupBy(F.spark_partition_id().alias(part)).agg(F.count(F.lit(1)).alias("__size"))
    starts = sizes.select(part, (F.sum("__size").over(Window.orderBy(part)) - F.col("__size")).alias("__start"))
    placed = numbered.join(F.broadcast(starts), part)
    return placed.select(*[col(c) for c in df.columns], (F.col("__start") + col(name)).alias(name))


def project(df: DataFrame, cols: list[str]) -> DataFrame:
    """The named columns in the frame's order."""
    wanted = {c.rsplit(".", 1)[-1] for c in cols}
    return df.select(*[col(c) for c in df.columns if c in wanted])


def filter_rows(df: DataFrame, predicate, depends_on: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose predicate holds: a Column goes to Catalyst; a Python function gets a dict and counts by its truth."""
    if isinstance(predicate, Column):
        return df.where(predicate)
    names = list(depends_on) or df.columns

    def test(given: pa.Array) -> pa.Array:
        return pa.array([bool(predicate(r)) for r in _dicts(given)], pa.bool_())

    return df.where(F.arrow_udf(test, T.BooleanType()).asNondeterministic()(F.struct(*[col(n) for n in names])))


def _dicts(given: pa.StructArray):
    """The rows of a batch as dicts, read column by column."""
    names = [f.name for f in given.type]
    for values in zip(*(c.to_pylist(maps_as_pydicts="lossy") for c in given.flatten()), strict=True):
        yield dict(zip(names, values, strict=True))


def _fit(value, kind: pa.DataType):
    """A value as the declared type; None if it isn't one."""
    if value is None:
        return None
    try:
        if pa.types.is_string(kind):
            return str(value)
        if pa.types.is_integer(kind):
            return int(value) if int(value) == value else None
        if pa.types.is_floating(kind):
            return float(value)
        if pa.types.is_list(kind):
            return [_fit(x, kind.value_type) for x in value]
        return pa.scalar(value, kind).as_py()
    except (TypeError, ValueError, pa.ArrowException):
        return None


def fitted(values: list, kind: pa.DataType) -> pa.Array:
    """Values as an array of the declared type; null where one isn't of it."""
    try:
        return pa.array(values, kind)
    except (pa.ArrowException, TypeError, ValueError):
        return pa.array([_fit(v, kind) for v in values], kind)


def map_rows(df: DataFrame, function, fields: T.StructType, many: bool = False, depends_on: tuple[str, ...] = ()) -> DataFrame:
    """New columns from a function of the row: a dict, or with ``many`` a list of dicts.

    A dict of Columns stays in Catalyst. Existing columns keep their values. A
    one-to-one result without a declared field is an error, in a one-to-many
    result it is null; no results at all leave one row with nulls.
    """
    new = [f for f in fields.fields if f.name not in df.columns]
    if isinstance(function, dict):
        return df.select("*", *[function[f.name].cast(f.dataType).alias(f.name) for f in new])
    names = list(depends_on) or df.columns
    shape = T.StructType([T.StructField(f.name, f.dataType, True) for f in new])
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in new]

    def one(row):
        got = function(row)
        if new and not isinstance(got, dict):
            raise TypeError("a one-to-one function must return a dict")
        return got

    def several(row):
        got = function(row)
        if not isinstance(got, list):
            raise TypeError("a one-to-many function must return a list of dicts")
        return got

    def ones(given: pa.Array) -> pa.Array:
        got = [one(r) for r in _dicts(given)]
        return pa.StructArray.from_arrays([fitted([g[n] for g in got], k) for n, k in kinds], [n for n, _ in kinds])

    def lists(given: pa.Array) -> pa.Array:
        got = [several(r) for r in _dicts(given)]
        flat = [x for g in got for x in g]
        rows = pa.StructArray.from_arrays([fitted([x.get(n) for x in flat], k) for n, k in kinds], [n for n, _ in kinds])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(g) for g in got])), pa.int32()), rows)

    def ran(given: pa.Array) -> pa.Array:
        for r in _dicts(given):
            function(r)
        return pa.array([True] * len(given))

    given = F.struct(*[col(n) for n in names])
    if not new:  # for its side effect
        return df.where(F.arrow_udf(ran, T.BooleanType()).asNondeterministic()(given))
    if many:
        return df.select("*", F.inline_outer(F.arrow_udf(lists, T.ArrayType(shape)).asNondeterministic()(given)))
    out = df.select("*", F.arrow_udf(ones, shape).asNondeterministic()(given).alias("__made"))
    return out.select(*[col(c) for c in df.columns], *[F.col("__made")[f.name].alias(f.name) for f in new])


def join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named columns: null equals null, NaN equals nothing; clashing other columns get ``_right``."""
    schema = union_schemas([left.schema, right.schema], join=True, on=on)
    rest = [c for c in right.columns if c not in on]
    names = schema.names[len(left.columns) :]
    keys = [f"__right_{k}" for k in on]
    renamed = right.select(*[col(k).alias(r) for k, r in zip(on, keys, strict=True)], *[col(c).alias(n) for c, n in zip(rest, names, strict=True)], F.lit(True).alias("__is_right"))
    tagged = left.select("*", F.lit(True).alias("__is_left"))
    condition = F.lit(True)
    for k, r in zip(on, keys, strict=True):
        condition = condition & tagged[f"`{k}`"].eqNullSafe(renamed[r])
        if any(isinstance(s[k].dataType, (T.FloatType, T.DoubleType)) for s in (left.schema, right.schema)):
            condition = condition & ~F.coalesce(F.isnan(tagged[f"`{k}`"].cast("double")), F.lit(False))
    both = tagged.join(renamed, condition, {"outer": "full"}.get(how, how))
    merged = [F.when(F.col("__is_left").isNull(), F.col(keys[on.index(c)])).otherwise(col(c)).alias(c) if c in on and how in ("right", "outer") else col(c) for c in left.columns]
    return both.select(*merged, *[col(n) for n in names])


def _number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    return col(name).cast("double") if isinstance(kind, (T.NumericType, T.BooleanType)) else F.expr(f"try_cast(`{name}` as double)")


def aggregate(df: DataFrame, func: str) -> DataFrame:
    """One row: count of rows, or average, sum, min or max of the only column; values that are no numbers are passed over."""
    if func == "count":
        return df.agg(F.count(F.lit(1)).alias("count"))
    name = df.columns[0]
    kind = df.schema[name].dataType
    whole = isinstance(kind, (T.IntegralType, T.BooleanType))
    value = col(name).cast("long") if whole and func != "average" else _number(df, name)
    return df.agg({"average": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[func](value).alias(func))


def _grouped(df: DataFrame, func: str, name: str) -> Column:
    kind = df.schema[name].dataType
    value = col(name)
    nested = isinstance(kind, T.ArrayType)
    plain = kind.elementType if nested else kind
    if func == "count":
        return F.count(F.lit(1))
    if func == "average":
        if nested:
            raise TypeError(f"average takes no lists, and {name} holds lists")
        return F.avg(_number(df, name))
    if func == "sum":
        to = "long" if isinstance(plain, (T.IntegralType, T.BooleanType)) else "double"
        if nested:
            value = F.aggregate(value, F.lit(0).cast(to), lambda s, x: s + F.coalesce(x.cast(to), F.lit(0).cast(to)))
        elif not isinstance(plain, (T.NumericType, T.BooleanType)):
            value = _number(df, name)
        return F.coalesce(F.sum(value.cast(to)), F.lit(0).cast(to))
    if func == "min":
        return F.min(F.array_min(value) if nested else value)
    if func == "max":
        return F.max(F.array_max(value) if nested else value)
    held = F.struct(value.alias("v"))  # a struct keeps nulls, which collecting drops
    if func == "list":
        return F.transform(F.collect_list(held), lambda s: s["v"])
    return F.transform(F.array_sort(F.collect_set(held)), lambda s: s["v"])


def group_by(df: DataFrame, sig: GroupBySig) -> DataFrame:
    """Groups with null as a key; without keys, one group, and no row for no input."""
    made = [_grouped(df, f.lower(), n).alias(label) for f, n, label in zip(sig.agg_funcs, sig.agg_fields, sig.get_agg_field_names(), strict=True)]
    if not sig.group_by_fields:
        return df.groupBy(F.lit(1).alias("__all")).agg(*made).drop("__all")
    keys = [col(k).alias(k) for k in sig.group_by_fields]
    return df.groupBy(*keys).agg(*made) if made else df.select(*keys).distinct()


def distinct(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Whole rows once each, or one row for each value of the columns (see ``first_rows``)."""
    for c in cols or ():
        if c not in df.columns:
            raise ValueError(f"no column {c} to tell rows apart")
    return first_rows(df, cols, None) if cols else df.distinct()


def first_rows(df: DataFrame, cols: list[str], ordinal: str | None) -> DataFrame:
    """One whole row for each value of the columns: the first by the ``ordinal`` column, which goes.

    A frame has no order of its own once it is shuffled, so without an ordinal the row with the least
    other values is taken, column by column: the same one however rows are dealt.
    """
    rest = [c for c in df.columns if c not in cols and c != ordinal]
    if not rest:
        return df.select(*[col(c) for c in df.columns if c != ordinal]).distinct()
    order = col(ordinal) if ordinal else F.struct(*[_orderable(df, c) for c in rest])
    kept = df.groupBy(*[col(c).alias(c) for c in cols]).agg(F.min_by(F.struct(*[col(c) for c in rest]), order).alias("__first"))
    return kept.select(*[col(c) if c in cols else F.col("__first")[c].alias(c) for c in df.columns if c != ordinal])


def _orderable(df: DataFrame, name: str) -> Column:
    """A column as it can be compared; maps by their text."""
    return (F.to_json(col(name)) if "map<" in df.schema[name].dataType.simpleString() else col(name)).alias(name)
