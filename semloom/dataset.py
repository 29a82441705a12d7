"""The fluent, lazy dataset: each verb makes a new dataset over a logical plan; ``run`` plans, lowers and runs it."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import types as T

from .functions.groupby import GroupBySig
from .operators.topk import VectorIndex
from .plans import logical
from .plans.cost import CostModel
from .plans.logical import Node
from .plans.optimizer import Optimizer
from .session import Lowered, QueryProcessorConfig, lower
from .stats import ExecutionStats, stage_stats
from .types import make_schema


class Cardinality:
    ONE_TO_ONE = "one_to_one"
    ONE_TO_MANY = "one_to_many"


def _names(cols: str | list[str] | None) -> tuple[str, ...]:
    return () if cols is None else (cols,) if isinstance(cols, str) else tuple(cols)


class Dataset:
    """A lazy plan. Datasets are immutable; the same one may be used on several branches."""

    def __init__(self, node: Node, id: str | None = None):
        self.node = node
        self.id = id or node.plan_id

    # -- what it is ---------------------------------------------------------

    @property
    def schema(self) -> T.StructType:
        return self.node.schema

    @property
    def is_root(self) -> bool:
        return not self.node.children

    def copy(self) -> "Dataset":
        return Dataset(self.node, self.id)

    def relax_types(self) -> "Dataset":
        """The same plan with all fields that functions and models make as text, so that a value which doesn't fit its declared type is kept instead of null."""

        def relaxed(node: logical.Node) -> logical.Node:
            if not node.children:
                return node
            params = {k: v for k, v in node.params}
            if node.kind in ("map", "flat_map", "sem_map", "sem_flat_map") and not isinstance(params.get("udf"), dict):
                params["fields"] = T.StructType([T.StructField(f.name, T.StringType(), True, f.metadata) for f in params["fields"].fields])
            return replace(node, params=tuple(sorted(params.items()))).over(*(relaxed(c) for c in node.children))

        return Dataset(relaxed(self.node), self.id)

    def get_limit(self) -> int | None:
        """The limit at the end of the plan, else the least one before it, if there is any."""
        if self.node.kind == "limit":
            return self.node["n"]
        return min((n["n"] for n in self.node.walk() if n.kind == "limit"), default=None)

    def get_upstream_datasets(self) -> list["Dataset"]:
        """The datasets that this one is made from, inputs first."""
        return [Dataset(n) for n in self.node.walk()][:-1]

    def __iter__(self) -> Iterator["Dataset"]:
        return iter([Dataset(n) for n in self.node.walk()])

    @property
    def root_datasets(self) -> dict[str, "Dataset"]:
        return {(n["source"].id or n.plan_id): Dataset(n) for n in self.node.walk() if n.kind in ("scan", "context_scan")}

    def _with(self, kind: str, schema: T.StructType | None = None, depends_on=None, **params: Any) -> "Dataset":
        return Dataset(logical.make(kind, (self.node,), schema, _names(depends_on), **params))

    # -- relational verbs ------------------------------------------------------

    def filter(self, predicate: Callable[[dict], bool] | Column, depends_on: str | list[str] | None = None) -> "Dataset":
        """Rows for which a Column or a function of the row's dict holds."""
        if isinstance(predicate, str) or not (callable(predicate) or isinstance(predicate, Column)):
            raise TypeError("filter takes a function or a Column; sem_filter takes text")
        return self._with("filter", None, depends_on, predicate=predicate, udf=not isinstance(predicate, Column))

    def _mapped(self, kind: str, udf, cols, depends_on) -> "Dataset":
        if udf is None:
            raise ValueError(f"{kind} needs a function; sem_{kind} takes descriptions")
        return self._with(kind, None, depends_on, udf=udf, fields=make_schema(cols or []))

    def map(self, udf: Callable[[dict], dict] | dict[str, Column], cols: list[dict] | T.StructType | None = None, depends_on: str | list[str] | None = None) -> "Dataset":
        """One row for each row, with new columns; a dict of Columns stays in Catalyst."""
        return self._mapped("map", udf, cols, depends_on)

    def flat_map(self, udf: Callable[[dict], list[dict]], cols: list[dict] | T.StructType | None = None, depends_on: str | list[str] | None = None) -> "Dataset":
        """A row for each dict of the function's list; a row with nulls for none."""
        return self._mapped("flat_map", udf, cols, depends_on)

    def add_columns(self, udf, cols, cardinality: str = Cardinality.ONE_TO_ONE, depends_on=None) -> "Dataset":
        warnings.warn("add_columns is deprecated: use map or flat_map", DeprecationWarning, stacklevel=2)
        return (self.flat_map if cardinality == Cardinality.ONE_TO_MANY else self.map)(udf, cols, depends_on)

    def join(self, other: "Dataset", on: str | list[str], how: str = "inner") -> "Dataset":
        return Dataset(logical.join(self.node, other.node, how, _names(on)))

    def count(self) -> "Dataset":
        return Dataset(logical.aggregate(self.node, "count"))

    def average(self) -> "Dataset":
        return Dataset(logical.aggregate(self.node, "average"))

    def sum(self) -> "Dataset":
        return Dataset(logical.aggregate(self.node, "sum"))

    def min(self) -> "Dataset":
        return Dataset(logical.aggregate(self.node, "min"))

    def max(self) -> "Dataset":
        return Dataset(logical.aggregate(self.node, "max"))

    def groupby(self, sig: GroupBySig) -> "Dataset":
        return Dataset(logical.group_by(self.node, sig))

    def limit(self, n: int) -> "Dataset":
        return self._with("limit", None, n=int(n))

    def distinct(self, cols: str | list[str] | None = None) -> "Dataset":
        unknown = [c for c in _names(cols) if c not in self.schema.names]
        if unknown:
            raise AssertionError(f"distinct columns {unknown} aren't in the schema")
        return self._with("distinct", None, cols=_names(cols))

    def project(self, cols: str | list[str]) -> "Dataset":
        return self._with("project", None, cols=_names(cols))

    # -- semantic verbs --------------------------------------------------------

    def sem_filter(self, condition: str, desc: str | None = None, depends_on: str | list[str] | None = None) -> "Dataset":
        if not isinstance(condition, str):
            raise TypeError("sem_filter takes text; filter takes a function")
        return self._with("sem_filter", None, depends_on, condition=condition, desc=desc)

    def sem_map(self, cols: list[dict] | T.StructType, desc: str | None = None, depends_on: str | list[str] | None = None) -> "Dataset":
        return self._with("sem_map", None, depends_on, fields=make_schema(cols), desc=desc)

    def sem_flat_map(self, cols: list[dict] | T.StructType, desc: str | None = None, depends_on: str | list[str] | None = None) -> "Dataset":
        return self._with("sem_flat_map", None, depends_on, fields=make_schema(cols), desc=desc)

    def sem_add_columns(self, cols, cardinality: str = Cardinality.ONE_TO_ONE, desc=None, depends_on=None) -> "Dataset":
        warnings.warn("sem_add_columns is deprecated: use sem_map or sem_flat_map", DeprecationWarning, stacklevel=2)
        return (self.sem_flat_map if cardinality == Cardinality.ONE_TO_MANY else self.sem_map)(cols, desc, depends_on)

    def sem_join(self, other: "Dataset", condition: str, desc: str | None = None, depends_on: str | list[str] | None = None, how: str = "inner") -> "Dataset":
        return Dataset(logical.join(self.node, other.node, how, (), condition, _names(depends_on), desc))

    def sem_agg(self, col: dict | T.StructType, agg: str, depends_on: str | list[str] | None = None) -> "Dataset":
        fields = make_schema([col] if isinstance(col, dict) else col)
        if len(fields.fields) != 1:
            raise ValueError("sem_agg makes exactly one field")
        return self._with("sem_agg", fields, depends_on, fields=fields, instruction=agg)

    def sem_topk(self, index: VectorIndex, search_attr: str, output_attrs: list[dict] | T.StructType, search_func: Callable | None = None, k: int = -1) -> "Dataset":
        if search_attr not in self.schema.names:
            raise ValueError(f"no field {search_attr} to search by")
        return self._with("topk", None, index=index, search_attr=search_attr, fields=make_schema(output_attrs), search_func=search_func, k=k)

    # -- running ---------------------------------------------------------------

    def plan(self, config: QueryProcessorConfig | None = None, **kwargs: Any):
        """The physical plan that ``run`` would use."""
        config = QueryProcessorConfig.of(config, **kwargs)
        return self._optimizer(config).optimize(self.node)

    def _optimizer(self, config: QueryProcessorConfig, costs: CostModel | None = None, allowed=None, strategy: str | None = None) -> Optimizer:
        return Optimizer(config.policy, config.options(), costs, strategy or config.optimizer_strategy, config.execution_strategy == "parallel", config.use_final_op_quality, allowed)

    def to_spark(self, config: QueryProcessorConfig | None = None, **kwargs: Any) -> DataFrame:
        """The lazy DataFrame of the plan, for writing or further work in Spark."""
        return self.run(config, **kwargs).df

    def run(self, config: QueryProcessorConfig | None = None, spark: SparkSession | None = None, **kwargs: Any) -> "DataRecordCollection":
        config = QueryProcessorConfig.of(config, **kwargs)
        began = time.time()
        plan = self._optimizer(config).optimize(self.node)
        return _start(plan, config, spark, ExecutionStats(optimization_seconds=time.time() - began))

    def optimize_and_run(self, config: QueryProcessorConfig | None = None, train_dataset: "Dataset | dict[str, Dataset] | None" = None, validator=None, spark: SparkSession | None = None, **kwargs: Any) -> "DataRecordCollection":
        """Try the operators' implementations on training rows, then plan with what was measured, and run."""
        from .sampling import Validator, sample_and_measure

        config = QueryProcessorConfig.of(config, **kwargs)
        if train_dataset is None and validator is None:
            raise ValueError("give training data or a validator")
        roots = self.root_datasets
        if isinstance(train_dataset, Dataset):
            if len(roots) > 1:
                raise ValueError("a plan with several roots needs a dict of training datasets")
            train_dataset = {next(iter(roots)): train_dataset}
        began = time.time()
        session = spark or SparkSession.builder.getOrCreate()
        sampled = sample_and_measure(self.node, train_dataset or roots, validator or Validator(), config, session)
        stats = ExecutionStats(optimization_cost=sampled.cost, optimization_calls=sampled.calls)
        plan = self._optimizer(config, CostModel(sampled.measured), sampled.kept).optimize(self.node)
        stats.optimization_seconds = time.time() - began
        return _start(plan, config, session, stats)


def _start(plan, config: QueryProcessorConfig, spark: SparkSession | None, stats: ExecutionStats) -> "DataRecordCollection":
    lowered = lower(spark or SparkSession.builder.getOrCreate(), plan, config)
    stats.plan = plan.describe()
    stats.estimated = {"cost": plan.cost.cost, "time": plan.cost.time, "quality": plan.cost.quality}
    return DataRecordCollection(lowered, stats)


class DataRecordCollection:
    """The result of a run: a lazy DataFrame, its rows, and statistics."""

    def __init__(self, lowered: Lowered, stats: ExecutionStats):
        self._lowered, self._stats, self._counted = lowered, stats, False

    @property
    def df(self) -> DataFrame:
        return self._lowered.df

    def __iter__(self) -> Iterator[Row]:
        return self.df.toLocalIterator()

    def __len__(self) -> int:
        return self.df.count()

    def to_df(self, cols: list[str] | None = None):
        """A pandas frame."""
        began = time.time()
        frame = (self.df.select(*cols) if cols else self.df).toPandas()
        self._stats.plan_seconds = time.time() - began
        return frame

    @property
    def execution_stats(self) -> ExecutionStats:
        """Calls, tokens and cost, from the log of the requests that this run made."""
        if not self._counted:
            self._stats.operators = [stage_stats(s) for s in self._lowered.stages]
            self._counted = True
        return self._stats

    def release(self) -> None:
        self._lowered.release()
