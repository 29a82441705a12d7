"""Run configuration, and the lowering of a chosen plan to one DataFrame."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import relational, semantic
from .operators.ledger import STATS, RequestLog
from .operators.provider import LocalProvider, ModelProvider
from .operators.topk import sem_topk
from .plans.logical import Node
from .plans.models import CARDS, ModelCard, choose_models, get_model
from .plans.optimizer import PhysicalPlan
from .plans.physical import Options
from .plans.policy import MaxQuality, Policy

#: Verbs that give rows from one row each, and those of them that ask a model.
ROW_WISE = ("filter", "map", "flat_map", "project", "topk", "sem_filter", "sem_map", "sem_flat_map")
ASKING = ("sem_filter", "sem_map", "sem_flat_map")
#: Rows that a limit's first round may take through the driver, how much each later round grows, and hash values that rounds are cut by.
FIRST_ROWS, GROWTH, HASHES = 2048, 4, 1 << 20
ORDINAL = "__ordinal"


@dataclass
class QueryProcessorConfig:
    """How a query is planned and run."""

    policy: Policy = field(default_factory=MaxQuality)
    optimizer_strategy: str = "pareto"  # pareto, greedy, none
    execution_strategy: str = "parallel"  # sequential, pipelined, parallel: how plan times add up; Spark runs either way in parallel
    sentinel_execution_strategy: str = "auto"  # auto, mab, all
    provider: ModelProvider | None = None
    available_models: list[ModelCard | str] | None = None
    remove_models: list[ModelCard | str] | None = None
    enforce_types: bool = False
    scan_start_idx: int = 0
    num_samples: int | None = None
    batch_size: int | None = None
    max_workers: int | None = None  # tasks that a semantic stage's requests are dealt over
    request_log: str | None = None  # a folder whose answers later runs reuse; else each run has its own
    allow_model_selection: bool = True
    allow_bonded_query: bool = True
    allow_rag_reduction: bool = True
    allow_mixtures: bool = True
    allow_critic: bool = True
    allow_split_merge: bool = False
    use_final_op_quality: bool = False
    k: int = 6
    j: int = 4
    sample_budget: int = 100
    sample_cost_budget: float | None = None
    seed: int = 42
    priors: dict | None = None
    verbose: bool = False

    def __post_init__(self):
        for name, allowed in (("optimizer_strategy", ("pareto", "greedy", "none")), ("execution_strategy", ("sequential", "pipelined", "parallel")), ("sentinel_execution_strategy", ("auto", "mab", "all"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        if isinstance(self.policy, str) or not isinstance(self.policy, Policy):
            raise ValueError("policy must be a Policy")

    @staticmethod
    def of(config: "QueryProcessorConfig | None" = None, **kwargs) -> "QueryProcessorConfig":
        """A configuration with keyword changes; policy keywords (max_quality=True, cost_budget=1.0, ...) make its policy."""
        wanted = {k: kwargs.pop(k) for k in ("max_quality", "min_cost", "min_time", "cost_budget", "time_budget", "quality_threshold") if k in kwargs}
        base = {f.name: getattr(config, f.name) for f in fields(QueryProcessorConfig)} if config else {}
        if wanted:
            base["policy"] = Policy.from_kwargs(**wanted)
        return QueryProcessorConfig(**(base | kwargs))

    def options(self) -> Options:
        cards = [get_model(m) for m in self.available_models] if self.available_models else list(CARDS.values())
        gone = {get_model(m).name for m in self.remove_models or ()}
        cards = [c for c in cards if c.name not in gone]
        talk = [c for c in cards if not c.embeds]
        if not talk:
            raise ValueError("no available model answers requests")
        if self.optimizer_strategy == "none" or not self.allow_model_selection:
            talk = talk[:1]
        else:
            talk = choose_models(talk, self.policy)
        embed = [c for c in cards if c.embeds] or [c for c in CARDS.values() if c.embeds]
        return Options(tuple(talk), tuple(embed), self.allow_bonded_query, self.allow_rag_reduction, self.allow_mixtures, self.allow_critic, self.allow_split_merge)

    def model_provider(self) -> ModelProvider:
        return self.provider or LocalProvider()


@dataclass
class Stage:
    """A semantic operator as it ran: the rows that came out of it, and the requests made for it."""

    op_id: str
    implementation: str
    rows: DataFrame
    calls: DataFrame


@dataclass
class Lowered:
    """The frame of a plan, its semantic stages, and the log with the answers that the frame reads."""

    df: DataFrame
    stages: list[Stage] = field(default_factory=list)
    log: RequestLog | None = None

    def release(self) -> None:
        """Delete the answers of this run, after which the frame can't be computed any more."""
        if self.log is not None:
            self.log.release()


def load(spark: SparkSession, node: Node, config: QueryProcessorConfig) -> DataFrame:
    """A scan's frame: its source's, with the schema's columns; start and count cut it by place."""
    df = node["source"].load(spark)
    missing = [n for n in node.schema.names if n not in df.columns]
    if missing:
        raise KeyError(f"the source lacks fields {missing}")
    df = df.select(*[relational.col(n) for n in node.schema.names])
    if config.scan_start_idx or config.num_samples is not None:
        df = relational.with_places(df, "__at").where(F.col("__at") >= config.scan_start_idx)
        if config.num_samples is not None:
            df = df.where(F.col("__at") < config.scan_start_idx + config.num_samples)
        df = df.drop("__at")
    return df


def lower(spark: SparkSession, plan: PhysicalPlan, config: QueryProcessorConfig, in_place: bool = False) -> Lowered:
    """One DataFrame for a physical plan.

    Semantic stages make their calls now, once for each distinct input, and the frame reads
    their answers from the log; ``in_place`` makes the calls part of the frame instead, as streams need.
    """
    return _Lowering(spark, config, in_place).run(plan)


class _Lowering:
    def __init__(self, spark: SparkSession, config: QueryProcessorConfig, in_place: bool):
        self.spark, self.config, self.in_place = spark, config, in_place
        self.provider = config.model_provider()
        self.batch = config.batch_size or semantic.BATCH
        self.log: RequestLog | None = None
        self.stages: dict[tuple, Stage] = {}
        self.done: dict[tuple, DataFrame] = {}

    def run(self, plan: PhysicalPlan) -> Lowered:
        df = self.go(plan)
        if self.config.enforce_types:
            wrong = [f.name for f in plan.node.schema.fields if f.name in df.columns and df.schema[f.name].dataType != f.dataType]
            if wrong:
                raise TypeError(f"columns {wrong} don't have their declared types")
        return Lowered(df, list(self.stages.values()), self.log)

    def go(self, p: PhysicalPlan) -> DataFrame:
        """A branch that several operators use is lowered once."""
        key = (p.node.plan_id, *(x.impl.key for x in p.walk()))
        if key not in self.done:
            if p.node.kind == "limit" and not self.in_place:
                self.done[key] = self.limited(p)
            elif p.node.kind == "distinct" and p.node["cols"]:
                self.done[key] = self.distinct(p)
            else:
                self.done[key] = self.apply(p, [self.go(x) for x in p.inputs])
        return self.done[key]

    def logged(self, p: PhysicalPlan) -> dict:
        """Where the operator's requests go."""
        if self.in_place:
            return {}
        if self.log is None:
            self.log = RequestLog(self.spark, self.config.request_log)
        told = self.provider.log_name or type(self.provider).__qualname__
        return {"log": self.log, "stage": self.log.stage(p.node.logical_op_id, p.impl.key, p.node.generated, told), "workers": self.config.max_workers}

    def observed(self, p: PhysicalPlan, made: DataFrame) -> DataFrame:
        """In place, what the calls took is a metric of the query."""
        if not self.in_place:
            return made
        return made.observe(f"{p.node.kind}-{p.node.logical_op_id}", F.count(F.lit(1)).alias("rows"), *[F.sum(f"__stats.{k}").alias(k) for k in STATS])

    def keep(self, p: PhysicalPlan, rows: DataFrame, calls: DataFrame | None) -> None:
        if calls is not None:
            self.stages[p.node.plan_id, p.impl.key] = Stage(p.node.logical_op_id, p.impl.key, rows, calls)

    def apply(self, p: PhysicalPlan, kids: list[DataFrame]) -> DataFrame:
        """One operator over its inputs' frames."""
        n, first, reads = p.node, kids[0] if kids else None, list(p.node.depends_on)
        if n.kind in ("scan", "context_scan"):
            return load(self.spark, n, self.config)
        if n.kind == "filter":
            return relational.filter_rows(first, n["predicate"], n.depends_on)
        if n.kind in ("map", "flat_map"):
            return relational.map_rows(first, n["udf"], n["fields"], n.kind == "flat_map", n.depends_on)
        if n.kind == "project":
            return relational.project(first, list(n["cols"]))
        if n.kind == "limit":
            return first.limit(n["n"])
        if n.kind == "distinct":
            return relational.distinct(first, list(n["cols"]) or None)
        if n.kind == "join":
            return relational.join(kids[0], kids[1], list(n["on"]), n["how"])
        if n.kind == "agg":
            return relational.aggregate(first, n["func"])
        if n.kind == "groupby":
            return relational.group_by(first, n["sig"])
        if n.kind == "topk":
            return sem_topk(first, n["index"], n["search_attr"], n["fields"], p.impl.get("k"), self.provider, search_func=n["search_func"])
        if n.kind in ("search", "compute"):  # one row; its input has been lowered, so its parent has been asked
            context = n["context"]
            context.evaluate([context.manager.get_context(i) for i in p.impl.get("contexts", ())])
            return context.load(self.spark)
        where = self.logged(p)
        calls = (lambda: where["log"].calls(where["stage"])) if where else (lambda: None)
        if n.kind == "sem_filter":
            made = semantic.sem_filter(first, n["condition"], self.provider, p.impl, reads, self.batch, **where)
            self.keep(p, made, calls())
            return self.observed(p, made).where("__passed").drop("__passed", "__stats")
        if n.kind in ("sem_map", "sem_flat_map"):
            made = semantic.sem_map(first, n["fields"], self.provider, p.impl, reads, n.kind == "sem_flat_map", n["desc"], self.batch, **where)
            self.keep(p, made, calls())
            return self.observed(p, made).drop("__stats")
        if n.kind == "sem_join":
            out, asked = semantic.sem_join(kids[0], kids[1], n["condition"], n["how"], self.provider, p.impl, reads, batch=self.batch, **where)
            self.keep(p, out, asked)
            return out
        if n.kind == "sem_agg":
            made, asked = semantic.sem_agg(first, n["fields"].fields[0], n["instruction"], self.provider, p.impl, reads)
            self.keep(p, made, asked)
            return made
        raise ValueError(f"no lowering for {n.kind}")

    def limited(self, p: PhysicalPlan) -> DataFrame:
        """A limit over semantic verbs, in rounds over growing parts of their input until enough rows came out.

        The first round takes rows as Spark's own limit does, from as few partitions as hold them; later
        ones take all rows whose hash lies under a growing share, to the whole input. A round's
        requests that an earlier one made are in the log, so nothing is asked twice. Under an inner semantic join both
        sides grow. Only what is deterministic lies below the first semantic verb, so parts are the same each time.
        """
        n, chain, q = p.node["n"], [], p.inputs[0]
        while q.node.kind in ROW_WISE:
            chain.insert(0, q)
            q = q.inputs[0]
        joined = q.node.kind == "sem_join" and q.node["how"] == "inner" and q.impl.kind == "nested"
        if not joined:
            asks = [i for i, x in enumerate(chain) if x.node.kind in ASKING]
            if not asks or n <= 0:
                return self.apply(p, [self.go(p.inputs[0])])
            q, chain = chain[asks[0]].inputs[0], chain[asks[0] :]
        sides = [self.go(x) for x in (q.inputs if joined else (q,))]

        def over(parts: list[DataFrame]) -> DataFrame:
            df = self.apply(q, parts) if joined else parts[0]
            for x in chain:
                df = self.apply(x, [df])
            return df.limit(n)

        want = max(self.batch, 2 * n)
        want = math.isqrt(want - 1) + 1 if joined else want
        if want <= FIRST_ROWS:
            taken = [s.limit(want).collect() for s in sides]
            out = over([self.spark.createDataFrame(t, s.schema) for t, s in zip(taken, sides, strict=True)])
            if all(len(t) < want for t in taken) or out.count() >= n:
                return out
            want *= GROWTH
        shares = [min(1.0, want / max(1, s.count())) for s in sides]
        while True:
            out = over([s if x >= 1 else s.where(F.pmod(F.xxhash64(semantic.content_key(s, s.columns)), F.lit(HASHES)) < int(x * HASHES) + 1) for s, x in zip(sides, shares, strict=True)])
            if min(shares) >= 1 or out.count() >= n:
                return out
            shares = [min(1.0, x * GROWTH) for x in shares]

    def distinct(self, p: PhysicalPlan) -> DataFrame:
        """The first row of each value, by the source's own order where there is one (see ``relational.first_rows``)."""
        below, chain = p.inputs[0], []
        while below.node.kind in ("filter", "project", "map"):
            chain.insert(0, below)
            below = below.inputs[0]
        cols = list(p.node["cols"])
        source = below.node["source"] if below.node.kind == "scan" else None
        df = source.ordered(self.spark, ORDINAL) if hasattr(source, "ordered") else None
        if df is None or self.config.scan_start_idx or self.config.num_samples is not None:
            return relational.first_rows(self.go(p.inputs[0]), cols, None)
        df = df.select(*[relational.col(n) for n in below.node.schema.names], ORDINAL)
        for x in chain:
            if x.node.kind == "project":
                df = df.select(*[relational.col(c) for c in relational.project(df.drop(ORDINAL), list(x.node["cols"])).columns], ORDINAL)
            elif x.node.kind == "filter":
                df = relational.filter_rows(df, x.node["predicate"], x.node.depends_on or tuple(c for c in df.columns if c != ORDINAL))
            else:
                df = relational.map_rows(df, x.node["udf"], x.node["fields"], False, x.node.depends_on or tuple(c for c in df.columns if c != ORDINAL))
        return relational.first_rows(df, cols, ORDINAL)
