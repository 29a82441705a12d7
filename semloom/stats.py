"""Execution statistics, summed from the request log (accumulators would count retries twice)."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import functions as F


@dataclass
class OperatorStats:
    op_id: str
    implementation: str
    rows: int = 0
    calls: int = 0
    input_tokens: float = 0.0
    output_tokens: float = 0.0
    cost: float = 0.0
    seconds: float = 0.0
    failures: int = 0
    image_tokens: float = 0.0
    audio_tokens: float = 0.0


@dataclass
class ExecutionStats:
    plan: list[str] = field(default_factory=list)
    estimated: dict = field(default_factory=dict)
    operators: list[OperatorStats] = field(default_factory=list)
    optimization_cost: float = 0.0
    optimization_calls: int = 0
    optimization_seconds: float = 0.0
    plan_seconds: float = 0.0

    @property
    def plan_execution_cost(self) -> float:
        return sum(o.cost for o in self.operators)

    @property
    def total_execution_cost(self) -> float:
        return self.optimization_cost + self.plan_execution_cost

    @property
    def total_calls(self) -> int:
        return self.optimization_calls + sum(o.calls for o in self.operators)

    @property
    def total_tokens(self) -> float:
        return sum(o.input_tokens + o.output_tokens for o in self.operators)

    def to_json(self, path: str | None = None) -> str:
        text = json.dumps(asdict(self) | {"total_execution_cost": self.total_execution_cost, "total_tokens": self.total_tokens}, indent=1)
        if path:
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
        return text


def stage_stats(stage) -> OperatorStats:
    """A stage's rows, counted once more without calls, and what its requests took."""
    from .operators.ledger import STATS

    r = stage.calls.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in STATS]).first()
    return OperatorStats(stage.op_id, stage.implementation, stage.rows.count(), int(r["calls"]), r["input_tokens"], r["output_tokens"], r["cost"], r["seconds"], int(r["failures"]), r["image_tokens"], r["audio_tokens"])
