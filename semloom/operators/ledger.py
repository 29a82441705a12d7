"""A log of requests and answers, so that no model call is paid for twice.

A request's key is the hash of what the model gets: records with equal inputs share one
request, whatever rows they are in. Those that the log lacks are asked for, and each task
adds its answers to the log when it ends (its file is moved there when the task commits), so a lost
executor repeats the calls of its running tasks only, and a failed job keeps what its
finished tasks paid for. Rows get their answers by a join with the log on the key.

The log is a folder of Parquet files for each stage (operator, instruction, fields and
implementation). A run makes a new one in the shared folder, unless ``request_log`` names
one: then later runs, also of other sessions, reuse its answers. Failed requests are kept with their errors, and are
asked for again by the next run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import exists, fresh_path, remove
from ..types import hash_for_id

#: What a request took: whole numbers for calls and failures, else doubles. Input tokens are those of all kinds.
STATS = ("calls", "input_tokens", "image_tokens", "audio_tokens", "output_tokens", "cost", "seconds", "failures")
SPENT = ", ".join(f"{k} {'long' if k in ('calls', 'failures') else 'double'}" for k in STATS)
LOG = f"key binary, left binary, right binary, answer string, run string, {SPENT}, error string"


class AllCallsFailed(RuntimeError):
    """Every request of a stage failed; a wrong key or address is more likely than wrong records."""


def content_key(df: DataFrame, names: list[str]) -> Column:
    """The SHA-256 of the named fields' values; binary ones by their own hash."""
    from .relational import col

    parts = [F.sha2(col(n), 256).alias(n) if isinstance(df.schema[n].dataType, T.BinaryType) else col(n) for n in names]
    return F.unhex(F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}) if parts else F.lit(""), 256))


class RequestLog:
    """The log of one run's stages; see the module."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.kept = spark, folder is not None
        self.folder = folder.rstrip("/") if folder else fresh_path(spark, "requests")
        self.run = uuid.uuid4().hex

    def stage(self, *parts) -> str:
        """The place of a stage, told apart by what its requests have in common."""
        return f"{self.folder}/stage-{hash_for_id(repr(parts))}"

    def _read(self, stage: str) -> DataFrame:
        if not exists(self.spark, stage):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(stage)

    def ask(self, stage: str, wanted: DataFrame, call: Callable[[Column], Column], given: Column, workers: int | None = None) -> None:
        """Ask for the requests of ``wanted`` (distinct ``key``s, perhaps ``left`` and ``right``) without a good answer in the log.

        ``call`` turns ``given`` into the struct of answer, statistics and error. Requests are dealt over
        ``workers`` tasks, or as many as shuffles have; small stages aren't drawn together, since calls wait.
        """
        known = self._read(stage).where(F.col("error").isNull() & F.col("answer").isNotNull()).select("key").distinct()
        parts = workers or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        sides = [F.col(n) if n in wanted.columns else F.lit(None).cast("binary").alias(n) for n in ("left", "right")]
        asked = wanted.join(known, "key", "left_anti").repartition(parts).select("key", *sides, call(given).alias("__reply"))
        rows = asked.select("key", "left", "right", F.col("__reply.answer").cast("string").alias("answer"), F.lit(self.run).alias("run"), *[F.col(f"__reply.{k}").alias(k) for k in STATS], F.col("__reply.error").alias("error"))
        # the second way of committing moves a task's file to its place as soon as the task ends
        rows.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").option("compression", "zstd").parquet(stage)
        seen = self.calls(stage).agg(F.sum("calls").alias("calls"), F.sum("failures").alias("failures"), F.max("error").alias("error"), F.count("answer").alias("answers")).first()
        if seen["failures"] and not seen["calls"]:
            raise AllCallsFailed(f"all {seen['failures']} requests failed, one of them with: {seen['error']}")

    def calls(self, stage: str) -> DataFrame:
        """What this run asked for."""
        return self._read(stage).where(F.col("run") == self.run)

    def answers(self, stage: str) -> DataFrame:
        """(key, left, right, answer), one row a key: a good answer if there is one."""
        best = F.min(F.struct(F.col("answer").isNull(), F.col("error").isNotNull(), "answer", "left", "right"))
        return self._read(stage).groupBy("key").agg(best.alias("best")).select("key", "best.left", "best.right", "best.answer")

    def release(self) -> None:
        if not self.kept:
            remove(self.spark, self.folder)
