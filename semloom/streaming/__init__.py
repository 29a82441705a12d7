"""Datasets over streams.

Row-wise verbs (filter, map, flat_map, project, sem_filter, sem_map, sem_flat_map,
topk and joins with a static side) work on a streaming frame as they are; they
keep no state. Semantic verbs make their calls in place, and what they took is observed: a query's
progress has it as ``observedMetrics``, under the verb's name and its operator's id. Aggregates, distinct, limit and sem_agg need the whole input, so
they run on each micro-batch or not at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..dataset import Dataset
from ..session import QueryProcessorConfig, lower
from ..sources import FrameDataset

ROW_WISE = frozenset("scan filter map flat_map project sem_filter sem_map sem_flat_map topk join".split())


def stateless(dataset: Dataset) -> bool:
    """Whether a plan can run on a stream row by row."""
    return all(n.kind in ROW_WISE and n.get("how", "inner") == "inner" for n in dataset.node.walk())


def streamed(dataset: Dataset, config: QueryProcessorConfig | None = None) -> DataFrame:
    """The streaming frame of a row-wise plan whose source is a stream."""
    if not stateless(dataset):
        raise ValueError("this plan needs its whole input: use each_batch")
    config = QueryProcessorConfig.of(config)
    spark = SparkSession.builder.getOrCreate()
    return lower(spark, dataset._optimizer(config).optimize(dataset.node), config, in_place=True).df


def each_batch(stream: DataFrame, build: Callable[[Dataset], Dataset], write: Callable[[DataFrame, int], None], config: QueryProcessorConfig | None = None, **options: str) -> StreamingQuery:
    """Runs any plan on every micro-batch: ``build`` makes it from the batch's dataset, ``write`` takes its result."""

    def run(batch: DataFrame, epoch: int) -> None:
        done = build(FrameDataset(batch, f"batch_{epoch}")).run(config, spark=batch.sparkSession)
        write(done.df, epoch)
        done.release()

    return stream.writeStream.options(**options).foreachBatch(run).start()
