"""Tables in the cluster's shared folder: what must outlive an executor is written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session on one machine may leave it unset and use its temporary folder."""
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir", "")
    if not given:
        jsc = context._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(f"{tempfile.gettempdir()}/semloom-checkpoints")
        given = jsc.getCheckpointDir().get()
    return given.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/semloom-{name}-{uuid.uuid4().hex}"
    files, place = _files(spark, path)
    files.deleteOnExit(place)
    return path


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _files(spark, path)
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    files, place = _files(spark, path)
    files.delete(place, True)
    files.cancelDeleteOnExit(place)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again, so that nothing above it is computed twice."""
    path = fresh_path(df.sparkSession, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
