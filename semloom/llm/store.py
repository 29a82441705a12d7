"""Shared storage for cut lineage, and checked collection of bounded tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BITMAP_BITS = 23
_SEGMENTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a session that runs on this machine alone may leave it unset, as in tests; its
    tables go to a folder of their own under the system's temporary one.
    """
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


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while f"_{name}".lower() in taken:
            name = f"_{name}"
        out.append(f"_{name}")
    return out


def bounded_batches(spark: SparkSession, megabytes: int = 8, rows: int = 4000) -> None:
    """Hold the session's Arrow batches to a size that suits long texts, where they may be larger.

    A batch is held by the JVM and its Python worker at once, twice each while it is copied.
    """
    kept = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m"))
    if kept > megabytes << 20:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lost executors recompute nothing above it.

    The table goes when the driver's JVM ends, if ``discard`` hasn't deleted it before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/semloom-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    files, place = _files(spark, path)
    files.deleteOnExit(place)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def least_by_hash(df: DataFrame, column: str, n: int, total: int) -> DataFrame:
    """The ``n`` rows with the least hash of a column, of ``total`` rows.

    Rows far over the share asked for are passed over before the ordered limit, so
    that tasks don't each send ``n`` rows.
    """
    share = min(1.0, (2 * n + 100) / max(1, total))
    near = df.where(F.pmod(F.xxhash64(column), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    return near.orderBy(F.pmod(F.xxhash64(column), F.lit(1 << 20)), column).limit(n)


def discard(df: DataFrame) -> None:
    """Delete the table that ``written`` made; nothing lazy may read it any more."""
    path = getattr(df, "_written_at", None)  # None also for no table at all
    if path:
        files, place = _files(df.sparkSession, path)
        files.delete(place, True)
        files.cancelDeleteOnExit(place)


def bit_of(h: int) -> int:
    """A 64-bit hash's place in the bitmap."""
    return (h + 2**63) >> (64 - BITMAP_BITS)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of the top bits of ``h``, joined over the partitions in segments."""
    width = (1 << BITMAP_BITS) // 8 // _SEGMENTS

    def run(batches):
        bits = None
        for batch in batches:
            if batch.num_rows:
                bits = np.zeros(1 << BITMAP_BITS, bool) if bits is None else bits
                h = batch.column(0).to_numpy().view(np.uint64) + np.uint64(2**63)
                bits[(h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)] = True
        if bits is not None:
            packed = np.packbits(bits).reshape(_SEGMENTS, width)
            used = [i for i in range(_SEGMENTS) if packed[i].any()]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([packed[i].tobytes() for i in used], pa.binary())], ["seg", "bits"])

    def union(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.uint8)
        for batch in batches:
            for x in batch.column(1).to_pylist():
                total |= np.frombuffer(x, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["seg", "bits"])

    rows = hashes.select("h").mapInArrow(run, "seg int, bits binary").groupBy("seg").applyInArrow(union, "seg int, bits binary").collect()
    out = np.zeros((_SEGMENTS, width), np.uint8)
    for r in rows:
        out[r["seg"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)
