"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000
BATCH_BYTES = 8 << 20
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a temporary folder in local mode; a cluster must name one."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if context.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="lodestone-")
    return _own[context.applicationId]


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{tag}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """From now on, rows go to Python in batches of ``BATCH_BYTES`` at most in this session, as texts may be very long."""
    if not (size := spark.conf.get(BATCHES)).isdigit() or int(size) > BATCH_BYTES:
        spark.conf.set(BATCHES, str(BATCH_BYTES))


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes a query's shuffle files as soon as the query has ended."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, a lost executor costs nothing, and the shuffles
    that led to it are deleted."""
    path = shared_path(df.sparkSession, tag)
    small_batches(df.sparkSession)
    with shuffles_end(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def emptied(*tables: DataFrame) -> None:
    """Frees what ``written`` tables take, once nothing will read them any more: each is overwritten by a table without rows."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            df.sparkSession.range(0, numPartitions=1).write.mode("overwrite").parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a hint to broadcast it, only where a count finds at most ``most`` rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
