"""Tables that an operator writes for itself or for later jobs, in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 8 << 20
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
_own: dict[str, str] = {}


def small_batches(spark: SparkSession) -> None:
    """From now on, rows go to Python in batches of ``BATCH_BYTES`` at most in this session, however long they are."""
    if not (size := spark.conf.get(BATCHES)).isdigit() or int(size) > BATCH_BYTES:
        spark.conf.set(BATCHES, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode. A cluster must name one."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if context.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="lodestone-")
    return _own[context.applicationId]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/lodestone/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table at ``path``, or at a new one: it is computed once, and a lost executor costs nothing."""
    path = path or fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
