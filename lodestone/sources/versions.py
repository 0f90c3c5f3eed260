"""Index tables in versions (M2, M4, M5, M8): buckets by hash prefix, and a manifest that switches from one version to the next.

A table is a folder with ``data`` and ``manifest``. Rows lie in buckets by the first hexadecimal digits of their content hash, so
their number is fixed (256 for two digits) however many documents there are. A change writes new files for the buckets that it
touches, then a manifest: one line a version that names the folder of each bucket. Spark's commit moves that one file into place
when it is whole, so that a reader sees the old version or the new one. A job killed before leaves files that no manifest names.

Runs of documents are rows of a table of the same kind: ``refresh`` brings an index up to date with documents, in one version for
the evidence and, once that is there, one for the runs.

Defined results: null hashes are no documents and are left out; a table without a version has no rows; rows keep their order by no
promise. Two writers that race for a version: the second one fails (the folder exists) and starts again from the new version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

MANIFEST = "version long, buckets map<string,string>"
INDEXED, NO_EVIDENCE, INDEXING, FAILED = "indexed", "no_evidence", "indexing", "failed"
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"  #: fixed value: the namespace of names that are addresses (RFC 4122)
RUNS = "content_hash string, status string, evidence_count long, counts map<string,long>, error string"


def point_id(name: Column) -> Column:
    """The name-based UUID (version 5) of a name in the namespace of addresses."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(name, "UTF-8")))
    digit = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(digit, F.substring(h, 18, 3)), F.substring(h, 21, 12))


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "content_hash", digits: int = 2):
        self.spark, self.root, self.key, self.digits = spark, root.rstrip("/"), key, digits
        self.schema = T._parse_datatype_string(schema)

    def bucket(self) -> Column:
        return F.substring(F.sha2(F.col(self.key), 256), 1, self.digits)

    def manifest(self) -> tuple[int, dict[str, str]]:
        """The newest version and its buckets' folders; 0 and none before the first."""
        try:
            rows = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest/*").orderBy(F.col("version").desc()).limit(1).collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = []
        return (rows[0]["version"], dict(rows[0]["buckets"] or {})) if rows else (0, {})

    def read(self, buckets: list[str] | None = None) -> DataFrame:
        """The rows of the newest version, of all buckets or of some."""
        found = self.manifest()[1]
        paths = [p for b, p in sorted(found.items()) if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys: only their buckets are read."""
        touched = [r[0] for r in keys.where(F.col(self.key).isNotNull()).select(self.bucket()).distinct().collect()]  # at most 16 ** digits
        return self.read(touched).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def staged(self, rows: DataFrame, keys: DataFrame) -> tuple[int, dict[str, str]]:
        """Writes the touched buckets with ``rows`` in place of what the keys had, and names the version that they would be."""
        version, buckets = self.manifest()
        touched = [r[0] for r in keys.where(F.col(self.key).isNotNull()).select(self.bucket()).distinct().collect()]
        stay = self.read(touched).join(keys.select(self.key).distinct(), self.key, "left_anti")
        new = rows.where(F.col(self.key).isNotNull()).select(self.schema.names)
        both = stay.unionByName(new).withColumn("__bucket", self.bucket())
        path = f"{self.root}/data/{version + 1:08d}-{uuid.uuid4().hex}"
        # a bucket is written by several tasks, as one document may have most of its rows
        both.repartition("__bucket", F.pmod(F.monotonically_increasing_id(), F.lit(8))).write.partitionBy("__bucket").parquet(path)
        stored = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("__bucket", T.StringType())])).parquet(path)
        written = {r[0] for r in stored.select("__bucket").distinct().collect()}
        for b in touched:
            buckets.pop(b, None)  # a bucket that lost all its rows has no folder
        return version + 1, buckets | {b: f"{path}/__bucket={b}" for b in written}

    def commit(self, version: int, buckets: dict[str, str]) -> None:
        """The switch: a line in a folder of its version; it fails where another writer has taken that version."""
        line = self.spark.createDataFrame([(version, buckets)], MANIFEST).coalesce(1)
        line.write.mode("errorifexists").json(f"{self.root}/manifest/{version:08d}")

    def replace(self, rows: DataFrame, keys: DataFrame) -> int:
        """``rows`` in place of all rows of ``keys``, in one version."""
        version, buckets = self.staged(rows, keys)
        self.commit(version, buckets)
        return version

    def delete(self, keys: DataFrame) -> int:
        return self.replace(self.spark.createDataFrame([], self.schema), keys)


def index_actions(documents: DataFrame, runs: DataFrame, evidence: DataFrame, force: bool = False) -> DataFrame:
    """M2, M4: (content_hash, action, stale): what an index does with each document.

    It is reused where its run ended with evidence that is there, or with none and none is there. Else it is indexed, and rows that
    are there are stale: those of a run that exists, or all of them by ``force``. ``documents``, ``runs`` (content_hash, status) and
    ``evidence`` have a content hash; several rows of a document count once, of several runs the one that sorts last."""
    have = evidence.groupBy("content_hash").agg(F.count("*").alias("n"))
    run = runs.groupBy("content_hash").agg(F.max("status").alias("status"))
    each = documents.where("content_hash IS NOT NULL").select("content_hash").distinct().join(run, "content_hash", "left").join(have, "content_hash", "left")
    n = F.coalesce("n", F.lit(0))
    same = ((F.col("status") == INDEXED) & (n > 0)) | ((F.col("status") == NO_EVIDENCE) & (n == 0))
    action = F.when(F.coalesce(same, F.lit(False)) & ~F.lit(force), "reuse").otherwise("index")
    stale = (action == "index") & (F.lit(force) | F.col("status").isNotNull()) & (n > 0)
    return each.select("content_hash", action.alias("action"), stale.alias("stale"))


def refresh(table: VersionedTable, runs: VersionedTable, documents: DataFrame, extract: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame], kind: str = "table_type", name: str = "table_id", force: bool = False) -> DataFrame:
    """Brings an index up to date and returns its (content_hash, action, status, evidence_count).

    1. Documents without a finished run get one that says ``indexing``.
    2. ``extract`` gives the evidence of just these documents; ``embed`` adds a vector. Rows get a point id from their name, and their
       buckets are written, but no version names them yet.
    3. One version switches the evidence, old rows of these documents gone; one switches the runs to their end.

    Killed before 3, the job leaves the old evidence readable and the runs unfinished, so that it starts again at 1, with the same
    result. ``extract`` is Spark work on a table of documents, so it is not the driver's loop over them."""
    spark = table.spark
    plan = index_actions(documents, runs.read(), table.read(), force)
    plan.write.parquet(path := f"{table.root}/plans/{uuid.uuid4().hex}")
    plan = spark.read.parquet(path)
    todo = plan.where("action = 'index'").select("content_hash")
    if not todo.isEmpty():
        empty = F.lit(None)
        runs.replace(todo.select("content_hash", F.lit(INDEXING).alias("status"), F.lit(0).cast("long").alias("evidence_count"), empty.cast("map<string,bigint>").alias("counts"), empty.cast("string").alias("error")), todo)
        found = embed(extract(documents.join(todo, "content_hash", "left_semi"))).withColumn("point_id", point_id(F.col(name)))
        table.commit(*table.staged(found, todo))
        each = table.of(todo).groupBy("content_hash", F.coalesce(kind, F.lit("")).alias("kind")).agg(F.count("*").alias("n"))
        counts = each.groupBy("content_hash").agg(F.sum("n").alias("evidence_count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("counts"))
        ended = todo.join(counts, "content_hash", "left").select("content_hash", F.when(F.col("evidence_count") > 0, INDEXED).otherwise(NO_EVIDENCE).alias("status"), F.coalesce("evidence_count", F.lit(0).cast("long")).alias("evidence_count"), "counts", empty.cast("string").alias("error"))
        runs.replace(ended, todo)
    return plan.select("content_hash", "action").join(runs.read().select("content_hash", "status", "evidence_count"), "content_hash")
