"""Extension: files of documents as a stream, deduplicated by content hash and chunked batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import chunking

DOCUMENTS = "doc_id long, text string, arrived timestamp"


def document_stream(spark: SparkSession, path: str) -> DataFrame:
    """JSON files as they arrive; equal texts within an hour of event time are passed once."""
    rows = spark.readStream.schema(DOCUMENTS).json(path)
    return rows.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256)).withWatermark("arrived", "1 hour").dropDuplicatesWithinWatermark(["content_hash"])


def chunk_stream(documents: DataFrame, out: str, checkpoint: str, most: int = 1200, overlap: int = 200) -> StreamingQuery:
    """Writes each batch's chunks under its number, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        line = F.transform(F.split("text", "\n"), lambda t, i: F.struct(F.lit("text").alias("label"), (F.floor(i / 10) + 1).cast("int").alias("page"), t.alias("text")))
        chunking.document_chunks(batch.select("content_hash", line.alias("blocks")), most, overlap).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of events in tumbling windows, for batch or stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
