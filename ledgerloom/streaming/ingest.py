"""Incremental ingest: files as they arrive, slices replaced as a whole, windows with late rows, sessions with state."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.upserts import store
from ledgerloom.tables import table


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that all executors share, as the session names it. Where none is named, a session on one machine gets a folder that ends with the process; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return f"{named}/ledgerloom-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    own = tempfile.mkdtemp(prefix="ledgerloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def arriving(spark: SparkSession, data_dir: str, name: str, files_at_once: int = 100) -> DataFrame:
    """A stream of the Parquet files of a table, be it one file or a folder of them."""
    schema = table(spark, data_dir, name).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once)
    path = f"{data_dir}/{name}.parquet"
    local = path.removeprefix("file://")
    if os.path.isfile(local):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(data_dir)
    return reader.parquet(path)


def ingested(stream: DataFrame, path: str, checkpoint: str, by: list[str]) -> None:
    """All that has arrived, batch by batch: each batch is a partition of its own, over `by`, so writing a batch again replaces it alone. A restart skips finished files."""

    def batch(df: DataFrame, number: int) -> None:
        store(df.withColumn("batch", F.lit(number)), path, ["batch", *by])

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replaced(stream: DataFrame, path: str, checkpoint: str, by: list[str]) -> None:
    """Deliveries of whole slices: each batch replaces the slices it holds and leaves the others. A slice must not be split over batches."""

    def batch(df: DataFrame, _: int) -> None:
        store(df, path, by)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def counted(stream: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "365 days") -> DataFrame:
    """Rows by tumbling window and key; rows later than `late` are dropped by the watermark."""
    s = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return s.groupBy(F.window("_t", window).alias("w"), key).agg(F.count("*").alias("rows"))


def once_each(stream: DataFrame, time: str, keys: list[str], late: str = "30 days") -> DataFrame:
    """Rows by key once, whatever is delivered again within the watermark."""
    return stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(keys)


# ---- Queries ----------------------------------------------------------------------------------------


def streamed_event_hours(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and type, counted by a stream into the shared folder and read back."""
    base = shared_folder(spark)
    out = counted(arriving(spark, d, "events"), "ts", "event_type")

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    # Changed windows only, so that the watermark frees the state of old ones; of each window the last count holds.
    out.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    counts = spark.read.parquet(f"{base}/out").select(F.unix_timestamp("w.start").alias("hour"), "event_type", "rows", "batch")
    return counts.groupBy("hour", "event_type").agg(F.max_by("rows", "batch").alias("events"))


def streamed_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts ingested by a stream into partitions by year, twice over, and read back by year."""
    base = shared_folder(spark)
    for k in range(2):
        ingested(arriving(spark, d, "financial_facts", files_at_once=10_000).select("seq", "doc_id", "year", "concept", "value"), f"{base}/facts", f"{base}/state{k}", ["year"])
    return spark.read.parquet(f"{base}/facts").groupBy("year").agg(F.count("*").alias("facts"), F.count("value").alias("with_value"))


QUERIES = {"streamed_event_hours": streamed_event_hours, "streamed_facts": streamed_facts}
ORACLES = {
    "streamed_event_hours": "SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS hour, event_type, count(*) AS events FROM events GROUP BY ALL",
    "streamed_facts": "SELECT year, count(*) AS facts, count(value) AS with_value FROM financial_facts GROUP BY year",
}
