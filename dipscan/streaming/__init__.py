"""Structured Streaming counterparts of the series operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 64) -> DataFrame:
    """Events as a stream with a zoned time; new files of the folder are new rows."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/event[s].parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_bins(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows and summed value of every time bin and event type."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.unix_micros("window.start").alias("start_us"), "event_type", "n", "value")


def session_segments(events: DataFrame, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    """Runs of each user's events without a gap: the streaming form of segmentation."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count("*").alias("n")).select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


def first_of_each(events: DataFrame, key: str = "event_id", late: str = "2 days") -> DataFrame:
    """Each key once; repeats that come later than the watermark are not held against it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_available(result: DataFrame, name: str, mode: str = "complete", each: Callable[[DataFrame, int], None] | None = None, folder: str | None = None) -> DataFrame:
    """Run a stream over what is there now; returns the table it wrote.

    In complete mode the table is what the last batch held; in append mode all
    batches.  Offsets and state live below ``folder`` (a new one in the shared folder
    by default): a later run with the same folder reads only what is new.
    """
    spark = result.sparkSession
    folder = folder or shared_folder(spark, name)
    out = f"{folder}/rows"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")
        if each:
            each(batch, number)

    query = result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).select(*result.columns)
