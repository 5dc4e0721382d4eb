"""Training anew as labels stream in: once for each threshold passed, whatever is replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSIONS = "version int, batch bigint, labels bigint, metrics map<string,double>"


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """(version, batch, labels, metrics) of every training; a version that was recorded twice counts once."""
    try:
        rows = spark.read.schema(VERSIONS).json(f"{folder}/versions")
        rows.limit(1).count()
    except AnalysisException:  # nothing there yet
        return spark.createDataFrame([], VERSIONS)
    return rows.groupBy("version").agg(*[F.min_by(c, "batch").alias(c) for c in ("batch", "labels", "metrics")])


def labels_until(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """All labels of the batches up to this one; the last label of an id counts."""
    rows = spark.read.parquet(f"{folder}/labels").where(F.col("batch") <= batch)
    newest = rows.groupBy("id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["id", "batch"]).drop("batch")


def on_labels(spark: SparkSession, folder: str, train: Callable[[DataFrame, str], dict[str, float]], threshold: int = 50) -> Callable[[DataFrame, int], None]:
    """What is done with each batch of labels (id, label, ...); doing it again changes nothing.

    A batch's labels go to a part of their own, named by the batch's number, so a replay writes
    over itself.  Version v is due when v times ``threshold`` ids are labelled; ``train`` gets
    all labels up to the batch and the folder for the model and returns metrics.  The record of a version is
    written after its model; a batch that is replayed finds it and trains nothing.
    A batch that passes several thresholds trains the highest one.
    """

    def write(batch: DataFrame, number: int) -> None:
        # ids are labelled once in a batch: the greatest row stays
        columns = [c for c in batch.columns if c != "id"]
        once = batch.groupBy("id").agg(F.max(F.struct(*columns)).alias("v")).select("id", "v.*")
        once.write.mode("overwrite").parquet(f"{folder}/labels/batch={number}")
        known = labels_until(spark, folder, number)
        n = known.count()
        due = n // threshold
        last = versions(spark, folder).agg(F.max("version")).first()[0] or 0
        if due <= last:
            return
        metrics = train(known, f"{folder}/models/{due}")
        record = spark.createDataFrame([(due, number, n, {k: float(v) for k, v in metrics.items()})], VERSIONS)
        record.coalesce(1).write.mode("append").json(f"{folder}/versions")

    return write


def retrained(labels: DataFrame, folder: str, train: Callable[[DataFrame, str], dict[str, float]], threshold: int = 50) -> DataFrame:
    """Runs a stream of labels over what is there now, with ``on_labels``; the versions that it and earlier runs have trained."""
    each = on_labels(labels.sparkSession, folder, train, threshold)
    query = labels.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return versions(labels.sparkSession, folder)
