"""The shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see; temporary only where none is set and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new shared folder and read back: cuts the lineage and fixes what a rerun may change."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, name: str) -> DataFrame:
    """``written``, in parts of 50,000 rows while cores are left, then of 500,000 at most: for learners, which pass over a few numbers of each row hundreds of times and pay for each task.

    They draw by place, so rows are dealt and sorted by their values, in whatever order they came.
    """
    df = written(df, name)
    n = df.count()
    parts = max(1, min(-(-n // 50_000), max(df.sparkSession.sparkContext.defaultParallelism, -(-n // 500_000))))
    return written(df.repartition(parts, *df.columns).sortWithinPartitions(*df.columns), name)


def at_once(spark: SparkSession, calls: Sequence[Callable], threads: int = 2) -> list:
    """Results of calls that run jobs of their own, some at a time, as ``CrossValidator`` does; for fits, whose small jobs follow one another and leave cores idle."""
    with ThreadPool(min(threads, len(calls))) as pool:
        return pool.map(lambda call: call(), [inheritable_thread_target(spark)(call) for call in calls], chunksize=1)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by keys to as many parts as a shuffle has, or cores; for heavy work on few bytes, which adaptive execution would put into one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)
