"""Batches of stars: one star's failure is a row, not the end of the job; fits go on where a run broke off."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import shared_folder, spread, written

MAX_FAILED = 0.5


class BatchFailed(RuntimeError):
    """Too many stars of a batch failed."""


def isolated(one: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str], key: str = "tic_id") -> Callable[[pd.DataFrame], pd.DataFrame]:
    """``one`` for a grouped task, with a ``status``: done on its rows, or one row of nulls that names the error."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            out = one(pdf)
            return out if "status" in out.columns else out.assign(status="done")
        except Exception as e:  # whatever a curve does to the numerics stays with the curve
            return pd.DataFrame([{c: None for c in columns} | {key: str(pdf[key].iloc[0]), "status": f"failed: {type(e).__name__}: {e}"[:200]}], dtype=object)

    return run


def per_star(rows: DataFrame, one: Callable[[pd.DataFrame], pd.DataFrame], schema: str, isolate: bool) -> DataFrame:
    """``one`` applied to each star; with ``isolate`` a ``status`` column and a row for each star that failed."""
    rows = spread(rows, "tic_id")
    if not isolate:
        return rows.groupBy("tic_id").applyInPandas(one, schema)
    names = [c.split()[0] for c in schema.split(", ")]
    if "status" not in names:
        schema = f"{schema}, status string"
    return rows.groupBy("tic_id").applyInPandas(isolated(one, names), schema)


def whole_stars(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Frames of ``least`` rows and more, of whole stars; rows come sorted by star."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n < least:
            continue
        rows = pd.concat(held, ignore_index=True)
        last = int((rows["tic_id"] != rows["tic_id"].iloc[-1]).sum())  # of the last star there may be more
        if last:
            yield rows.iloc[:last].reset_index(drop=True)
        held, n = [rows.iloc[last:]], n - last
    if n:
        yield pd.concat(held, ignore_index=True)


def each_curve(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
    """(star, t, flux) of whole curves; rows (tic_id, t, flux) come sorted by star, nulls are left out."""
    star, times, values = None, [], []

    def whole() -> tuple[object, np.ndarray, np.ndarray]:
        t, f = np.concatenate(times), np.concatenate(values)
        keep = ~np.isnan(t) & ~np.isnan(f)
        return star, t[keep], f[keep]

    for batch in batches:
        names = batch.column(0).to_pylist()
        t, f = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
        at = 0
        while at < len(names):
            stop = at + 1
            while stop < len(names) and names[stop] == names[at]:
                stop += 1
            if times and names[at] != star:
                yield whole()
                times, values = [], []
            star = names[at]
            times.append(t[at:stop])
            values.append(f[at:stop])
            at = stop
    if times:
        yield whole()


def per_curve(lc: DataFrame, one: Callable[[np.ndarray, np.ndarray], tuple | None], schema: str, isolate: bool = True) -> DataFrame:
    """(tic_id, status, *schema) with a row for each star, from ``one(t, flux)``; curves stream through the tasks, sorted by star.

    A curve that ``one`` cannot work with gives a row of nulls and the error as its status;
    the others are not touched by it; without ``isolate`` it ends the job.  None gives nulls with the status done.
    """
    kind = lc.schema["tic_id"].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(", ")]
    empty = (None,) * len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for star, t, f in each_curve(batches):
            try:
                found = (star, "done", *(one(t, f) or empty))
            except (ValueError, ArithmeticError, IndexError, np.linalg.LinAlgError) as e:
                if not isolate:
                    raise
                found = (star, f"failed: {type(e).__name__}: {e}"[:200], *empty)
            out.append(found)
            if len(out) == 500:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [{"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in [f"tic_id {kind}", "status string", *schema.split(", ")]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["tic_id", "status", *names])

    rows = lc.select("tic_id", F.col("t").cast("double").alias("t"), F.col("flux").cast("double").alias("flux"))
    return spread(rows, "tic_id").sortWithinPartitions("tic_id", "t").mapInArrow(run, f"tic_id {kind}, status string, {schema}")


def settled(work: DataFrame, max_failed: float = MAX_FAILED, name: str = "batch") -> tuple[DataFrame, DataFrame]:
    """(rows of the stars that are done, (tic_id, status) of the others) of isolated work, which runs once here.

    The work is written, and counted there; ``BatchFailed`` is raised if more than ``max_failed`` of
    the stars failed.  A star has rows of one kind only.
    """
    failed = F.col("status").startswith("failed")
    done = written(work, name)
    bad = done.where(failed).count()
    if bad:
        stars = done.where(~failed).select("tic_id").distinct().count()
        if bad > max_failed * (bad + stars):
            raise BatchFailed(f"{bad} of {bad + stars} stars failed")
    return done.where(~failed), done.where(failed).select("tic_id", "status")


def status_tally(done: DataFrame, failed: DataFrame) -> DataFrame:
    """(status, stars): each kind of error, and the stars that are done."""
    kind = F.regexp_extract("status", r"^(failed: \w+)", 1)
    return done.select("tic_id", "status").distinct().groupBy("status").agg(F.count("*").alias("stars")).unionByName(failed.groupBy(kind.alias("status")).agg(F.count("*").alias("stars")))


# -- work units ---------------------------------------------------------------

COMMITS = "unit int, part string, stars bigint, at timestamp"


def committed(folder: str, schema: T.StructType, spark) -> tuple[DataFrame, DataFrame]:
    """(rows, commit records) of a folder of work units; parts without a record do not count."""
    try:
        commits = spark.read.schema(COMMITS).json(f"{folder}/commits")
        commits.limit(1).count()
    except AnalysisException:  # nothing there yet
        return spark.createDataFrame([], schema), spark.createDataFrame([], COMMITS)
    parts = [r.part for r in commits.select("part").collect()]  # a record for each unit of each run
    return spark.read.schema(schema).parquet(*[f"{folder}/{p}" for p in parts]), commits


def in_units(lc: DataFrame, folder: str, work: Callable[[DataFrame], DataFrame], schema: T.StructType, units: int = 16) -> DataFrame:
    """``work`` over all stars of ``lc`` that ``folder`` does not hold yet; all rows the folder then holds.

    Stars are dealt to ``units`` by hash.  Each unit is a job that writes a part of its own and
    then a commit record; a run that breaks off keeps the units it has committed, and parts without a
    record are never read.  Stars with a committed row, failed ones too, are not tried again.
    """
    spark = lc.sparkSession
    unit = F.pmod(F.xxhash64("tic_id"), F.lit(units)).cast("int")
    held, _ = committed(folder, schema, spark)
    made = lc.join(held.select("tic_id").distinct(), "tic_id", "left_anti").withColumn("unit", unit)
    path = shared_folder(spark, "pending")  # curves are made once, not once for each unit
    made.write.partitionBy("unit").parquet(path)
    pending = spark.read.schema(made.schema).parquet(path)
    todo = sorted((r.unit, r.stars) for r in pending.groupBy("unit").agg(F.count_distinct("tic_id").alias("stars")).collect())
    for k, stars in todo:
        part = f"unit-{k}-{uuid.uuid4().hex}"
        work(pending.where(F.col("unit") == k).drop("unit")).write.parquet(f"{folder}/{part}")
        record = spark.createDataFrame([(k, part, stars)], "unit int, part string, stars bigint").withColumn("at", F.current_timestamp())
        record.coalesce(1).write.mode("append").json(f"{folder}/commits")
    return committed(folder, schema, spark)[0]
