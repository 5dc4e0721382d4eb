"""Ranks, running sums and medians over a whole table, without a window that holds it in one task.

Rows are range-partitioned by their order and written.  A window inside each part
sums that part, and the parts' totals (one row each) say what lies before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


def running(df: DataFrame, order: Sequence[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Adds each sum over the row itself and all rows before it.

    ``order`` should end in something unique: rows that tie share a part and have any order there.
    """
    part = next(n for n in (f"part{'_' * i}" for i in range(1_000)) if n not in df.columns)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = written(df.select("*", *[c.alias(n) for n, c in sums.items()]).repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()), "ordered")
    totals = placed.groupBy(part).agg(*[F.sum(n).alias(f"{n}_{part}") for n in sums])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    totals = totals.select(part, *[F.coalesce(F.sum(f"{n}_{part}").over(before), F.lit(0)).alias(f"{n}_{part}") for n in sums])
    upto = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.join(F.broadcast(totals), part)
    return rows.select(*df.columns, *[(F.sum(n).over(upto) + F.col(f"{n}_{part}")).alias(n) for n in sums])


def ranked(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Adds the place of each row, from 1."""
    return running(df, order, {name: F.lit(1)}).withColumn(name, F.col(name).cast("int"))


def ranked_within(df: DataFrame, by: str, order: Sequence[Column | str], name: str = "rn", size: str = "n") -> DataFrame:
    """Adds the place of each row among the rows of its class, and their number; classes are few."""
    classes = df.groupBy(F.col(by).alias("class")).agg(F.count("*").alias(size))
    before = Window.orderBy(F.col("class").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("before", F.coalesce(F.sum(size).over(before), F.lit(0)))
    rows = ranked(df, [F.col(by).asc_nulls_first(), *order], name)
    rows = rows.join(F.broadcast(classes), rows[by].eqNullSafe(classes["class"]))
    return rows.select(*df.columns, (F.col(name) - F.col("before")).cast("int").alias(name), size)


def median(df: DataFrame, column: str) -> float | None:
    """The exact median of the values that are not null; None without any."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    values = running(values, ["v"], {"upto": F.col("c")})
    n = values.agg(F.max("upto")).first()[0]
    if not n:
        return None
    low, high = values.agg(*[F.min(F.when(F.col("upto") >= at, F.col("v"))) for at in ((n + 1) // 2, n // 2 + 1)]).first()
    return (float(low) + float(high)) / 2
