"""The series behind the plots of a candidate, as tidy tables.

Nothing is drawn here: each function returns what a plot shows, a row for each point or
bin of each star, so a plot of any star is a filter on ``tic_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bin_index, hours_from_mid
from .series import folded


def periodogram(powers: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(tic_id, period, sr) with marks: ``best`` (ties: the shorter period), and near half or twice of it."""
    best = powers.groupBy("tic_id").agg(F.max(F.struct("sr", (-F.col("period")).alias("p"))).alias("b")).select("tic_id", (-F.col("b.p")).alias("top"))
    near = lambda factor: F.abs(F.col("period") / F.col("top") / factor - 1) < tolerance
    rows = powers.join(best, "tic_id").where("sr is not null")
    return rows.select("tic_id", "period", "sr", (F.col("period") == F.col("top")).alias("best"), near(0.5).alias("half"), near(2.0).alias("double"))


def parity_points(lc: DataFrame) -> DataFrame:
    """Points of odd and even epochs within a dip's length of mid-time: (tic_id, event_id, parity, hours, flux)."""
    epoch = F.rint((F.col("t") - F.col("t0")) / F.col("period"))
    hours = hours_from_mid(F.col("t"), F.col("period"), F.col("t0"))
    rows = lc.where(F.abs(hours) < F.col("dur") * 24)
    return rows.select("tic_id", "event_id", F.pmod(epoch, F.lit(2.0)).cast("int").alias("parity"), hours.alias("hours"), "flux")


def secondary_bins(lc: DataFrame, bins: int = 20) -> DataFrame:
    """Mean flux by phase bin, half a period from mid-time: (tic_id, bin, flux, n)."""
    phi = F.col("phi") - F.floor(F.col("phi"))
    rows = folded(lc).withColumn("bin", bin_index(phi, 0.25, 0.75, bins)).where("bin is not null")
    return rows.groupBy("tic_id", "bin").agg(F.avg("flux").alias("flux"), F.count("flux").alias("n"))


def centroid_bins(lc: DataFrame, bins: int = 20) -> DataFrame:
    """Median centroid by phase bin: (tic_id, bin, c1, c2, n)."""
    rows = folded(lc).withColumn("bin", bin_index(F.col("phi"), -0.5, 0.5, bins)).where("bin is not null")
    return rows.groupBy("tic_id", "bin").agg(F.median("c1").alias("c1"), F.median("c2").alias("c2"), F.count("*").alias("n"))


def corner_bins(samples: DataFrame, keys: list[str], x: str, y: str, bins: int = 10) -> DataFrame:
    """Two-dimensional histogram of two posterior columns over their own ranges: (keys, i, j, n)."""
    span = samples.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in (x, y) for n, f in (("low", F.min), ("high", F.max))])

    def cell(c: str):
        part = (F.col(c) - F.col(f"{c}_low")) / F.nullif(F.col(f"{c}_high") - F.col(f"{c}_low"), F.lit(0.0))
        return F.coalesce(F.least(F.floor(part * bins), F.lit(bins - 1)), F.lit(0)).cast("int")

    rows = samples.where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(span, keys)
    return rows.groupBy(*keys, cell(x).alias("i"), cell(y).alias("j")).agg(F.count("*").alias("n"))
