"""Time-series operators on long-form curves (tic_id, t, flux, ...).

All windows of a star share one partitioning, so a chain of operators shuffles
once on the star's id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import BAD_QUALITY, bin_index, phase, ratio

SIGMA_OF_MAD = 1.4826


def star() -> WindowSpec:
    return Window.partitionBy("tic_id")


def in_time() -> WindowSpec:
    return star().orderBy("t", "event_id")


def good(lc: DataFrame, mask: int = BAD_QUALITY) -> DataFrame:
    return lc.where(F.col("quality").bitwiseAND(mask) == 0)


def at_least(lc: DataFrame, n: int) -> DataFrame:
    """Stars with n rows or more."""
    return lc.withColumn("__n", F.count("*").over(star())).where(F.col("__n") >= n).drop("__n")


def normalised(lc: DataFrame) -> DataFrame:
    """``flux`` over the star's median; null where that is 0 or null."""
    return lc.withColumn("flux", ratio(F.col("flux"), F.median("flux").over(star())))


def mad_sigma(lc: DataFrame) -> DataFrame:
    dev = lc.withColumn("dev", F.abs(F.col("flux") - F.median("flux").over(star())))
    return dev.groupBy("tic_id").agg((F.median("dev") * SIGMA_OF_MAD).alias("sigma"))


def p2p_sigma(lc: DataFrame) -> DataFrame:
    d = lc.withColumn("d", F.col("flux") - F.lag("flux").over(in_time())).where("d is not null")
    dev = d.withColumn("dev", F.abs(F.col("d") - F.median("d").over(star())))
    return dev.groupBy("tic_id").agg((F.median("dev") * SIGMA_OF_MAD / F.sqrt(F.lit(2.0))).alias("sigma"))


def gap_flags(lc: DataFrame, cadence: float, slack: float = 4.5) -> DataFrame:
    """``dt`` and ``after_gap``: true on the row behind a gap."""
    dt = F.col("t") - F.lag("t").over(in_time())
    return lc.withColumn("dt", dt).withColumn("after_gap", F.coalesce(F.col("dt") > cadence * slack, F.lit(False)))


def longest_segment(lc: DataFrame, gap: float = 30.0) -> DataFrame:
    """Rows of each star's longest run without gaps, the first of equal ones."""
    cut = lc.withColumn("cut", F.coalesce(F.col("t") - F.lag("t").over(in_time()) > gap, F.lit(False)).cast("int"))
    seg = cut.withColumn("seg", F.sum("cut").over(in_time().rowsBetween(Window.unboundedPreceding, 0)))
    size = seg.withColumn("n", F.count("*").over(Window.partitionBy("tic_id", "seg")))
    best = size.withColumn("best", F.max(F.struct(F.col("n"), (-F.col("seg")).alias("s"))).over(star()))
    return best.where("seg = -best.s").drop("cut", "n", "best")


def clipped(lc: DataFrame, sigma: float = 3.0, rounds: int = 5) -> DataFrame:
    """Drops flux above median + sigma * std, again and again; low values stay."""
    for _ in range(rounds):
        top = F.median("flux").over(star()) + sigma * F.stddev_pop("flux").over(star())
        lc = lc.withColumn("__top", top).where("flux <= __top").drop("__top")
    return lc


def rolling_median(lc: DataFrame, half: float) -> DataFrame:
    """``trend``: median of the flux within ``half`` days on either side."""
    frame = f"PARTITION BY tic_id ORDER BY t RANGE BETWEEN {half!r}D PRECEDING AND {half!r}D FOLLOWING"
    return lc.withColumn("trend", F.expr(f"percentile(flux, 0.5D) OVER ({frame})"))


def time_bins(lc: DataFrame, size: float) -> DataFrame:
    start = lc.withColumn("k", F.floor((F.col("t") - F.min("t").over(star())) / size))
    return start.groupBy("tic_id", "k").agg(F.avg("t").alias("t"), F.avg("flux").alias("flux"), F.count("*").alias("n"))


def folded(lc: DataFrame) -> DataFrame:
    """``phi`` from the period and t0 columns."""
    return lc.withColumn("phi", phase(F.col("t"), F.col("period"), F.col("t0")))


def fold_bins(lc: DataFrame, bins: int = 200) -> DataFrame:
    """Mean flux of every phase bin that has rows."""
    rows = folded(lc).withColumn("bin", bin_index(F.col("phi"), -0.5, 0.5, bins)).where("bin is not null")
    return rows.groupBy("tic_id", "bin").agg(F.avg("flux").alias("flux"), F.count("*").alias("n"))


def gap_filled(lc: DataFrame) -> DataFrame:
    """Null flux by linear interpolation between neighbours; ends stay null."""
    before = in_time().rowsBetween(Window.unboundedPreceding, 0)
    after = in_time().rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("flux").isNotNull(), F.struct("t", "flux"))
    lc = lc.withColumn("__a", F.last(known, ignorenulls=True).over(before)).withColumn("__b", F.first(known, ignorenulls=True).over(after))
    slope = ratio(F.col("__b.flux") - F.col("__a.flux"), F.col("__b.t") - F.col("__a.t"))
    return lc.withColumn("flux", F.coalesce("flux", F.col("__a.flux") + slope * (F.col("t") - F.col("__a.t")))).drop("__a", "__b")


def autocorrelation(lc: DataFrame, lag: int) -> DataFrame:
    """Pearson correlation of the flux with itself ``lag`` rows earlier; null without spread."""
    p = lc.withColumn("y", F.lag("flux", lag).over(in_time())).where("y is not null AND flux is not null")
    s = p.groupBy("tic_id").agg(F.count("*").alias("n"), F.sum("flux").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("flux") * F.col("y")).alias("sxy"), F.sum(F.col("flux") ** 2).alias("sxx"), F.sum(F.col("y") ** 2).alias("syy"))
    spread = (F.col("n") * F.col("sxx") - F.col("sx") ** 2) * (F.col("n") * F.col("syy") - F.col("sy") ** 2)
    return s.select("tic_id", ratio(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.when(spread > 0, F.sqrt(spread))).alias("ac"))


def quality_gate(lc: DataFrame, min_days: float = 13.5, max_rms: float = 0.02) -> DataFrame:
    """Status and reason of every star: too short, too noisy, or done."""
    dev = lc.withColumn("dev", F.abs(F.col("flux") - F.median("flux").over(star())))
    s = dev.groupBy("tic_id").agg((F.max("t") - F.min("t")).alias("baseline_days"), (F.median("dev") * SIGMA_OF_MAD).alias("rms"))
    reason = F.when(F.col("baseline_days") < min_days, "short baseline").when(F.col("rms") > max_rms, "noisy")
    return s.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "done").otherwise("gated"))


def interpolated(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Flux of each star at the times of a grid (tic_id, t), linear between neighbours."""
    both = points.select("tic_id", "t", "event_id", "flux", F.lit(False).alias("asked"))
    both = both.unionByName(grid.select("tic_id", "t", F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("double").alias("flux"), F.lit(True).alias("asked")))
    return gap_filled(both).where("asked").select("tic_id", "t", "flux")


def thinned(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """n evenly spaced rows of each key, the first and the last among them."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    slot = F.floor(F.col("__i") * (n - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    before = F.floor((F.col("__i") - 1) * (n - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    return rows.where((F.col("__n") <= n) | (F.col("__i") == 0) | (slot > before)).drop("__i", "__n")


def adaptive_bins(lc: DataFrame, most: int = 6000, size: float = 6 / 1440) -> DataFrame:
    """(tic_id, t, flux, n): time bins for stars with more than ``most`` rows, single rows for others."""
    rows = lc.withColumn("__n", F.count("*").over(star())).withColumn("__k", F.floor((F.col("t") - F.min("t").over(star())) / size))
    key = F.when(F.col("__n") > most, F.struct(F.col("__k").alias("k"), F.lit(None).cast("bigint").alias("e"))).otherwise(F.struct(F.lit(None).cast("bigint").alias("k"), F.col("event_id").alias("e")))
    return rows.groupBy("tic_id", key.alias("__key")).agg(F.avg("t").alias("t"), F.avg("flux").alias("flux"), F.count("*").alias("n")).drop("__key")


def epochs(lc: DataFrame) -> DataFrame:
    """(tic_id, epoch, mid): every predicted mid-time within each star's range."""
    span = lc.groupBy("tic_id").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.first("period").alias("period"), F.first("t0").alias("t0"))
    first, last = F.ceil((F.col("a") - F.col("t0")) / F.col("period")), F.floor((F.col("b") - F.col("t0")) / F.col("period"))
    rows = span.where(last >= first).select("tic_id", "period", "t0", F.explode(F.sequence(first, last)).alias("epoch"))
    return rows.select("tic_id", "epoch", (F.col("t0") + F.col("epoch") * F.col("period")).alias("mid"))


def epoch_windows(lc: DataFrame) -> DataFrame:
    """(tic_id, epoch, n, flux): rows within half a dip of each predicted mid-time.

    The nearest epoch of a row is arithmetic, so the interval join is one on (star, epoch).
    """
    near = F.rint((F.col("t") - F.col("t0")) / F.col("period")).cast("bigint")
    rows = lc.withColumn("epoch", near).where(F.abs(F.col("t") - F.col("t0") - F.col("epoch") * F.col("period")) < F.col("dur") / 2)
    seen = rows.groupBy("tic_id", "epoch").agg(F.count("flux").alias("n"), F.avg("flux").alias("flux"))
    return epochs(lc).join(seen, ["tic_id", "epoch"], "left").select("tic_id", "epoch", "mid", F.coalesce("n", F.lit(0)).alias("n"), "flux")
