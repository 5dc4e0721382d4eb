"""Box period search, candidates and their ranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio
from .batches import per_curve
from .series import good, normalised, star, time_bins


def period_grid(df: DataFrame, low: float, high: float, n: int) -> DataFrame:
    """n trial periods; a fixed, small table."""
    return df.sparkSession.range(n).select((F.lit(low) + F.col("id") * ((high - low) / n)).alias("period"))


def trial_periods(baseline: float, low: float = 0.5, longest: float = 27.0, dip: float = 1 / 60, oversampling: int = 3) -> np.ndarray:
    """Periods from ``low`` to min(longest, baseline / 2), even in frequency; empty for a short curve.

    One step moves a dip by a part ``1 / oversampling`` of its length ``dip`` (in periods) over the baseline.
    """
    high = min(longest, baseline / 2)
    if not high >= low:
        return np.array([])
    n = int(np.ceil((1 / low - 1 / high) * baseline * oversampling / dip)) + 1
    return 1 / (1 / low - np.arange(n) * ((1 / low - 1 / high) / max(1, n - 1)))


def strongest_box(t: np.ndarray, flux: np.ndarray, periods: np.ndarray, bins: int, widths: tuple[int, ...]) -> tuple | None:
    """(period, bin, width, sr, sde, depth, n_in) of the best box of some bins; None without a trial."""
    n = len(t)
    if not len(periods) or not n:
        return None
    t, dev = t - t.min(), flux - flux.mean()
    top = np.zeros(len(periods))
    block = max(1, 32_768 // n)  # small enough to stay in the cache
    size = np.arange(n + 1.0)
    spread = size * (n - size)
    spread[[0, n]] = np.inf  # no dip: nothing or all of it lies in the box
    values = np.tile(dev, block)
    shift = np.repeat(np.arange(block) * bins, n).reshape(block, n)

    def boxes(part: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(width, sums, counts, powers before rounding) of each period and first bin."""
        x = t[None, :] / part[:, None]
        x -= np.floor(x)
        x *= bins
        cell = np.minimum(x.astype(np.int64), bins - 1)
        cell += shift[: len(part)]
        cell = cell.ravel()
        around = [np.bincount(cell, w, len(part) * bins).reshape(-1, bins) for w in (values[: len(cell)], None)]
        around = [np.concatenate([v, v[:, np.arange(max(widths) - 1) % bins]], axis=1) for v in around]
        s, r = np.zeros((len(part), bins)), np.zeros((len(part), bins), dtype=np.int64)
        for w in range(1, max(widths) + 1):
            s = s + around[0][:, w - 1: w - 1 + bins]
            r = r + around[1][:, w - 1: w - 1 + bins]
            if w in widths:
                yield w, s, r, np.minimum(s, 0) ** 2 / spread[np.minimum(r, n)]

    for at in range(0, len(periods), block):
        best = top[at: at + block]
        for *_, power in boxes(periods[at: at + block]):
            np.maximum(best, power.max(axis=1), out=best)
    top = np.round(top, 9)
    k = len(top) - 1 - int(top[::-1].argmax()) if periods[0] > periods[-1] else int(top.argmax())  # ties: the shorter period
    if top[k] <= 0:
        return None
    # of equal powers the first in the order of ``widths``, then of bins
    found = {w: (s[0], r[0], np.round(power[0], 9)) for w, s, r, power in boxes(periods[k: k + 1])}
    w = max(widths, key=lambda w: found[w][2].max())
    s, r, power = found[w]
    b = int(power.argmax())
    where = b, w, s[b], r[b]
    b, w, s, r = where
    sd = top.std()
    return float(periods[k]), int(b), int(w), float(top[k]), float((top[k] - top.mean()) / sd) if sd else None, float(-s / r - s / (n - r)), int(r)


MIN_RAW, MIN_BINNED, TEN_MINUTES = 200, 100, 10 / 1440


def searchable(lc: DataFrame, min_raw: int = MIN_RAW, min_binned: int = MIN_BINNED, bin_days: float = TEN_MINUTES) -> DataFrame:
    """(tic_id, t, flux) in time bins, of stars with ``min_raw`` rows and ``min_binned`` bins at least."""
    rows = lc.where(F.col("t").isNotNull() & F.col("flux").isNotNull()).withColumn("__n", F.count("*").over(star()))
    binned = time_bins(rows.where(F.col("__n") >= min_raw), bin_days).withColumn("__n", F.count("*").over(star()))
    return binned.where(F.col("__n") >= min_binned).select("tic_id", "t", "flux")


def period_search(lc: DataFrame, low: float = 0.5, longest: float = 27.0, bins: int = 60, widths: tuple[int, ...] = (1, 2, 3, 4, 6), oversampling: int = 3, isolate: bool = False) -> DataFrame:
    """The strongest dip of each star over the periods that its own baseline allows.

    Boxes are ``widths`` bins wide and may wrap.  A star with no usable period has
    nulls.  Of boxes with the same power (to 9 digits) the shorter period counts, then
    the narrower box, then the earlier bin.  With ``isolate`` a star whose search fails is a row with its ``status``.
    """

    def one(t: np.ndarray, flux: np.ndarray) -> tuple | None:
        if isolate and not np.isfinite(flux).all():
            raise ValueError("flux is not finite")
        return strongest_box(t, flux, trial_periods(float(np.ptp(t)), low, longest, 1 / bins, oversampling), bins, widths) if len(t) else None

    found = per_curve(lc, one, "period double, bin bigint, width bigint, sr double, sde double, depth double, n_in bigint", isolate)
    return found if isolate else found.drop("status")


#: The fixed grid that the SQL of the registered queries holds.
SQL_GRID = {"low": 1.0, "high": 10.0, "n_periods": 60}


def powers(lc: DataFrame, low: float, high: float, n_periods: int, bins: int = 20) -> DataFrame:
    """(tic_id, period, sr): the strongest single-bin dip at every trial period of a fixed grid."""
    cells = _cells(lc, low, high, n_periods, bins)
    return cells.groupBy("tic_id", "period").agg(F.max("sr").alias("sr"))


def _cells(lc: DataFrame, low: float, high: float, n_periods: int, bins: int) -> DataFrame:
    """Sums of every star, trial period and phase bin with their power."""
    dev = lc.withColumn("dev", F.col("flux") - F.avg("flux").over(star())).withColumn("n", F.count("flux").over(star())).withColumn("start", F.min("t").over(star()))
    trial = dev.select("tic_id", "t", "start", "dev", "n").crossJoin(F.broadcast(period_grid(lc, low, high, n_periods)))
    x = (F.col("t") - F.col("start")) / F.col("period")
    cells = trial.groupBy("tic_id", "period", "n", F.floor((x - F.floor(x)) * bins).alias("bin")).agg(F.sum("dev").alias("s"), F.count("*").alias("r"))
    power = F.when((F.col("s") < 0) & (F.col("r") < F.col("n")), F.round(F.col("s") ** 2 / (F.col("r") * (F.col("n") - F.col("r"))), 9)).otherwise(0.0)
    return cells.withColumn("sr", power)


def box_search(lc: DataFrame, low: float = 0.5, high: float = 27.0, n_periods: int | None = None, bins: int | None = None) -> DataFrame:
    """``period_search``, or on a fixed grid of ``n_periods`` the strongest single-bin dip of each star.

    Rows meet the broadcast grid and are summed per (star, period, bin) before any
    wider shuffle.  ``sr = s^2 / (r (n - r))`` with s the summed deviation in the
    bin; ``sde`` compares the best period with all others.  Ties go to the shorter
    period, then the lower bin.
    """
    if n_periods is None:
        return period_search(lc, low, high, bins or 60)
    bins = bins or 20
    cells = _cells(lc, low, high, n_periods, bins)
    best = cells.groupBy("tic_id", "period", "n").agg(F.max(F.struct("sr", (-F.col("bin")).alias("b"), "s", "r")).alias("m"))
    per = best.groupBy("tic_id", "n").agg(F.max(F.struct(F.col("m.sr").alias("sr"), (-F.col("period")).alias("p"), (-F.col("m.b")).alias("bin"), F.col("m.s").alias("s"), F.col("m.r").alias("r"))).alias("m"), F.avg("m.sr").alias("mean"), F.stddev_pop("m.sr").alias("sd"))
    depth = -F.col("m.s") / F.col("m.r") - F.col("m.s") / F.nullif(F.col("n") - F.col("m.r"), F.lit(0))
    return per.select("tic_id", (-F.col("m.p")).alias("period"), F.col("m.bin").alias("bin"), F.col("m.sr").alias("sr"), ratio(F.col("m.sr") - F.col("mean"), F.col("sd")).alias("sde"), depth.alias("depth"), F.col("m.r").alias("n_in"))


def is_candidate(sde, fap=None, min_sde: float = 7.0, max_fap: float = 0.01):
    """SDE high enough, and the false-alarm probability low or unknown."""
    low = F.lit(True) if fap is None else fap.isNull() | (fap < max_fap)
    return F.coalesce((sde >= min_sde) & low, F.lit(False))


def ranked_dips(lc: DataFrame, min_days: float = 13.5, min_sde: float = 2.0, top: int = 50, **grid) -> DataFrame:
    """Mask, normalise, gate on length, search, cut, rank: a top-k report."""
    curves = normalised(good(lc)).withColumn("base", F.max("t").over(star()) - F.min("t").over(star())).where(F.col("base") >= min_days).drop("base")
    found = box_search(curves, **grid)
    found = found.withColumn("sde", F.round("sde", 6)).where(is_candidate(F.col("sde"), min_sde=min_sde))
    best = found.orderBy(F.desc("sde"), "tic_id").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sde"), "tic_id")))


def selected(scores: DataFrame, min_prob: float = 0.5, top: int | None = None) -> DataFrame:
    """Rows to fit, best first: done, with a period, not synthetic, probable enough.

    Where a row has no probability, the detection cuts decide and sde orders it behind.
    """
    c = F.col
    rows = scores.where((c("status") == "done") & c("period").isNotNull() & ~c("tic_id").startswith("SYN_"))
    rows = rows.where(F.coalesce(c("p_transit") >= min_prob, is_candidate(c("sde"), c("fap"))))
    rows = rows.orderBy(F.desc_nulls_last("p_transit"), F.desc_nulls_last("sde"), "tic_id")
    return rows.limit(top) if top else rows


def false_alarm(sr, n, variance, trials):
    """Chance that noise of this variance gives a box as strong in so many independent trials.

    The summed deviation s of r of n rows has the variance var * r * (n - r) / n, so
    z^2 = sr * n / variance is that of a normal variable, of which only dips count; its tail is Abramowitz and Stegun's 26.2.17 with five terms.
    """
    z = F.sqrt(sr * n / F.nullif(variance, F.lit(0.0)))
    # The coefficients of the approximation.
    k = 1 / (1 + 0.2316419 * z)
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return 1 - F.exp(trials * F.log1p(-tail))


def candidates(lc: DataFrame, min_sde: float = 7.0, max_fap: float = 0.01, bins: int = 60, oversampling: int = 3, widths: tuple[int, ...] = (1, 2, 3, 4, 6), **gates) -> DataFrame:
    """Search over each star's own periods, geometry of the best dip, and the decision.

    One row for each star that passes the gates of ``searchable``.  ``fap`` is ``false_alarm``
    with a trial for each period; a star without a usable period is no candidate.
    """
    c = F.col
    rows = searchable(lc, **gates)
    whole = rows.groupBy("tic_id").agg(F.min("t").alias("start"), (F.max("t") - F.min("t")).alias("baseline"), F.count("*").alias("n"), F.var_pop("flux").alias("var"))
    found = period_search(rows, bins=bins, widths=widths, oversampling=oversampling).join(whole, "tic_id")
    high = F.least(F.lit(27.0), c("baseline") / 2)
    trials = F.ceil((1 / F.lit(0.5) - 1 / high) * c("baseline") * oversampling * bins) + 1
    found = found.withColumn("fap", false_alarm(c("sr"), c("n"), c("var"), trials.cast("double")))
    out = found.select(
        "tic_id", "period", "depth", (c("depth") * 1e6).alias("depth_ppm"), (c("period") / bins * c("width") * 24).alias("duration_hr"), F.floor(c("baseline") / c("period")).alias("transit_count"), "sde", "fap",
        (ratio(c("depth"), F.sqrt("var")) * F.sqrt("n_in")).alias("snr"), (c("start") + (c("bin") + c("width") * 0.5) / bins * c("period")).alias("t0"),
        F.when(c("depth") >= 0, F.sqrt("depth")).alias("rp_rs"), (c("width") / F.lit(float(bins))).alias("phase_coverage"),
    )
    return out.withColumn("is_candidate", is_candidate(c("sde"), c("fap"), min_sde, max_fap))


def geometry(lc: DataFrame, bins: int | None = None, **grid) -> DataFrame:
    """Geometry features of each star's best period; all null where none was found.

    The dip is as wide as the box; on a fixed grid, one bin.  ``rp_rs`` is null where the best bin is no dip.
    """
    c = F.col
    whole = lc.groupBy("tic_id").agg(F.min("t").alias("start"), (F.max("t") - F.min("t")).alias("baseline"), F.stddev_pop("flux").alias("sd"))
    found = box_search(lc, bins=bins, **grid)
    bins = bins or (20 if "n_periods" in grid else 60)
    wide = c("width") if "width" in found.columns else F.lit(1)
    found = found.join(whole, "tic_id")
    return found.select(
        "tic_id", "period", "depth", (c("depth") * 1e6).alias("depth_ppm"), (c("period") / bins * wide * 24).alias("duration_hr"), F.floor(c("baseline") / c("period")).alias("transit_count"), "sde",
        (ratio(c("depth"), c("sd")) * F.sqrt("n_in")).alias("snr"), (c("start") + (c("bin") + wide * 0.5) / bins * c("period")).alias("t0"), F.when(c("depth") >= 0, F.sqrt("depth")).alias("rp_rs"), F.when(c("period").isNotNull(), wide / F.lit(float(bins))).alias("phase_coverage"),
    )


def routed(df: DataFrame, probs: str, cut: float = 0.65) -> DataFrame:
    """``predicted`` class, its ``confidence``, and whether a person should look: confidence below ``cut``.

    Ties go to the lower class; a null or empty array gives nulls.
    """
    best = F.array_max(F.transform(probs, lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
    out = df.withColumn("__best", best)
    out = out.withColumn("predicted", (-F.col("__best.i")).cast("int")).withColumn("confidence", F.col("__best.p"))
    return out.withColumn("to_review", F.col("confidence") < cut).drop("__best")
