"""Search for limb-darkened dips, and how often noise alone gives one as strong.

A bank of dip shapes covers the lengths of dips in steps of a few per cent.  A curve
is folded at each trial period into phase bins; circular correlations of the bins
with every shape give, for every phase at once, the weighted least-squares
depth and how much it lowers the sum of squares.  Curves are streamed through
tasks in blocks, sorted by star; a task holds one curve and the powers of some periods.

A false-alarm chance is not read from a table of trials: the same search runs over curves
whose values have changed places, the strongest dips of those are summed up by classes of
length and baseline, and a Gumbel law with the class's mean and spread gives the tail.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ratio
from .batches import per_curve
from .fitting import LIMB, transit_model
from .search import MIN_BINNED, MIN_RAW, TEN_MINUTES, is_candidate, searchable, trial_periods

LONGEST = 0.12  # of a period
STEP = 1.05
LEAST = 1e-6  # spread of a shape over the rows, below which no depth is fitted
ELEMENTS = 500_000  # of one array of correlations

#: Depth of the middle of a dip over the square of the radius ratio.
CENTRAL = 1 / (1 - LIMB[0] / 3 - LIMB[1] / 6)


def template_bank(bins: int, low: float | None = None, high: float = LONGEST, step: float = STEP, ratio_: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shapes[k, bins], lengths in periods, bins that each covers), shortest first.

    A shape starts at bin 0 and is 1 at its deepest point before it is averaged over bins;
    its middle is the middle of the bins it covers.  Lengths run from one bin in steps of ``step``.
    """
    low = 1 / bins if low is None else low
    shapes, lengths, covers = [], [], []
    length = low
    while length <= high * (1 + 1e-9):
        cover = min(bins, max(1, math.ceil(length * bins - 1e-9)))
        fine = (np.arange(cover * 16) + 0.5) / 16 - cover / 2  # in bins from the middle
        loss = 1 - transit_model(np.abs(fine) / (length * bins / 2) * (1 + ratio_), ratio_, rings=3_000)
        shape = np.zeros(bins)
        shape[:cover] = (loss / loss.max()).reshape(cover, 16).mean(axis=1)
        shapes.append(np.round(shape, 9))
        lengths.append(length)
        covers.append(cover)
        length *= step
    return np.array(shapes).reshape(-1, bins), np.array(lengths), np.array(covers)


def strongest_shape(t: np.ndarray, flux: np.ndarray, periods: np.ndarray, shapes: np.ndarray) -> tuple | None:
    """(period, bin, shape, power, sde, depth, n_in) of the best shape; None without a dip.

    ``power`` is what the dip takes off the sum of squares.  Of equal powers (to 9 digits)
    the shorter period counts, then the shorter shape, then the earlier bin.
    """
    n, (k, bins) = len(t), shapes.shape
    if not len(periods) or not n:
        return None
    t, dev = t - t.min(), flux - flux.mean()
    g, gg = np.conj(np.fft.rfft(shapes)), np.conj(np.fft.rfft(shapes ** 2))
    top, where = np.zeros(len(periods)), np.zeros(len(periods), dtype=np.int64)
    depth = np.zeros(len(periods))
    block = max(1, min(ELEMENTS // (k * bins), 4 * ELEMENTS // n))
    for at in range(0, len(periods), block):
        part = periods[at: at + block]
        x = t[None, :] / part[:, None]
        cell = np.minimum(((x - np.floor(x)) * bins).astype(np.int64), bins - 1) + np.arange(len(part))[:, None] * bins
        sums = np.fft.rfft(np.bincount(cell.ravel(), np.broadcast_to(dev, cell.shape).ravel(), len(part) * bins).reshape(-1, bins))
        rows = np.fft.rfft(np.bincount(cell.ravel(), minlength=len(part) * bins).reshape(-1, bins))
        with_dev, with_one, with_self = (np.fft.irfft(a[:, None, :] * b[None], bins) for a, b in ((sums, g), (rows, g), (rows, gg)))
        spread = with_self - with_one ** 2 / n
        fits = (with_dev < -1e-12) & (spread > LEAST)
        power = np.where(fits, np.round(with_dev ** 2 / np.where(fits, spread, 1), 9), 0.0).reshape(len(part), -1)
        best = power.argmax(axis=1)
        who = np.arange(len(part))
        top[at: at + block], where[at: at + block] = power[who, best], best
        depth[at: at + block] = (-with_dev / np.where(fits, spread, 1)).reshape(len(part), -1)[who, best]
    j = len(top) - 1 - int(top[::-1].argmax()) if periods[0] > periods[-1] else int(top.argmax())
    if top[j] <= 0:
        return None
    shape, first = divmod(int(where[j]), bins)
    x = t / periods[j]
    inside = shapes[shape][(np.minimum(((x - np.floor(x)) * bins).astype(np.int64), bins - 1) - first) % bins] > 0
    sd = top.std()
    return float(periods[j]), first, shape, float(top[j]), float((top[j] - top.mean()) / sd) if sd else None, float(depth[j]), int(inside.sum())


def template_search(lc: DataFrame, low: float = 0.5, longest: float = 27.0, bins: int = 128, oversampling: int = 3, bank: tuple | None = None) -> DataFrame:
    """(tic_id, status, period, bin, shape, power, sde, depth, n_in, n, var, start, baseline) of every star."""
    shapes, _, _ = template_bank(bins) if bank is None else bank
    bins = shapes.shape[1]

    def one(t: np.ndarray, flux: np.ndarray) -> tuple | None:
        if not len(t):
            return None
        if not np.isfinite(flux).all():
            raise ValueError("flux is not finite")
        baseline = float(np.ptp(t))
        found = strongest_shape(t, flux, trial_periods(baseline, low, longest, 1 / bins, oversampling), shapes) or (None,) * 7
        return *found, len(t), float(flux.var()), float(t.min()), baseline

    return per_curve(lc, one, "period double, bin bigint, shape bigint, power double, sde double, depth double, n_in bigint, n bigint, var double, start double, baseline double")


def permuted(lc: DataFrame, seed: int = 42) -> DataFrame:
    """Curves whose values have changed places, by the order of a hash of seed and event: noise with each curve's own times and values."""
    key = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("event_id").cast("string")))
    rows = lc.where(F.col("t").isNotNull() & F.col("flux").isNotNull()).groupBy("tic_id").agg(
        F.array_sort(F.collect_list(F.struct("t", "event_id"))).alias("a"), F.array_sort(F.collect_list(F.struct(key.alias("key"), "event_id", "flux"))).alias("b"),
    )
    return rows.select("tic_id", F.inline(F.zip_with("a", "b", lambda a, b: F.struct(a.event_id.alias("event_id"), a.t.alias("t"), b.flux.alias("flux")))))


def strength(found: DataFrame) -> DataFrame:
    """Adds ``drop``, the power in units of the curve's variance, and the classes of length and baseline (powers of two)."""
    c = F.col
    return found.withColumn("drop", ratio(c("power"), c("var"))).withColumn("n_class", F.floor(F.log2("n"))).withColumn("base_class", F.floor(F.log2(F.greatest("baseline", F.lit(1e-9)))))


def null_law(noise: DataFrame, least: int = 30) -> DataFrame:
    """(n_class, base_class, middle, scale, draws): the Gumbel law of ``drop`` in noise, by grouped moments.

    Classes with fewer than ``least`` draws take the law of all draws.
    """
    kept = strength(noise).where("drop IS NOT NULL")
    moments = [F.avg("drop").alias("mean"), F.stddev_samp("drop").alias("sd"), F.count("*").alias("draws")]
    whole = kept.agg(*[m.alias(f"all_{n}") for m, n in zip(moments, ("mean", "sd", "draws"))])
    law = kept.groupBy("n_class", "base_class").agg(*moments).crossJoin(whole)  # a row each, with the one row of all
    few = F.col("draws") < least
    sd = F.when(few, F.col("all_sd")).otherwise(F.col("sd"))
    scale = sd * math.sqrt(6) / math.pi
    middle = F.when(few, F.col("all_mean")).otherwise(F.col("mean")) - scale * 0.5772156649015329
    return law.select("n_class", "base_class", middle.alias("middle"), scale.alias("scale"), F.when(few, F.col("all_draws")).otherwise(F.col("draws")).alias("draws"))


def with_false_alarm(found: DataFrame, law: DataFrame) -> DataFrame:
    """Adds ``fap``: the chance of as strong a dip in noise of the curve's class; null without a dip or a law."""
    z = (F.col("drop") - F.col("middle")) / F.nullif(F.col("scale"), F.lit(0.0))
    rows = strength(found).join(law, ["n_class", "base_class"], "left")
    return rows.withColumn("fap", -F.expm1(-F.exp(-z)))


def template_candidates(lc: DataFrame, min_sde: float = 7.0, max_fap: float = 0.01, seed: int = 42, bins: int = 128, bank: tuple | None = None, least: int = 30, min_raw: int = MIN_RAW, min_binned: int = MIN_BINNED, bin_days: float = TEN_MINUTES, **search) -> DataFrame:
    """Best limb-darkened dip of each star that passes the gates, its geometry, calibrated ``fap`` and the decision.

    A star whose curve cannot be searched keeps its row with a status.  A star is a candidate if
    its sde is high and its ``fap`` low or unknown.
    """
    c = F.col
    bank = template_bank(bins) if bank is None else bank
    shapes, lengths, covers = bank
    gates = {"min_raw": min_raw, "min_binned": min_binned, "bin_days": bin_days}
    real = template_search(searchable(lc, **gates), bank=bank, **search)
    noise = template_search(searchable(permuted(lc, seed), **gates), bank=bank, **search)
    found = with_false_alarm(real, null_law(noise, least))
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (c("shape") + 1).cast("int"))
    found = found.withColumn("length", pick(lengths)).withColumn("cover", pick(covers))
    out = found.select(
        "tic_id", "status", "period", "depth", (c("depth") * 1e6).alias("depth_ppm"), (c("period") * c("length") * 24).alias("duration_hr"), F.floor(c("baseline") / c("period")).alias("transit_count"), "sde",
        (ratio(c("depth"), F.sqrt("var")) * F.sqrt("n_in")).alias("snr"), "fap", (c("start") + (c("bin") + c("cover") / 2) / shapes.shape[1] * c("period")).alias("t0"),
        F.when(c("depth") >= 0, F.sqrt(c("depth") / CENTRAL)).alias("rp_rs"), c("length").alias("phase_coverage"),
    )
    return out.withColumn("is_candidate", is_candidate(c("sde"), c("fap"), min_sde, max_fap))
