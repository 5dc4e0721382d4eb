"""Posterior samples after the fit: chain diagnostics, model bands and residuals, all as grouped aggregates.

Samples are rows: a star with thousands of draws is many rows, never one value.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bin_index, hours_from_mid, ratio
from ..plans import cached
from ..shared import spread
from .batches import per_star, whole_stars
from .fitting import detrended, residuals, sampled, separation, transit_model


def split_rhat(chains: DataFrame, keys: Sequence[str], chain: str, step: str, value: str) -> DataFrame:
    """(keys, chains, draws, mean, sd, rhat): split R-hat of rows (keys, chain, step, value).

    Each chain is cut in two at the middle of its own steps (the later half has the middle one);
    rhat compares the spread of the halves' means with the spread inside them.  It is null
    where a half has one draw or none, or nothing varies.
    """
    rows = chains.where(F.col(value).isNotNull())
    span = rows.groupBy(*keys, chain).agg(((F.min(step) + F.max(step)) / 2).alias("__middle"))
    halves = rows.join(span, [*keys, chain]).groupBy(*keys, chain, (F.col(step) >= F.col("__middle")).alias("__late"))
    halves = halves.agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    n, c = F.avg("n"), F.col
    out = halves.groupBy(*keys).agg(
        F.count_distinct(chain).alias("chains"), F.sum("n").alias("draws"), F.sum("s").alias("s"), F.sum("q").alias("q"), n.alias("n"), F.avg("v").alias("within"), F.var_samp("m").alias("between"), F.min("n").alias("least"),
    )
    whole = (c("n") - 1) / c("n") * c("within") + c("between")
    mean = c("s") / c("draws")
    return out.select(*keys, "chains", "draws", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), c("q") / c("draws") - mean * mean)).alias("sd"), F.when((c("least") > 1) & (c("within") > 0), F.sqrt(whole / c("within"))).alias("rhat"))


def batch_effective_size(chains: DataFrame, keys: Sequence[str], chain: str, step: str, value: str, length: int) -> DataFrame:
    """(keys, ess): effective size by batch means, ``draws * var / (length * var of the batches' means)``.

    Batches are runs of ``length`` steps of a chain, from step 0; partial aggregation merges them.
    """
    batches = chains.where(F.col(value).isNotNull()).groupBy(*keys, chain, F.floor(F.col(step) / length).alias("__batch"))
    batches = batches.agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q")).where(F.col("n") == length)
    c = F.col
    out = batches.groupBy(*keys).agg(F.sum("n").alias("draws"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.var_samp("m").alias("between"))
    var = c("q") / c("draws") - (c("s") / c("draws")) ** 2
    return out.select(*keys, F.least(c("draws").cast("double"), ratio(c("draws") * var, length * c("between"))).alias("ess"))


def effective_size(chains: np.ndarray) -> float:
    """Bulk effective size of chains[chain, step] by Geyer's initial monotone sequence over all chains."""
    m, n = chains.shape
    if n < 4:
        return float("nan")
    dev = chains - chains.mean(axis=1, keepdims=True)
    f = np.fft.rfft(dev, 2 * n, axis=1)
    acov = np.fft.irfft((f * f.conj()).real, axis=1)[:, :n].mean(axis=0) / n
    within = acov[0] * n / (n - 1)
    total = within * (n - 1) / n + (chains.mean(axis=1).var(ddof=1) if m > 1 else 0.0)
    if total <= 0:
        return float("nan")
    rho = 1 - (within - acov * n / (n - 1)) / total
    pairs = rho[: n // 2 * 2].reshape(-1, 2).sum(axis=1)
    stop = np.flatnonzero(pairs < 0)
    pairs = np.minimum.accumulate(pairs[: stop[0] if len(stop) else len(pairs)])
    return float(m * n / max(2 * pairs.sum() - 1, 1 / np.log10(m * n + 1)))


def bulk_effective_sizes(chains: DataFrame, chain: str = "chain", step: str = "step", value: str = "value") -> DataFrame:
    """(tic_id, ess) of the long rows of each star; a star's chains fit in a task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index=chain, columns=step, values=value).dropna(axis=1).to_numpy(float)
        half = wide.shape[1] // 2
        split = np.concatenate([wide[:, :half], wide[:, wide.shape[1] - half:]])
        return pd.DataFrame({"tic_id": [str(pdf["tic_id"].iloc[0])], "ess": [effective_size(split)]})

    return per_star(chains.select("tic_id", chain, step, value), one, "tic_id string, ess double", True)


def cached_samples(spark: SparkSession, folder: str, lc: DataFrame, **options) -> DataFrame:
    """Posterior samples of all stars of ``lc``; sampled once and read from ``folder`` later on."""
    return cached(spark, folder, lambda: sampled(lc, **options))


#: Central and one- and two-sigma limits of a band.
LIMITS = (0.025, 0.16, 0.5, 0.84, 0.975)


def model_band(samples: DataFrame, hours: Sequence[float], limits: Sequence[float] = LIMITS, rings: int = 100, most: int = 50_000) -> DataFrame:
    """(tic_id, hours, q0, q1, ...): percentiles of the model flux over the draws, at hours from the star's own t0.

    Samples have tic_id, tc, rp_rs, b, ln_a, period and t0.  Draws travel to their star as they are and become
    curves there; percentiles are exact.  The draws of a star with more than ``most`` may lie in
    any number of tasks: its percentiles come from a mergeable sketch.  Samples are read twice, to count and to draw.
    """
    grid = np.asarray(hours, float) / 24

    def curves(pdf: pd.DataFrame) -> np.ndarray:
        p = pdf[["tc", "rp_rs", "b", "ln_a", "period", "t0"]].to_numpy(float)
        col = lambda i: p[:, i: i + 1]
        t = col(5) + grid[None, :]
        flux = np.concatenate([transit_model(separation(t[a: a + 500], p[a: a + 500, 0:1], p[a: a + 500, 4:5], np.exp(p[a: a + 500, 3:4]), p[a: a + 500, 2:3]), p[a: a + 500, 1:2], rings=rings) for a in range(0, len(p), 500)])
        return np.round(flux, 9)

    def exact(batches):
        for pdf in whole_stars(batches, 10_000):
            star, flux, out = pdf["tic_id"].to_numpy(), curves(pdf), []
            edge = np.append(np.flatnonzero(np.append(True, star[1:] != star[:-1])), len(star))
            for a, b in zip(edge[:-1], edge[1:]):
                n = b - a
                rank = [max(1, n - int(np.floor(n - q * n))) - 1 for q in limits]
                values = np.sort(flux[a:b], axis=0)[rank]
                out += [(star[a], i, values[:, i]) for i in range(len(grid))]
            yield pd.DataFrame(out, columns=["tic_id", "i", "q"])

    def spread_out(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"tic_id": pdf["tic_id"], "flux": list(curves(pdf))})

    rows = samples.select(F.col("tic_id").cast("string").alias("tic_id"), "tc", "rp_rs", "b", "ln_a", "period", "t0").dropna()
    crowded = F.broadcast(rows.groupBy("tic_id").count().where(F.col("count") > most).select("tic_id"))  # one for each ``most`` draws at most
    few = spread(rows.join(crowded, "tic_id", "left_anti"), "tic_id").sortWithinPartitions("tic_id").mapInPandas(exact, "tic_id string, i int, q array<double>")
    many = rows.join(crowded, "tic_id", "left_semi").mapInPandas(spread_out, "tic_id string, flux array<double>").select("tic_id", F.posexplode("flux").alias("i", "flux"))
    many = many.groupBy("tic_id", "i").agg(F.percentile_approx("flux", F.lit(list(limits)), 10_000).alias("q"))
    at = F.element_at(F.array(*[F.lit(float(h)) for h in hours]), F.col("i") + 1)
    return few.unionByName(many).select("tic_id", at.alias("hours"), *[F.col("q")[k].alias(f"q{k}") for k in range(len(limits))])


def residual_bins(lc: DataFrame, width: float, bins: int) -> DataFrame:
    """(tic_id, bin, residual, n): mean residual (in sigmas) by hours from mid-time, within ``width`` hours on both sides.

    Needs what ``fitting.residuals`` needs.
    """
    given = lc.select("event_id", F.col("period").alias("__period"), F.col("t0").alias("__t0"))
    rows = residuals(lc).join(given, "event_id")
    hours = hours_from_mid(F.col("t"), F.col("__period"), F.col("__t0"))
    rows = rows.withColumn("bin", bin_index(hours, -width, width, bins)).where("bin IS NOT NULL AND residual IS NOT NULL")
    return rows.groupBy("tic_id", "bin").agg(F.avg("residual").alias("residual"), F.count("*").alias("n"))


def trend_points(lc: DataFrame, width: float = 0.75) -> DataFrame:
    """(tic_id, event_id, t, flux, trend, epoch, in_dip): the raw series with its trend and the epochs of its ephemeris."""
    trend = detrended(lc, width).select("event_id", "trend")
    epoch = F.rint((F.col("t") - F.col("t0")) / F.col("period"))
    away = F.abs(F.col("t") - F.col("t0") - epoch * F.col("period"))
    return lc.join(trend, "event_id").select("tic_id", "event_id", "t", "flux", "trend", epoch.cast("bigint").alias("epoch"), (away < F.col("dur") / 2).alias("in_dip"))
