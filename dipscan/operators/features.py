"""Per-star features from folded curves: shape, parity, centroid, statistics, Fourier."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip, ratio
from .series import folded, in_time, star


def _median_where(cond: Column, value: str = "flux") -> Column:
    return F.median(F.when(cond, F.col(value)))


def shape(lc: DataFrame, min_points: int = 8, min_total: int = 32) -> DataFrame:
    """Flat bottom, asymmetry and secondary of each star; one grouped pass.

    Needs period, t0 and dur (in days) columns.  Null where a zone has too few points
    or the core is no dip.
    """
    half, phi = F.col("dur") / F.col("period") / 2, F.col("phi")
    a = F.abs(phi)
    zones = {
        "base": (a > half * 0.8) & (a < half * 3), "core": a < half * 0.35, "shoulder": (a >= half * 0.55) & (a < half * 0.85),
        "left": (phi >= -half) & (phi < half * -0.1), "right": (phi > half * 0.1) & (phi <= half), "second": F.least(F.abs(phi - 0.5), F.abs(phi + 0.5)) < half,
    }
    s = folded(lc).groupBy("tic_id").agg(F.count("flux").alias("n"), *[_median_where(c).alias(k) for k, c in zones.items()], *[F.count(F.when(c, F.col("flux"))).alias(f"n_{k}") for k, c in zones.items()])
    core = F.col("base") - F.col("core")
    sound = (F.col("n") >= min_total) & (F.col("n_base") >= min_points) & (F.col("n_core") >= min_points) & (core > 0)
    part = lambda c, *zones_: F.when(sound & F.least(*[F.col(f"n_{z}") for z in zones_], F.lit(1 << 30)).__ge__(min_points), c)
    second = F.greatest(F.col("base") - F.col("second"), F.lit(0.0))
    return s.select(
        "tic_id", part(clip((F.col("base") - F.col("shoulder")) / F.nullif(core, F.lit(0.0)), 0.0, 2.0), "shoulder").alias("flat_bottom_score"),
        part(ratio(F.col("right") - F.col("left"), core), "left", "right").alias("ingress_egress_asym"),
        part(second, "second").alias("secondary_depth"), part(ratio(second, core), "second").alias("secondary_ratio"),
    )


def odd_even(lc: DataFrame, min_points: int = 5, min_epochs: int = 2) -> DataFrame:
    """Median depth of odd and even epochs; the first epoch in range is even."""
    k = F.rint((F.col("t") - F.col("t0")) / F.col("period"))
    rows = lc.withColumn("first", F.ceil((F.min("t").over(star()) - F.col("t0")) / F.col("period"))).withColumn("k", k)
    rows = rows.where(F.abs(F.col("t") - F.col("t0") - F.col("k") * F.col("period")) < F.col("dur") / 2).where("k >= first")
    epochs = rows.groupBy("tic_id", F.pmod(F.col("k") - F.col("first"), F.lit(2)).cast("int").alias("parity"), "k").agg((1 - F.median("flux")).alias("depth"), F.count("flux").alias("n")).where(F.col("n") >= min_points)
    of = lambda p: F.when(F.count_if(F.col("parity") == p) >= min_epochs, F.median(F.when(F.col("parity") == p, F.col("depth"))))
    s = epochs.groupBy("tic_id").agg(of(1).alias("odd_depth"), of(0).alias("even_depth"))
    return s.withColumn("odd_even_ratio", ratio(F.col("odd_depth"), F.col("even_depth")))


def centroid(lc: DataFrame, min_points: int = 8) -> DataFrame:
    """Shift of the centroid in dips, in units of its spread outside them."""
    half, a = F.col("dur") / F.col("period") / 2, F.abs(F.col("phi"))
    inside, outside = a < half * 0.5, (a > half * 1.5) & (a < half * 6)
    s = folded(lc).groupBy("tic_id").agg(
        F.count_if(inside).alias("n_in"), F.count_if(outside).alias("n_out"),
        *[_median_where(z, c).alias(f"{c}_{n}") for c in ("c1", "c2") for n, z in (("in", inside), ("out", outside))],
        *[F.stddev_pop(F.when(outside, F.col(c))).alias(f"{c}_sd") for c in ("c1", "c2")],
    )
    shift = [ratio(F.col(f"{c}_in") - F.col(f"{c}_out"), F.col(f"{c}_sd")) for c in ("c1", "c2")]
    return s.select("tic_id", F.when((F.col("n_in") >= min_points) & (F.col("n_out") >= min_points), F.sqrt(shift[0] * shift[0] + shift[1] * shift[1])).alias("centroid_proxy"))


def statistics(lc: DataFrame, min_points: int = 10) -> DataFrame:
    """Moments, range, percentiles and outlier shares of each star's flux."""
    sd = lc.withColumn("sd", F.stddev_pop("flux").over(star()))
    p = F.percentile("flux", F.array(F.lit(0.05), F.lit(0.95)))
    s = sd.groupBy("tic_id").agg(
        F.count("flux").alias("n"), F.stddev_pop("flux").alias("rms"), F.skewness("flux").alias("skewness"), F.kurtosis("flux").alias("kurtosis"), (F.max("flux") - F.min("flux")).alias("flux_range"), p.alias("p"),
        F.avg((F.col("flux") > 1 + 3 * F.col("sd")).cast("double")).alias("above_3sigma_frac"), F.avg((F.col("flux") < 1 - 3 * F.col("sd")).cast("double")).alias("below_3sigma_frac"),
    )
    keep = lambda c: F.when(F.col("n") >= min_points, c)
    return s.select("tic_id", *[keep(F.col(c)).alias(c) for c in ("rms", "skewness", "kurtosis", "flux_range", "above_3sigma_frac", "below_3sigma_frac")], keep(F.col("p")[0]).alias("flux_percentile_5"), keep(F.col("p")[1]).alias("flux_percentile_95"))


def mean_abs_change(lc: DataFrame) -> DataFrame:
    d = lc.withColumn("d", F.abs(F.col("flux") - F.lag("flux").over(in_time())))
    return d.groupBy("tic_id").agg(F.avg("d").alias("mean_abs_change"), F.sum(F.col("flux") ** 2).alias("abs_energy"))


def dft(series: DataFrame, key: str, values: str, coefficients: int = 10) -> DataFrame:
    """First Fourier coefficients of an array column, null entries as the mean."""
    x = series.select(key, F.posexplode(values).alias("j", "x"))
    whole = Window.partitionBy(key)
    x = x.withColumn("n", F.count("*").over(whole)).withColumn("x", F.coalesce(F.col("x").cast("double"), F.avg("x").over(whole)))
    angle = [2 * math.pi * k * F.col("j") / F.col("n") for k in range(coefficients)]
    parts = [F.struct(F.lit(k).alias("k"), F.sum(F.col("x") * F.cos(a)).alias("re"), F.sum(-F.col("x") * F.sin(a)).alias("im")) for k, a in enumerate(angle)]
    s = x.groupBy(key).agg(F.array(*parts).alias("c")).select(key, F.explode("c").alias("c"))
    return s.select(key, "c.k", F.col("c.re").alias("re"), F.sqrt(F.col("c.re") ** 2 + F.col("c.im") ** 2).alias("modulus"))


def habitable_zone(stars: DataFrame, solar_teff: float = 5778.0) -> DataFrame:
    """Zone bounds, distance, flag and proximity from teff, rad, mass and period; null if any is."""
    lum = (F.col("teff") / solar_teff) ** 4 * F.col("rad") ** 2
    s = stars.withColumn("inner_au", F.sqrt(lum / 1.1)).withColumn("outer_au", F.sqrt(lum / 0.36))
    s = s.withColumn("a_au", F.cbrt((F.col("period") / 365.25) ** 2 * F.col("mass")))
    s = s.withColumn("hz_in_zone", ((F.col("a_au") >= F.col("inner_au")) & (F.col("a_au") <= F.col("outer_au"))).cast("double"))
    mid, width = (F.col("inner_au") + F.col("outer_au")) / 2, (F.col("outer_au") - F.col("inner_au")) / 2
    return s.withColumn("hz_proximity", ratio(F.abs(F.col("a_au") - mid), width))


def density_prior(stars: DataFrame) -> DataFrame:
    """``ln(a/R)`` and its width from mass, radius and period; null without them."""
    rho = F.col("mass") / F.col("rad") ** 3 * 1410.0
    ar = F.cbrt(rho * 6.674e-11 * (F.col("period") * 86400) ** 2 / (3 * math.pi))
    usable = (F.col("mass") > 0) & (F.col("rad") > 0)
    return stars.withColumn("ln_a", F.when(usable, F.log(ar))).withColumn("ln_a_sd", F.when(usable, F.lit(0.1)))


def diagnostics(lc: DataFrame) -> DataFrame:
    """Odd/even difference with its error; parity counts from the epoch t0."""
    dt = F.col("t") - F.col("t0") - F.rint((F.col("t") - F.col("t0")) / F.col("period")) * F.col("period")
    x = lc.withColumn("ph", F.abs(dt)).withColumn("parity", F.pmod(F.rint((F.col("t") - F.col("t0")) / F.col("period")), F.lit(2.0)))
    core, out = F.col("ph") < F.col("dur") * 0.25, (F.col("ph") > F.col("dur") * 0.75) & (F.col("ph") < F.col("dur") * 3)
    cells = [(n, core & (F.col("parity") == p)) for n, p in (("even", 0), ("odd", 1))]
    s = x.groupBy("tic_id").agg(F.avg(F.when(out, F.col("flux"))).alias("base"), F.stddev_pop(F.when(out, F.col("flux"))).alias("sd"), *[F.avg(F.when(c, F.col("flux"))).alias(n) for n, c in cells], *[F.count(F.when(c, F.col("flux"))).alias(f"n_{n}") for n, c in cells])
    error = F.col("sd") * F.sqrt(ratio(F.lit(1.0), F.col("n_odd").cast("double")) + ratio(F.lit(1.0), F.col("n_even").cast("double")))
    return s.select("tic_id", (F.col("base") - F.col("odd")).alias("odd_depth"), (F.col("base") - F.col("even")).alias("even_depth"), ratio(F.abs(F.col("odd") - F.col("even")), error).alias("odd_even_sigma"))


# Solar radius in Earth radii and in au, solar temperature of fits.
SUN_IN_EARTHS, SUN_IN_AU, SUN_TEFF = 109.076, 0.00465047, 5772.0


def derived_parameters(samples: DataFrame) -> DataFrame:
    """Inclination, depth, full duration, S/N, radius, orbit, temperature and zone of each sample.

    Reads period, rp_rs, b, a_rs, sigma, n_in, rad and teff.  Without a radius there is
    no radius, orbit or zone; without a temperature no equilibrium temperature or zone.
    """
    c = F.col
    one = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    known = lambda x: F.when((x > 0) & ~F.isnan(x), x)
    rad, teff = known(c("rad")), known(c("teff"))
    out = samples.withColumn("__inc", F.acos(one(c("b") / c("a_rs"))))
    chord = F.sqrt(F.greatest((1 + c("rp_rs")) ** 2 - c("b") ** 2, F.lit(0.0))) / F.nullif(c("a_rs") * F.sin("__inc"), F.lit(0.0))
    light = rad**2 * (teff / SUN_TEFF) ** 4
    inner, outer = F.sqrt(light / 1.1), F.sqrt(light / 0.36)
    out = out.withColumn("inc_deg", F.degrees("__inc")).withColumn("depth_ppm", c("rp_rs") ** 2 * 1e6).withColumn("t14_hr", c("period") / F.pi() * F.asin(one(chord)) * 24)
    out = out.withColumn("fit_snr", c("rp_rs") ** 2 / F.nullif(c("sigma"), F.lit(0.0)) * F.sqrt(F.greatest(c("n_in"), F.lit(1)).cast("double")))
    out = out.withColumn("rp_rearth", c("rp_rs") * rad * SUN_IN_EARTHS).withColumn("a_au", c("a_rs") * rad * SUN_IN_AU).withColumn("teq_k", F.when(rad.isNotNull(), teff * F.sqrt(0.5 / c("a_rs"))))
    out = out.withColumn("hz_score", F.abs(c("a_au") - (inner + outer) / 2) / ((outer - inner) / 2))
    return out.withColumn("in_hz", c("hz_score") <= 1).drop("__inc")
