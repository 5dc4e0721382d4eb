"""Vetting rules, verdicts, rank scores and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import ranked

# Weight of each verdict in the rank score.
VERDICT_WEIGHT = {"PASS": 1.0, "CAUTION": 0.5, "FALSE-POSITIVE LIKELY": 0.1}


def vetted(fits: DataFrame) -> DataFrame:
    """Hard and soft flags and the verdict; a null input raises no flag.

    Reads odd_even_sigma, odd_even_frac, secondary_sigma, secondary_frac,
    centroid_sigma, radius, snr, b and converged.
    """
    c = F.col
    hard = {
        "odd-even": (c("odd_even_sigma") > 3) & (c("odd_even_frac") > 0.10), "secondary": (c("secondary_sigma") > 3) & (c("secondary_frac") > 0.10),
        "centroid": c("centroid_sigma") > 3, "radius": c("radius") > 20,
    }
    soft = {"low-snr": c("snr") < 7, "grazing": c("b") > 0.9, "not-converged": ~c("converged")}
    flags = lambda rules: F.array_compact(F.array(*[F.when(x, F.lit(k)) for k, x in rules.items()]))
    out = fits.withColumn("hard", flags(hard)).withColumn("soft", flags(soft))
    verdict = F.when(F.size("hard") > 0, "FALSE-POSITIVE LIKELY").when(F.size("soft") > 0, "CAUTION").otherwise("PASS")
    return out.withColumn("flags", F.array_join(F.concat("hard", "soft"), "; ")).withColumn("verdict", verdict)


def rank_score(df: DataFrame) -> DataFrame:
    """p * weight * min(snr / 10, 1); a missing p counts as 1, a missing snr gives null."""
    weight = F.create_map(*[F.lit(x) for kv in VERDICT_WEIGHT.items() for x in kv])
    strength = F.when(F.col("snr").isNotNull(), F.least(F.col("snr") / 10, F.lit(1.0)))
    return df.withColumn("rank_score", F.coalesce("p", F.lit(1.0)) * F.try_element_at(weight, F.col("verdict")) * strength)


def catalogue(df: DataFrame) -> DataFrame:
    """Rows ranked from 1 by rank score, ties by star."""
    return ranked(df, [F.col("rank_score").desc_nulls_last(), "tic_id"])


def posterior_summary(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    p = F.percentile(value, F.array(*[F.lit(x) for x in (0.5, 0.1587, 0.8413, 0.025, 0.975)]))
    s = samples.groupBy(*keys).agg(p.alias("p"))
    return s.select(*keys, F.col("p")[0].alias("med"), (F.col("p")[0] - F.col("p")[1]).alias("lo"), (F.col("p")[2] - F.col("p")[0]).alias("hi"), F.col("p")[3].alias("ci95_lo"), F.col("p")[4].alias("ci95_hi"))
