"""Evaluation of scores (y, score) and leakage-safe splits of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ratio
from .ordered import ranked_within, running


def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("y", "pred").agg(F.count("*").alias("n"))


def precision_recall_f1(df: DataFrame) -> DataFrame:
    """Per class; 0 where a class was never predicted or never true."""
    c = confusion(df)
    true = c.groupBy(F.col("y").alias("k")).agg(F.sum("n").alias("support"))
    said = c.groupBy(F.col("pred").alias("k")).agg(F.sum("n").alias("said"))
    hit = c.where("y = pred").select(F.col("y").alias("k"), F.col("n").alias("hit"))
    s = true.join(said, "k", "full").join(hit, "k", "left").fillna(0)
    p, r = F.coalesce(ratio(F.col("hit").cast("double"), F.col("said").cast("double")), F.lit(0.0)), F.coalesce(ratio(F.col("hit").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    return s.select("k", "support", p.alias("precision"), r.alias("recall"), F.coalesce(ratio(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def _by_score(df: DataFrame) -> DataFrame:
    """Positives and all rows of each distinct score: what curves need, not the rows."""
    return df.groupBy("score").agg(F.sum("y").cast("double").alias("pos"), F.count("*").cast("double").alias("n"))


def roc_auc(df: DataFrame) -> DataFrame:
    """Area under the ROC curve from rank sums with mid-ranks for ties."""
    s = running(_by_score(df), ["score"], {"upto": F.col("n")})
    mid = F.col("upto") - (F.col("n") - 1) / 2
    t = s.agg(F.sum(mid * F.col("pos")).alias("ranks"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return t.select(ratio(F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"))


def average_precision(df: DataFrame) -> DataFrame:
    """Sum of precision times the step in recall, over distinct scores."""
    s = running(_by_score(df), [F.desc("score")], {"tp": F.col("pos"), "all": F.col("n")})
    return s.agg(ratio(F.sum(F.col("pos") * F.col("tp") / F.col("all")), F.sum("pos")).alias("ap"))


def brier(df: DataFrame) -> DataFrame:
    return df.agg(F.avg((F.col("score") - F.col("y")) ** 2).alias("brier"))


def shuffled_rank(df: DataFrame, by: str, group: str, seed: str) -> DataFrame:
    """``rn`` and ``n``: place of each group within its class in a seeded order."""
    return ranked_within(df, by, [F.md5(F.concat(F.col(group), F.lit(seed))), group])


def group_split(groups: DataFrame, by: str = "label", group: str = "grp", share: float = 0.25, seed: str = "42") -> DataFrame:
    """(group, class, part): of each class max(1, round(n * share)) groups are held out."""
    r = shuffled_rank(groups, by, group, seed)
    held = F.col("rn") <= F.greatest(F.lit(1.0), F.rint(F.col("n") * share))
    return r.select(group, by, F.when(held, "test").otherwise("train").alias("part"))


def learning_groups(groups: DataFrame, by: str = "label", group: str = "grp", share: float = 0.4, seed: str = "42") -> DataFrame:
    """The first max(4, floor(n * share)) groups of each class."""
    r = shuffled_rank(groups, by, group, seed)
    return r.where(F.col("rn") <= F.greatest(F.lit(4), F.floor(F.col("n") * share))).select(group, by)


def mean_abs_attribution(df: DataFrame, columns: list[str], top: int = 15) -> DataFrame:
    """(feature, mean_abs) of the ``top`` features by mean absolute contribution; ties by name."""
    means = df.agg(*[F.avg(F.abs(c)).alias(c) for c in columns])
    rows = means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean_abs")) for c in columns])).alias("r"))
    return rows.select("r.*").orderBy(F.desc("mean_abs"), "feature").limit(top)
