"""Stacked learners with grouped folds, nested calibration, learning curves and
permutation importance.

Every loop runs over a fixed number of folds, learners, shares or features;
rows stay in Spark throughout and only metrics reach the driver.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.metrics import learning_groups, roc_auc, shuffled_rank
from ..shared import at_once, packed
from . import balanced, fit_classifier, scored


def group_folds(groups: DataFrame, k: int = 5, by: str = "label", group: str = "grp", seed: str = "42") -> DataFrame:
    """(group, class, fold): the groups of each class dealt round the folds in a seeded order."""
    return shuffled_rank(groups, by, group, seed).select(group, by, ((F.col("rn") - 1) % k).cast("int").alias("fold"))


def with_folds(df: DataFrame, k: int, group: str = "grp", label: str = "label", seed: str = "42") -> DataFrame:
    """Rows with the fold of their group; a group counts as its highest label."""
    folds = group_folds(df.groupBy(group).agg(F.max(label).alias(label)), k, label, group, seed)
    return df.join(folds.select(group, "fold"), group)


def learners(label: str, trees: int = 15) -> dict:
    common = {"featuresCol": "x", "labelCol": label, "weightCol": "weight", "seed": 42}
    return {"p_boost": GBTClassifier(maxIter=trees, maxDepth=4, stepSize=0.1, **common), "p_forest": RandomForestClassifier(numTrees=2 * trees, maxDepth=6, **common)}


def _base_fits(train: DataFrame, features: list[str], label: str, trees: int) -> tuple[PipelineModel, dict]:
    """(preparation, base learners by name) fitted on ``train``."""
    filled = [f"{c}__i" for c in features]
    prepare = Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="x")]).fit(train)
    ready = prepare.transform(balanced(train, label))
    return prepare, {name: learner.fit(ready) for name, learner in learners(label, trees).items()}


def _scores(fits: tuple[PipelineModel, dict], rows: DataFrame) -> DataFrame:
    """``rows`` with one probability column for each base learner."""
    prepare, models = fits
    columns, rows = rows.columns, prepare.transform(rows)
    for name, model in models.items():
        rows = model.transform(rows).withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    return rows.select(*columns, *models)


def out_of_fold(df: DataFrame, features: list[str], k: int = 3, label: str = "label", trees: int = 15) -> DataFrame:
    """Base learners' probabilities of every row, from models that did not see its group."""
    fits = at_once(df.sparkSession, [partial(_base_fits, df.where(F.col("fold") != i), features, label, trees) for i in range(k)])
    return _out_of_fold(df, fits)


def _out_of_fold(df: DataFrame, fits: list) -> DataFrame:
    return reduce(DataFrame.unionByName, [_scores(fit, df.where(F.col("fold") == i)) for i, fit in enumerate(fits)])


def _logistic(train: DataFrame, inputs: list[str], label: str) -> LogisticRegressionModel:
    return LogisticRegression(featuresCol="__v", labelCol=label).fit(VectorAssembler(inputCols=inputs, outputCol="__v").transform(train))


def _blended(model: LogisticRegressionModel, rows: DataFrame, inputs: list[str], out: str) -> DataFrame:
    rows = VectorAssembler(inputCols=inputs, outputCol="__v").transform(rows)
    return model.transform(rows).withColumn(out, vector_to_array("probability")[1]).drop("__v", "rawPrediction", "probability", "prediction")


def stacked(train: DataFrame, test: DataFrame, features: list[str], k: int = 3, label: str = "label", group: str = "grp", trees: int = 15) -> DataFrame:
    """``test`` with ``score``: a logistic blend of base learners, calibrated on held-out blends.

    The blend learns from out-of-fold probabilities.  Its calibration learns from
    blends that are out of fold as well, so neither sees a row twice.
    """
    spark, base = train.sparkSession, list(learners(label))
    # learners plan and read their rows again and again: they are written once, with no join or shuffle behind them
    rows_in = packed(with_folds(train, k, group, label).select("fold", label, *features), "folds")
    parts = [*[rows_in.where(F.col("fold") != i) for i in range(k)], rows_in]
    *fits, whole = at_once(spark, [partial(_base_fits, part, features, label, trees) for part in parts])
    inner = packed(_out_of_fold(rows_in, fits).select("fold", label, *base), "out-of-fold")
    *blends, blend = at_once(spark, [partial(_logistic, part, base, label) for part in [*[inner.where(F.col("fold") != i) for i in range(k)], inner]])
    held = reduce(DataFrame.unionByName, [_blended(model, inner.where(F.col("fold") == i), base, "__blend") for i, model in enumerate(blends)])
    calibration = _logistic(packed(held.select("__blend", label), "blends"), ["__blend"], label)
    rows = _blended(blend, _scores(whole, test), base, "__blend")
    return _blended(calibration, rows, ["__blend"], "score").drop("__blend")


def learning_curve(train: DataFrame, test: DataFrame, features: list[str], shares=(0.2, 0.4, 0.6, 0.8, 1.0), group: str = "grp", label: str = "label", trees: int = 20) -> DataFrame:
    """(share, n_train, auc): the same test rows scored after growing shares of the training groups."""
    groups = train.groupBy(group).agg(F.max(label).alias(label))

    def point(share: float) -> DataFrame:
        part = train.join(learning_groups(groups, label, group, share).select(group), group, "left_semi")
        auc = roc_auc(scored(fit_classifier(part, features, label, trees), test).withColumnRenamed(label, "y"))
        return auc.crossJoin(part.agg(F.count("*").alias("n_train"))).withColumn("share", F.lit(share))

    points = at_once(train.sparkSession, [partial(point, share) for share in shares])
    return reduce(DataFrame.unionByName, points).select("share", "n_train", "auc")


def permuted(df: DataFrame, column: str, id_col: str, seed: int, rows_per_bucket: int = 10_000) -> DataFrame:
    """``column`` dealt anew among the rows of hash buckets: no sort of the whole table."""
    buckets = max(1, -(-df.count() // rows_per_bucket))
    key = F.pmod(F.xxhash64(id_col), F.lit(buckets))
    rows = df.withColumn("__b", key)
    here = Window.partitionBy("__b").orderBy(id_col)
    there = Window.partitionBy("__b").orderBy(F.xxhash64(F.lit(seed), id_col), id_col)
    given = rows.select("__b", F.col(column).alias("__new"), F.row_number().over(there).alias("__i"))
    return rows.withColumn("__i", F.row_number().over(here)).join(given, ["__b", "__i"]).withColumn(column, F.col("__new")).drop("__b", "__i", "__new")


def permutation_importance(model, test: DataFrame, features: list[str], id_col: str, repeats: int = 5, label: str = "label") -> DataFrame:
    """(feature, drop_mean, drop_std): loss of ROC AUC when a feature is permuted; ``id_col`` is unique."""
    auc = lambda df: roc_auc(scored(model, df).withColumnRenamed(label, "y"))
    whole = auc(test).withColumnRenamed("auc", "full")
    tries = [auc(permuted(test, c, id_col, seed)).withColumn("feature", F.lit(c)) for c in features for seed in range(repeats)]
    drops = reduce(DataFrame.unionByName, tries).crossJoin(F.broadcast(whole))
    return drops.groupBy("feature").agg(F.avg(F.col("full") - F.col("auc")).alias("drop_mean"), F.stddev_pop(F.col("full") - F.col("auc")).alias("drop_std"))
