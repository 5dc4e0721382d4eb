"""Whole plans: training and scoring a classifier without leaks between groups."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..functions import no_nan
from ..operators import metrics
from ..operators.catalog import feature_columns
from ..operators.metrics import group_split
from ..operators.neighbours import nearest
from ..operators.ordered import ranked_within
from ..shared import packed


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """``weight``: each class counts the same in total; rows without one are left out.  Classes are few, and counted at once."""
    n = {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*")).collect()}
    weight = F.lit(None).cast("double")
    for kind, has in n.items():
        weight = F.when(F.col(label) == kind, sum(n.values()) / (len(n) * has)).otherwise(weight)
    return df.where(F.col(label).isNotNull()).withColumn("weight", weight)


def fit_classifier(train: DataFrame, features: list[str], label: str = "label", trees: int = 20, depth: int = 4, rate: float = 0.1, rows: float = 1.0, group: str | None = None) -> PipelineModel:
    """Boosted trees over median-imputed features, classes weighted alike.

    Trees are grown on histograms of 255 bins and a share ``rows`` of the rows each.  With
    ``group`` about a tenth of the groups, by hash, only judges: growth stops before
    ``trees`` once the loss on them no longer falls.
    """
    boost = GBTClassifier(featuresCol="x", labelCol=label, weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=rows, maxBins=255, seed=42)
    # learners plan and read their rows again and again: they are written once, with no join or shuffle behind them
    train = packed(balanced(train, label).select(*dict.fromkeys([label, "weight", *features, *([group] if group else [])])), "training-rows")
    if group:
        train = train.withColumn("judges", F.pmod(F.xxhash64(group), F.lit(10)) == 0)
        if train.where("judges").limit(1).count() and train.where("NOT judges").select(label).distinct().count() > 1:
            boost = boost.setValidationIndicatorCol("judges")
    stages = [Imputer(strategy="median", inputCols=features, outputCols=[f"{c}__i" for c in features]), VectorAssembler(inputCols=[f"{c}__i" for c in features], outputCol="x"), boost]
    return Pipeline(stages=stages).fit(train)


def oversampled(df: DataFrame, features: list[str], label: str = "label", id_col: str = "doc_id", neighbours: int = 5, seed: int = 42) -> DataFrame:
    """(label, features, synthetic): rows of every class, the smaller ones filled up to the largest.

    A synthetic row lies between a row of the class and one of its nearest ``neighbours`` in the
    class, found exactly, at a place drawn from seed and row.  Features are scaled by
    their spread for the distance; null features count as the class's mean there and
    stay null in copies of both.
    """
    n = df.groupBy(label).agg(F.count("*").alias("has"))
    n = n.crossJoin(F.broadcast(n.agg(F.max("has").alias("wanted"))))  # a row for each class
    spread = df.agg(*[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(c) for c in features]).first()
    middle = df.groupBy(label).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"__m{j}") for j, c in enumerate(features)])
    rows = df.join(F.broadcast(n), label).join(F.broadcast(middle), label)
    scaled = [(F.coalesce(F.col(c).cast("double"), F.col(f"__m{j}")) / F.lit(float(spread[c]))).alias(f"__z{j}") for j, c in enumerate(features)]
    small = [r[label] for r in n.where("has < wanted").select(label).collect()]  # classes are few
    near = None
    for kind in small:
        of = nearest(rows.where(F.col(label) == kind).select(id_col, *scaled), [f"__z{j}" for j in range(len(features))], neighbours, id_col)
        near = of if near is None else near.unionByName(of)
    own = df.select(label, *[F.col(c).cast("double").alias(c) for c in features]).withColumn("synthetic", F.lit(False))
    if near is None:
        return own
    # each row gives wanted / has - 1 copies, and the rows of lowest rank one more
    rows = ranked_within(rows.where("has < wanted"), label, [F.xxhash64(F.lit(seed + 1), id_col), id_col], "place", "size")
    extra = F.col("wanted") - F.col("has")
    copies = F.floor(extra / F.col("has")) + (F.col("place") <= extra % F.col("has")).cast("int")
    rows = rows.withColumn("copies", copies.cast("int")).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    draw = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), id_col, "copy"), F.lit(1 << 40)) / float(1 << 40)
    lists = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "neighbour"))).alias("near"))
    rows = rows.join(lists.withColumnRenamed("id", id_col), id_col, "left")
    pick = F.element_at("near", (F.floor(draw(1) * F.size("near")) + 1).cast("int"))["neighbour"]
    other = df.select(F.col(id_col).alias("__other"), *[F.col(c).cast("double").alias(f"__o{j}") for j, c in enumerate(features)])
    rows = rows.withColumn("__other", F.when(F.size("near") > 0, pick)).join(other, "__other", "left").withColumn("__at", draw(2))
    between = [(F.col(c).cast("double") + F.col("__at") * (F.when(F.col("__other").isNull(), F.col(c).cast("double")).otherwise(F.col(f"__o{j}")) - F.col(c).cast("double"))).alias(c) for j, c in enumerate(features)]
    return own.unionByName(rows.select(label, *between).withColumn("synthetic", F.lit(True)))


def scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("score", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")


def calibrated(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """Platt scaling of ``score``: a logistic regression on held-out scores."""
    pack = VectorAssembler(inputCols=["score"], outputCol="s")
    fit = LogisticRegression(featuresCol="s", labelCol=label).fit(pack.transform(train))
    return fit.transform(pack.transform(test)).withColumn("score", vector_to_array("probability")[1]).drop("s", "rawPrediction", "probability", "prediction")


def split_by_group(df: DataFrame, group: str = "grp", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(train, test): no group on both sides."""
    parts = group_split(df.groupBy(group).agg(F.max(label).alias(label)), by=label, group=group).select(group, "part")
    both = df.join(parts, group)
    return both.where("part = 'train'").drop("part"), both.where("part = 'test'").drop("part")


def cached(spark: SparkSession, folder: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table in ``folder``; computed and written there first if it is not.

    Data lie in a part of their own and count once a record names it, so a write that
    broke off is never read and the next call computes anew.
    """
    try:
        parts = [r.part for r in spark.read.schema("part string").json(f"{folder}/commits").collect()]  # a row for each write
    except AnalysisException:  # nothing there yet
        parts = []
    if not parts:
        parts = [f"data-{uuid.uuid4().hex}"]
        compute().write.parquet(f"{folder}/{parts[0]}")
        spark.createDataFrame([(parts[0],)], "part string").coalesce(1).write.mode("append").json(f"{folder}/commits")
    return spark.read.parquet(f"{folder}/{min(parts)}")


def train_run(rows: DataFrame, features: list[str], folder: str, label: str = "label", group: str = "grp", min_classes: int = 2, **options) -> DataFrame:
    """Split by group, train, evaluate on the held-out groups, write model and metrics; the metrics as one row.

    The folder then holds ``model`` and ``metrics`` (JSON lines).  Synthetic rows (ids that begin
    with SYN) train but are never held out.  Fewer than ``min_classes`` classes
    among real rows end the run before anything is written.
    """
    real = ~F.col(group).startswith("SYN")
    classes = rows.where(real).select(label).distinct().count()
    if classes < min_classes:
        raise ValueError(f"{classes} classes among real rows, {min_classes} are needed")
    train, test = split_by_group(rows.where(real), group, label)
    train = train.unionByName(rows.where(~real).select(train.columns))
    model = fit_classifier(train, features, label, **options)
    sinks.save_model(model, f"{folder}/model")
    found = scored(model, test).select(F.col(label).cast("int").alias("y"), "score").withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    per = metrics.precision_recall_f1(found).agg(F.avg("f1").alias("macro_f1"))
    counts = train.agg(F.count("*").alias("n_train"), F.count_distinct(group).alias("train_groups"))
    tests = found.agg(F.count("*").alias("n_test"), F.sum("y").alias("n_positive"), F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy"))
    row = counts.crossJoin(tests).crossJoin(per).crossJoin(metrics.roc_auc(found)).crossJoin(metrics.average_precision(found)).crossJoin(metrics.brier(found))  # one row each
    row = row.withColumn("features", F.lit(len(features))).withColumn("classes", F.lit(classes))
    sinks.write_json(row, f"{folder}/metrics")
    return rows.sparkSession.read.schema(row.schema).json(f"{folder}/metrics")


def assembled(df: DataFrame, keys: tuple[str, ...] = ("tic_id", "label", "status", "sector", "t0", "n_cadences")) -> tuple[DataFrame, list[str]]:
    """(training rows, feature names): done and labelled rows; infinities and NaN as null."""
    rows = df.where((F.col("status") == "done") & (F.col("label") >= 0))
    kinds = dict(df.dtypes)
    rows = rows.select([no_nan(F.col(c)).alias(c) if kinds[c] in ("float", "double") else F.col(c) for c in df.columns])
    return rows, feature_columns(rows, set(keys))
