"""Catalogue algebra: keyed picks, upserts, lookups, interleaving, imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import median


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Headers stripped, then renamed; names that are absent are ignored."""
    return df.toDF(*[c.strip() for c in df.columns]).withColumnsRenamed(names)


def keep_columns(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return df.select([c for c in keep if c in df.columns])


def reindex(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exactly these columns and types, null where the frame has none."""
    return df.select([(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; ``order`` should end in something unique."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both by key; ``new`` wins.  Columns may differ.

    Of rows of one side with the same key the greatest stays, by the other columns in order, nulls last.
    """
    rows = base.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = [F.col(c).desc_nulls_last() for c in rows.columns if c != "__new" and c not in keys]
    return first_per_key(rows, keys, [F.desc("__new"), *rest]).drop("__new")


def priority_labels(*sources: tuple[DataFrame, str, int]) -> DataFrame:
    """(tic_id, label, source): of (frame, name, priority) the lowest priority, then the lowest label."""
    rows = None
    for frame, name, priority in sources:
        part = frame.select("tic_id", F.col("label").cast("int").alias("label"), F.lit(name).alias("source"), F.lit(priority).alias("priority"))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy("tic_id").agg(F.min(F.struct("priority", "label", "source")).alias("b"))
    return best.select("tic_id", "b.label", "b.source")


def lookup(left: DataFrame, table: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left lookup of ``table`` (unique by key); missing values take defaults."""
    out = left.join(table.select(key, *defaults), key, "left")
    for c, d in defaults.items():
        out = out.withColumn(c, F.coalesce(c, F.lit(d))) if d is not None else out
    return out


def interleave(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """n rows, taken from the groups in turn; adds ``rn``, the row's turn.

    No group gives more than n, which is asked before the shuffle already.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).orderBy("rn", *group).limit(n)


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls to the column's median, with ``<column>_imputed`` telling where."""
    for c in columns:
        df = df.withColumn(f"{c}_imputed", F.col(c).isNull()).withColumn(c, F.coalesce(c, F.lit(median(df, c)).cast("double")))
    return df


def hosts_of(stars: DataFrame, injections: DataFrame) -> DataFrame:
    """``host`` of every star: a synthetic one's from its path, else itself."""
    hosts = injections.select("tic_id", F.regexp_extract("host_path", r"TIC_(\d+)\.npz$", 1).alias("__host"))
    return stars.join(hosts, "tic_id", "left").withColumn("host", F.coalesce("__host", "tic_id")).drop("__host")


NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def feature_columns(df: DataFrame, exclude: set[str] = frozenset()) -> list[str]:
    """Numeric columns that hold a value, in order of name; one pass over all rows."""
    names = sorted(c for c, t in df.dtypes if c not in exclude and (t in NUMERIC or t.startswith("decimal")))
    found = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in names]).first() if names else {}
    return [c for c in names if found[c]]


def class_codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """``code`` 0..K-1 of each row's class, in order of the classes; null stays null.

    Only the distinct classes are ranked, and classes are few.
    """
    classes = df.select(column).where(F.col(column).isNotNull()).distinct()
    ranked = classes.withColumn(code, (F.row_number().over(Window.orderBy(column)) - 1).cast("int"))
    return df.join(ranked, column, "left")
