"""The corpus pipeline: language ID, near duplicates, repeated passages, benchmark
leaks, then encoding.  Each stage works on all rows that the one before kept.

Any column may hold nulls, tables may be empty, and all columns but ``doc_id``,
``text``, ``lang`` and ``source`` pass through as they are, ``n_chars`` (if there) apart, which
follows the text.  Inside a stage every document has a number of its own, see
``numbered``, so a decision about one document never touches another.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dipscan.llm import language, passages, pieces, set_join, shared, spaced_seeds

PIECE_MODEL = "piece_bpe_32k.model"
LISTED_IDS = 100_000  # repeated ids that are broadcast; more are joined
LATE = 1 << 62  # numbers of documents without an id of their own begin here


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each document, and the name of that column.

    Equal rows (same id, same text) are one document, of which one row stays.  The
    number is doc_id; where several texts share it, one of them has it (that with
    the smallest hash), and the others, like rows without an id, count as later
    than all documents with an id of their own, in order of a hash.
    """
    name = next(n for n in (f"row{'_' * i}" for i in range(1_000)) if n not in docs.columns)
    ids = docs.groupBy(F.col("doc_id").cast("bigint").alias(name)).agg(F.count("*").alias("c")).where(f"c > 1 OR {name} IS NULL").select(name)
    ids = shared.written(ids, "repeated")
    n = ids.limit(LISTED_IDS + 1).count()
    if not n:
        return docs.withColumn(name, F.col("doc_id").cast("bigint")), name
    ids = F.broadcast(ids) if n <= LISTED_IDS else ids
    same = F.col("doc_id").cast("bigint").eqNullSafe(ids[name])
    own = docs.join(ids, same, "left_anti").withColumn(name, F.col("doc_id").cast("bigint"))
    again = docs.join(ids, same, "left_semi").withColumn(name, F.xxhash64("text")).dropDuplicates(["doc_id", name])
    least = again.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(name).alias(name))
    firsts = again.join(least, ["doc_id", name], "left_semi").withColumn(name, F.col("doc_id").cast("bigint"))
    late = F.lit(LATE) + F.xxhash64("doc_id", "text").bitwiseAND(F.lit(LATE - 1))
    others = again.join(least, ["doc_id", name], "left_anti").withColumn(name, late)
    return own.unionByName(firsts).unionByName(others), name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough; the others go.

    Null and empty texts and texts without letters go.  Null sources and
    languages are no evidence; without any labelled document all go.
    """
    rows, row = numbered(docs)
    seen = rows.select(F.col(row).alias("row"), F.col("source").alias("host"), F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), "text")
    found = language.identify(seen, language.fit(docs), ["row"])
    gone = found.where("NOT kept").select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest number.

    Null and empty texts have no copies and stay.
    """
    rows, row = numbered(docs)
    found = set_join.jaccard_components(rows, row)
    copies = found.where("id != component_id").select(F.col("id").alias(row))
    return rows.join(copies, row, "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document has; nothing left: the document goes.

    Null and empty texts have no passages and stay.
    """
    rows, row = numbered(docs)
    cut = passages.without_passages(rows, passages.repeated_passages(rows, row), row, keep_empty=False)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item; null and empty texts overlap with none."""
    rows, row = numbered(docs)
    found = spaced_seeds.overlaps(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), row)
    return rows.join(found.select(F.col("id").alias(row)).distinct(), row, "left_anti").select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and digests of ids and decoded text, one row for each; a null text counts as empty."""
    rows, _ = numbered(docs)
    found = pieces.encode_decode(rows, public_tokenizers.path(PIECE_MODEL))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("encode", encode_pieces),
]

#: A trained model, chaining and piece segmentation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = shared.written(docs, f"stage-{name}")
    return docs
