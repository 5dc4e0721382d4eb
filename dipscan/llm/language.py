"""Operator 1: language identification by Bayesian evidence fusion.

Evidence for a row, all as log-probabilities of each language:

* text: a naive Bayes model of hashed byte trigrams, fitted on a bounded sample
  of labelled rows (about ``SAMPLE_ROWS``, whole texts), tempered because
  neighbouring trigrams overlap;
* declared markup language and address suffix: agreement rates with the text's
  own language, counted over all rows;
* host prior: language counts of the host, smoothed towards its domain, that
  towards its top level, and that towards all rows; each by grouped aggregation.
  A row's own text is taken out of all four counts, so it is no evidence twice.

A row is kept if its text has letters and its best language has a posterior of
at least ``MIN_POSTERIOR``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .shared import written

SAMPLE_ROWS = 4_000
BITS = 15
TEMPER = 0.3
SMOOTHING = 20.0  # rows that a parent counts for
MIN_POSTERIOR = 0.5

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


@dataclass
class TextModel:
    languages: list[str]
    weights: np.ndarray  # float32[2**BITS, languages]


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed trigram) wherever three bytes hold two letters at least."""
    data, base = tb.raw(texts)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    letter = _LETTER[low]
    value = np.where(letter, low, 32).astype(np.uint32)
    code = value[:-2] << 16 | value[1:-1] << 8 | value[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    full = (letter[:-2].astype(np.int8) + letter[1:-1] + letter[2:]) >= 2
    inside = np.ones(len(code), dtype=bool)
    for edge in base[1:-1]:
        inside[max(0, edge - 2): edge] = False
    at = np.flatnonzero(full & inside)
    return np.searchsorted(base[1:], at, side="right"), code[at].astype(np.int64)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to the trigram counts of each language in this task."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        lang = batch.column(0).to_numpy(zero_copy_only=False)
        for row, block in tb.blocks(batch.column(1), 1 << 18):
            doc, code = _trigrams(block)
            of = lang[row: row + len(block)]
            for x in set(of):
                counts.setdefault(x, np.zeros(1 << BITS, np.int64))
                counts[x] += np.bincount(code[of[doc] == x], minlength=1 << BITS)
    for x, n in counts.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([x] * (len(at) + 1)), pa.array(np.append(at, 0)), pa.array(np.append(n[at], 0))], names=["lang", "code", "n"])


def fit(labelled: DataFrame, key_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> TextModel:
    """Fit on the whole texts of about ``rows`` labelled rows, chosen by a hash of their key.

    Rows without a key, label or text are not chosen; no rows give a model of no
    language.  Trigrams are counted in the tasks, so only counts reach the driver.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(key_col).isNotNull() & (F.length(F.col(text_col)) > 0))
    share = min(1.0, rows / max(1, labelled.where(F.col(lang_col).isNotNull()).count()))
    sample = known.where(F.pmod(F.xxhash64(key_col), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    found = sample.mapInArrow(_gram_counts, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    lang = found["lang"].to_pylist()
    languages = sorted(set(lang))
    counts = np.full((len(languages), 1 << BITS), 0.1)
    place = {x: i for i, x in enumerate(languages)}
    counts[[place[x] for x in lang], found["code"].to_numpy()] += found["n"].to_numpy()
    weights = np.log(counts / counts.sum(axis=1, keepdims=True)).T
    return TextModel(languages, np.ascontiguousarray(weights, dtype=np.float32))


def _scored(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value.weights
        for batch in batches:
            text = batch.schema.get_field_index("text")
            keep = [i for i in range(batch.num_columns) if i != text]
            for row, block in tb.blocks(batch.column(text)):
                doc, code = _trigrams(block)
                grams = np.bincount(doc, minlength=len(block))
                sums = [np.bincount(doc, weights=weights[code, j], minlength=len(block)).astype(np.float64) for j in range(weights.shape[1])]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1) * len(sums), pa.int32()), pa.array(np.stack(sums, axis=1).reshape(-1) if sums else np.zeros(0)))
                own = [batch.column(i).slice(row, len(block)) for i in keep]
                yield pa.RecordBatch.from_arrays([*own, pa.array(grams, pa.int64()), lists], names=[*(batch.schema.names[i] for i in keep), "grams", "ll"])

    return run


def _argmax(values: Column, languages: list[str]) -> Column:
    best = F.array_max(F.transform(values, lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))))
    return F.element_at(F.array(*[F.lit(x) for x in languages]), (1 - best.i).cast("int"))


def markup_language(html: Column) -> Column:
    """Two-letter language of ``<html lang=...>``, or null."""
    found = F.lower(F.regexp_extract(html, r"""(?i)<html[^>]*?\slang\s*=\s*["']?([a-z]{2})""", 1))
    return F.nullif(found, F.lit(""))


def address_language(url: Column, languages: list[str]) -> Column:
    """Language of a url's suffix: its top-level domain, else its first path part, or null."""
    host = F.lower(F.regexp_extract(url, r"://([^/?#:]*)", 1))
    path = F.lower(F.regexp_extract(url, r"://[^/?#]*/([a-zA-Z]{2})(?:[/?#]|$)", 1))
    top = F.substring_index(host, ".", -1)
    return F.when(top.isin(languages), top).when(path.isin(languages), path)


def visible_text(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")


def identify(rows: DataFrame, model: TextModel, keys: list[str]) -> DataFrame:
    """Languages of rows with ``text``, ``host``, ``declared`` and ``suffix`` columns.

    Returns ``keys`` with language, confidence, text_language and kept, one row
    for each input row.  Null or empty texts and texts without letters get the
    language that the other evidence gives and are not kept.  Null hosts share
    the prior of all rows; null or unknown declarations count as no evidence.
    Agreement rates count the row itself, one of all rows.
    A model without languages gives null languages and keeps nothing.  Keys may
    have any names.
    """
    spark = rows.sparkSession
    langs = model.languages
    held = [f"__key{i}" for i in range(len(keys))]
    back = [F.col(h).alias(k) for h, k in zip(held, keys)]
    source = rows.select(*[F.col(k).alias(h) for h, k in zip(held, keys)], F.lower("host").alias("host"), "declared", "suffix", F.coalesce("text", F.lit("")).alias("text"))
    if not langs:
        return source.select(*back, F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_language"), F.lit(False).alias("kept"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.drop("text").schema.fields)
    scored = source.mapInArrow(_scored(spark.sparkContext.broadcast(model)), f"{types}, grams bigint, ll array<double>")
    own = F.when(F.col("grams") > 0, _argmax(F.col("ll"), langs))
    scored = written(scored.withColumn("text_language", own), "scored")

    # agreement of declarations with the text, over all rows
    rates = []
    for c in ("declared", "suffix"):
        use = F.col(c).isin(langs) & F.col("text_language").isNotNull()
        rates += [F.count_if(use & (F.col(c) == F.col("text_language"))).alias(f"{c}_same"), F.count_if(use).alias(f"{c}_all")]
    tally = [F.count_if(F.col("text_language") == x).cast("double").alias(f"n{i}") for i, x in enumerate(langs)]
    total = scored.agg(*rates, *tally).first()

    # host -> domain -> top level -> all rows
    n = [f"n{i}" for i in range(len(langs))]
    hosts = scored.where("host is not null").groupBy("host").agg(*tally)
    hosts = hosts.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("top", F.substring_index("host", ".", -1))
    def level(key: str, name: str) -> DataFrame:
        return hosts.groupBy(key).agg(F.array(*[F.sum(c) for c in n]).alias(name))

    levels = hosts.select("host", "domain", "top", F.array(*n).alias("host_n")).join(level("domain", "domain_n"), "domain").join(level("top", "top_n"), "top")
    levels = levels.select("host", "host_n", "domain_n", "top_n")
    self = F.array(*[F.when(F.col("text_language") == x, 1.0).otherwise(0.0) for x in langs])
    others = F.coalesce(F.col("text_language").isNotNull().cast("double"), F.lit(0.0))
    whole = sum(total[c] for c in n) + len(langs)
    prior = F.transform(F.zip_with(F.array(*[F.lit(total[c] + 1) for c in n]), self, lambda c, o: c - o), lambda c: c / (F.lit(whole) - others))

    def declared(c: str) -> Column:
        right = (total[f"{c}_same"] + 1) / (total[f"{c}_all"] + 2)
        wrong = (1 - right) / max(1, len(langs) - 1)
        told = F.array(*[F.when(F.col(c) == x, float(np.log(right))).otherwise(float(np.log(wrong))) for x in langs])
        return F.when(F.col(c).isin(langs), told).otherwise(F.array(*[F.lit(0.0)] * len(langs)))

    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    joined = scored.join(levels, "host", "left").withColumn("p", prior)
    for counts in ("top_n", "domain_n", "host_n"):
        rest = F.coalesce(F.zip_with(counts, self, lambda c, o: c - o), F.array(*[F.lit(0.0)] * len(langs)))
        joined = joined.withColumn("rest", rest).withColumn("size", F.aggregate("rest", F.lit(0.0), lambda a, x: a + x))
        joined = joined.withColumn("p", F.zip_with("rest", "p", lambda c, p: (c + SMOOTHING * p) / (F.col("size") + SMOOTHING)))
    post = F.transform("p", lambda x: F.log(x))
    post = add(add(add(F.transform("ll", lambda x: x * TEMPER), post), declared("declared")), declared("suffix"))
    joined = joined.withColumn("post", post).withColumn("top", F.array_max("post"))
    mass = F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    joined = joined.withColumn("confidence", 1 / mass).withColumn("language", _argmax(F.col("post"), langs))
    return joined.select(*back, "language", F.round("confidence", 6).alias("confidence"), "text_language", ((F.col("grams") > 0) & (F.col("confidence") >= MIN_POSTERIOR)).alias("kept"))
