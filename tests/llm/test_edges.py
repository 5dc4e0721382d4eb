"""Empty tables, null ids, clashing names and very long values of operators 1 and 3 to 5."""

import math
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from dipscan.llm import language, token_counts, url_cascade, warc_zip


def test_a_very_long_host_is_judged_at_once(spark):
    long = "http://" + ".".join(["ab"] * 50_000) + ".net/es/"
    pages = spark.createDataFrame([(1, long), (2, "http://x.net/es/"), (3, "http://net/es/"), (4, "http://a.b.c.d.www.example.com/en/" + "x/" * 50_000), (5, "http://./es/"), (6, "http://net./es/"), (7, "http://.net/es/")], "page_id bigint, url string")
    url_cascade.judge(pages.where("page_id = 2")).collect()  # code is compiled
    start = time.perf_counter()
    judged = url_cascade.judge(pages)
    planned = time.perf_counter() - start
    got = {r.id: r for r in judged.collect()}
    took = time.perf_counter() - start - planned
    assert [(got[i].rule, got[i].verdict) for i in range(1, 8)] == [("net/es/", "block")] * 3 + [("www.example.com/en/", "allow"), (None, "allow"), (None, "allow"), ("net/es/", "block")]
    assert took < 5, took


def test_level_one_grows_with_the_logarithm_of_the_universe(spark):
    assert url_cascade.bits_per_key(10, 5) == url_cascade.BITS_PER_KEY
    assert url_cascade.bits_per_key(10 ** 13, 10 ** 3) - url_cascade.bits_per_key(10 ** 11, 10 ** 3) in (9, 10)
    listed = spark.range(50).selectExpr("concat('k', id) AS key")
    universe = spark.range(200_000).selectExpr("concat('k', id) AS key")
    c = url_cascade.Cascade(listed, universe, url_cascade.bits_per_key(200_000, 50))
    assert universe.where(c.holds(F.col("key"))).count() == 50
    assert all(level.n <= 50 / 4 for level in c.levels[1:])  # few wrong keys pass


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect() == []
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert url_cascade.judge(pages).collect() == []
    manifest = warc_zip.write_packages(pages, warc_zip.package_folder(spark))
    assert warc_zip.read_packages(manifest).collect() == []


def test_null_page_ids_are_packed_and_read(spark):
    same = "s" * 150
    pages = spark.createDataFrame([(None, "http://a", same), (3, "http://b", same), (None, "http://c", "x"), (5, "http://d", same)], "page_id bigint, url string, html string")
    got = warc_zip.read_packages(warc_zip.write_packages(pages, warc_zip.package_folder(spark))).collect()
    assert len(got) == 4 and sorted(r.payload_bytes for r in got) == [1, 150, 150, 150]
    assert sum(r.page_id is None for r in got) == 2
    assert {r.record_type for r in got if r.page_id == 5} == {"revisit"}


@pytest.mark.parametrize("key", ["size", "top", "rest", "post", "p", "doc"])
def test_language_keys_may_have_any_name(spark, key):
    texts = [("the cat and the dog of the house are in the garden", "en"), ("der hund und die katze sind in dem garten des hauses", "de")] * 20
    docs = spark.createDataFrame([(i, t, lang, f"h{i % 3}") for i, (t, lang) in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    model = language.fit(docs)
    nothing = F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").alias(key), F.col("source").alias("host"), F.col("lang").alias("declared"), nothing.alias("suffix"), "text")
    got = language.identify(rows, model, [key]).collect()
    assert sorted(r[key] for r in got) == list(range(40))
    assert math.isclose(sum(r[key] for r in got), sum(range(40)))
