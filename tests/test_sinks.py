"""Writers and readers on edge cases, saved models, and the dip model against closed forms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dipscan import plans, sinks, sources, table_queries
from dipscan.operators import catalog, fitting, metrics, search

DATA = "/root/testdata/sf0.001"


def test_csv_keeps_quotes_line_ends_and_nulls(spark, tmp_path):
    rows = [(1, 'a "quoted", text'), (2, "two\nlines"), (3, None), (4, "ünï")]
    schema = T.StructType.fromDDL("k bigint, v string")
    sinks.write_csv(spark.createDataFrame(rows, schema), str(tmp_path / "x"))
    assert sorted(tuple(r) for r in sources.read_csv(spark, str(tmp_path / "x"), schema, line_ends=True).collect()) == rows


def test_upsert_into_empty_table(spark, tmp_path):
    schema = T.StructType.fromDDL("k bigint, v string")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    sinks.write_csv(spark.createDataFrame([], schema), a)
    sinks.upsert_csv(spark.createDataFrame([(1, "x")], schema), a, ["k"], schema, b)
    assert [tuple(r) for r in sources.read_csv(spark, b, schema).collect()] == [(1, "x")]


def test_arrays_repeat_and_keep_nulls(spark, tmp_path):
    folder = f"file://{tmp_path}/arrays"
    rows = [("7", 1, 2.0, None, None, 1.5, None), ("7", 2, 1.0, 0.5, 4, None, 2.0), (None, 3, 1.0, 1.0, 0, 0.0, 0.0), ("SYN_7", 4, 0.0, 1.0, 1, 0.0, 0.0)]
    lc = spark.createDataFrame(rows, "tic_id string, event_id bigint, t double, flux double, quality int, c1 double, c2 double")
    for _ in range(2):  # a repeated write leaves the same files
        made = sinks.write_arrays(lc, folder).collect()
    assert sorted((r.tic_id, r.n_rows) for r in made) == [("7", 2), ("SYN_7", 1)]
    assert sources.listed(spark, folder).count() == 2
    back = sources.scan_npz(spark, folder).where("tic_id = '7'").orderBy("t").collect()
    assert [(r.t, r.flux, r.quality, r.c1, r.c2) for r in back] == [(1.0, 0.5, 4, None, 2.0), (2.0, None, 0, 1.5, None)]


def test_fits_table_layout_and_empty():
    data = sinks.fits_table(pd.DataFrame({"id": ["a", None], "x": [1.5, np.nan]}))
    assert len(data) % 2880 == 0
    head = sources.fits_headers(data)
    assert [h.get("EXTNAME") for h in head] == [None, "CATALOG"]
    assert (head[1]["NAXIS1"], head[1]["NAXIS2"], head[1]["TFORM1"], head[1]["TFORM2"]) == ("9", "2", "1A", "1D")
    assert len(sinks.fits_table(pd.DataFrame({"id": pd.Series([], dtype=object)}))) == 2 * 2880


def test_saved_model_scores_alike(spark):
    got = {r.p_partkey: r.score for r in table_queries.model_S17_K6(spark, DATA).collect()}
    rows = sources.table(spark, DATA, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), (F.col("p_size") > 25).cast("int").alias("label"))
    model = plans.fit_classifier(rows.where("p_partkey % 2 = 0"), ["size", "price"], trees=3)
    want = {r.p_partkey: round(r.score, 6) for r in plans.scored(model, rows.where("p_partkey % 2 = 1")).collect()}
    assert got and got == want


@pytest.mark.parametrize("k", [0.05, 0.1])
def test_residuals_follow_the_model(spark, k):
    """A uniform disc loses k squared; far from the dip the model is 1."""
    assert fitting.transit_model(np.array([0.0, 0.3, 2.0]), k, limb=(0.0, 0.0), rings=20_000) == pytest.approx([1 - k * k, 1 - k * k, 1.0], abs=1e-4)
    rows = [("1", 1, 0.0, 1.0), ("1", 2, 1.0, 1.2), ("1", 3, 0.0, None)]
    lc = spark.createDataFrame(rows, "tic_id string, event_id bigint, t double, flux double")
    for c, v in {"period": 4.0, "t0": 0.0, "rp_rs": k, "a_rs": 10.0, "b": 0.0, "sigma": 0.1}.items():
        lc = lc.withColumn(c, F.lit(v))
    a, b, c = fitting.residuals(lc).orderBy("event_id").collect()
    assert a.model < 1 - k * k and a.residual == pytest.approx((1 - a.model) / 0.1)
    assert b.model == 1.0 and b.residual == pytest.approx(2.0) and b.log_like == pytest.approx(-2.0 - np.log(0.1))
    assert c.residual is None and c.log_like is None


def test_small_helpers_on_nulls_and_ties(spark):
    df = spark.createDataFrame([("b", [0.5, 0.5]), ("a", None), (None, []), ("b", [0.1, 0.9])], "k string, p array<double>")
    assert [tuple(r) for r in catalog.class_codes(df, "k", "code").groupBy("k", "code").count().orderBy("k").collect()] == [(None, None, 1), ("a", 0, 1), ("b", 1, 2)]
    got = {(r.k, r.predicted, r.confidence, r.to_review) for r in search.routed(df, "p").collect()}
    assert got == {("b", 0, 0.5, True), ("a", None, None, None), (None, None, None, None), ("b", 1, 0.9, False)}
    assert metrics.mean_abs_attribution(spark.createDataFrame([], "x double"), ["x"]).collect()[0].mean_abs is None
    assert catalog.feature_columns(spark.createDataFrame([], "x double, s string")) == []


def test_signals_are_packed_and_read_back(spark, tmp_path):
    rows = [(None if s == 7 else str(s), k, 1.5 * k, None if k % 2 else k / 8, float(s), 2.0) for s in range(60) for k in range(1, 4 + s % 3)]
    signals = spark.createDataFrame(rows, "tic_id string, tce int, period double, epoch double, depth double, duration double")
    folder = f"file://{tmp_path}/signals"
    paths = {r.tic_id: r.path for r in sinks.write_signals(signals, folder, package=50_000).collect()}
    files = [p for p in tmp_path.rglob("*") if p.is_file()]
    assert len(paths) == 60 and len(files) < 60 and sum(p.stat().st_size for p in files) < 0.1 * 2880 * (60 + len(rows))
    got = sources.scan_fits(spark, folder).collect()
    assert sorted(map(repr, (tuple(r)[1:] for r in got))) == sorted(repr((s, f"TCE_{k}", *v)) for s, k, *v in rows)
    assert {r.tic_id: r.path.rpartition("signals/")[2] for r in got} == {s: p.rpartition("signals/")[2] for s, p in paths.items()}
    assert sources.scan_fits(spark, folder, "TIC_5_*.fits").select("tic_id").distinct().collect() == [("5",)]
