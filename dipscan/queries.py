"""Registered queries over the driver's tables: one for each relational or series operator.

Curves are read from ``events`` (see ``sources.light_curves``), so gaps, windows and
bins are scaled to about 67 rows in 30 days per star.  Every query reads its
whole tables.  Results are rounded to six digits, as sums depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as X
from . import plans, streaming
from .plans import stacking
from .operators import catalog, features, fitting, metrics, search, series, vetting
from .shared import written
from .sources import light_curves, table, toi_catalogue

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves with an ephemeris: period, t0 and dip length of every star."""
    lc = light_curves(spark, sf_dir)
    return lc.withColumn("period", 2.0 + F.col("tic_id").cast("bigint") % 7 * 0.5).withColumn("t0", F.min("t").over(series.star())).withColumn("dur", F.lit(0.6))


def unit_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.normalised(curves(spark, sf_dir))


def dirty_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    dirty = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("TIC "), k)).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("TIC_"), k)).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit(" "), k, F.lit(".0"))).otherwise(F.concat(F.lit("SYN_"), k))
    return table(spark, sf_dir, "customer").select("c_custkey", dirty.alias("raw"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scored rows: y from the status, a score with ties from price and key."""
    o = table(spark, sf_dir, "orders")
    score = (F.col("o_orderkey") % 97 + F.when(F.col("o_orderstatus") == "F", 20).otherwise(0)) / 120.0
    return o.select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.round(score, 4).alias("score")).withColumn("pred", (F.col("score") >= 0.5).cast("int"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("grp"), F.col("c_mktsegment").alias("label"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumn("tic_id", F.col("c_custkey").cast("string"))


# -- catalogue ---------------------------------------------------------------


@query
def quality_mask_F2(spark, sf_dir):
    return series.good(light_curves(spark, sf_dir)).select("event_id", "quality")


@query
def label_map_P7(spark, sf_dir):
    return toi_catalogue(spark, sf_dir).select("toi", X.disposition_label(F.col("disposition")).alias("label"))


@query
def norm_id_X1(spark, sf_dir):
    return dirty_ids(spark, sf_dir).select("c_custkey", X.norm_id(F.col("raw")).alias("tic_id"))


@query
def priority_labels_W1(spark, sf_dir):
    toi = toi_catalogue(spark, sf_dir).withColumn("label", X.disposition_label(F.col("disposition")))
    c = customers(spark, sf_dir)
    confirmed, tce = c.where("c_mktsegment = 'BUILDING'").withColumn("label", F.lit(0)), c.withColumn("label", F.lit(-1))
    return catalog.priority_labels((confirmed, "nasa_confirmed", 0), (toi, "exofop_toi", 1), (tce, "spoc_tce", 2))


@query
def upsert_J6(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    base = c.where("c_custkey % 3 != 0").select("c_custkey", "c_acctbal")
    new = c.where("c_custkey % 3 != 1").select("c_custkey", (F.col("c_acctbal") + 1000).alias("c_acctbal"), "c_mktsegment")
    return rounded(catalog.upsert(base, new, ["c_custkey"]))


@query
def lookup_left_J1(spark, sf_dir):
    labels = catalog.first_per_key(toi_catalogue(spark, sf_dir).withColumn("label", X.disposition_label(F.col("disposition"))), ["tic_id"], [F.desc("toi")])
    return catalog.lookup(customers(spark, sf_dir).select("tic_id"), labels, "tic_id", {"label": -1})


@query
def stellar_join_J2(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    stars = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return catalog.lookup(c.select("c_custkey", "c_nationkey"), stars, "c_nationkey", {"n_name": None}).select("c_custkey", "n_name")


@query
def semi_J4(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select("c_custkey")


@query
def anti_resume_J5(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(done, "c_custkey", "left_anti").select("c_custkey")


@query
def host_resolve_J7(spark, sf_dir):
    c = customers(spark, sf_dir).select(F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("SYN_"), F.col("tic_id"))).otherwise(F.col("tic_id")).alias("tic_id"))
    made = customers(spark, sf_dir).where("c_custkey % 5 = 0").select(F.concat(F.lit("SYN_"), F.col("tic_id")).alias("tic_id"), F.concat(F.lit("/data/TIC_"), F.col("c_custkey") + 1, F.lit(".npz")).alias("host_path"))
    return catalog.hosts_of(c, made)


@query
def interleave_W10(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return catalog.interleave(c, ["c_mktsegment"], [F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit("42"))), F.col("c_custkey")], 100).select("c_custkey", "c_mktsegment", "rn")


@query
def union_by_name_U1(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return rounded(a.unionByName(b, allowMissingColumns=True))


@query
def value_counts_A1(spark, sf_dir):
    return catalog.value_counts(light_curves(spark, sf_dir), "quality")


@query
def status_tally_A2(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(~F.col("o_orderstatus").isin("F", "O")).alias("other"), F.count_distinct("o_custkey").alias("stars"))


@query
def dedup_first_A4(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return catalog.first_per_key(o, ["o_custkey"], [F.col("o_orderkey")])


@query
def impute_A17(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice")).alias("price"))
    return rounded(catalog.impute_median(p, ["price"]))


@query
def topk_O3(spark, sf_dir):
    return rounded(table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice"))


@query
def set_difference_U2(spark, sf_dir):
    ids = lambda name, c: table(spark, sf_dir, name).select(F.col(c).alias("id"))
    return ids("customer", "c_custkey").exceptAll(ids("supplier", "s_suppkey")).withColumn("common", F.lit(False)).unionByName(ids("customer", "c_custkey").intersect(ids("supplier", "s_suppkey")).withColumn("common", F.lit(True)))


@query
def json_flatten_P8(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct("event_id", F.col("p.k").alias("k"))).alias("json"))


# -- series ------------------------------------------------------------------


@query
def median_norm_T4(spark, sf_dir):
    return rounded(series.normalised(light_curves(spark, sf_dir)).select("event_id", "flux"))


@query
def mad_A7(spark, sf_dir):
    return rounded(series.mad_sigma(light_curves(spark, sf_dir)))


@query
def p2p_sigma_A8(spark, sf_dir):
    return rounded(series.p2p_sigma(light_curves(spark, sf_dir)))


@query
def moments_A10(spark, sf_dir):
    return rounded(light_curves(spark, sf_dir).groupBy("tic_id").agg(F.stddev_pop("flux").alias("std"), F.skewness("flux").alias("skewness"), F.kurtosis("flux").alias("kurtosis"), F.avg("flux").alias("mean")))


@query
def percentiles_A11(spark, sf_dir):
    p = light_curves(spark, sf_dir).groupBy("tic_id").agg(F.percentile("flux", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("p"))
    return rounded(p.select("tic_id", F.col("p")[0].alias("p05"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p95")))


@query
def mean_abs_change_A13(spark, sf_dir):
    """Both sides round a little above the value, as a mean of two-digit values can lie in the middle of two roundings."""
    s = features.mean_abs_change(light_curves(spark, sf_dir))
    return rounded(s.select("tic_id", *[(F.col(c) + 1e-9).alias(c) for c in ("mean_abs_change", "abs_energy")]), 4)


@query
def lag_gap_W4(spark, sf_dir):
    return rounded(series.gap_flags(light_curves(spark, sf_dir), cadence=0.3).select("event_id", "dt", "after_gap"))


@query
def longest_segment_T6(spark, sf_dir):
    return series.longest_segment(light_curves(spark, sf_dir), gap=2.0).select("event_id", "tic_id", "seg")


@query
def sigma_clip_W6(spark, sf_dir):
    return series.clipped(light_curves(spark, sf_dir), sigma=1.5).select("event_id")


@query
def rolling_median_W7(spark, sf_dir):
    return rounded(series.rolling_median(light_curves(spark, sf_dir), half=1.0).select("event_id", "trend"))


@query
def time_bin_T7(spark, sf_dir):
    b = series.time_bins(light_curves(spark, sf_dir), 1.0)
    return rounded(b.select("tic_id", "k", F.col("t").alias("t"), "flux", "n"), 5)


@query
def fold_bin_T2(spark, sf_dir):
    return rounded(series.fold_bins(unit_curves(spark, sf_dir), 20))


@query
def phase_std_T17(spark, sf_dir):
    b = series.fold_bins(unit_curves(spark, sf_dir), 20)
    return rounded(b.groupBy("tic_id").agg(F.stddev_pop("flux").alias("phase_folded_std")))


@query
def binned_median_A15(spark, sf_dir):
    rows = series.folded(unit_curves(spark, sf_dir)).withColumn("bin", X.bin_index(F.col("phi"), -0.5, 0.5, 10)).where("bin is not null")
    s = rows.groupBy("tic_id", "bin").agg(F.median("flux").alias("flux"), (1.253 * F.stddev_pop("flux") / F.sqrt(F.count("flux"))).alias("error"), F.count("flux").alias("n"))
    return rounded(s.where("n >= 5"))


@query
def autocorr_W8(spark, sf_dir):
    lc = light_curves(spark, sf_dir)
    return rounded(series.autocorrelation(lc, 1).withColumnRenamed("ac", "ac1").join(series.autocorrelation(lc, 10).withColumnRenamed("ac", "ac10"), "tic_id"))


@query
def quality_gate_T8(spark, sf_dir):
    g = series.quality_gate(series.normalised(series.good(light_curves(spark, sf_dir))), min_days=28.0, max_rms=0.9)
    return rounded(g)


@query
def interp_J10(spark, sf_dir):
    lc = light_curves(spark, sf_dir)
    grid = lc.groupBy("tic_id").agg(F.min("t").alias("a"), F.max("t").alias("b")).select("tic_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("k"), "a", "b")
    grid = grid.select("tic_id", (F.floor("a") + F.col("k") + 0.123456).alias("t"))
    return rounded(series.interpolated(lc, grid))


@query
def nearest_epoch_J9(spark, sf_dir):
    return curves(spark, sf_dir).select("event_id", X.nearest_epoch(F.col("t"), F.col("period"), F.col("t0")).alias("epoch"))


@query
def transit_window_T21(spark, sf_dir):
    dt = F.abs(X.hours_from_mid(F.col("t"), F.col("period"), F.col("t0"))) / 24
    return curves(spark, sf_dir).where(dt < F.greatest(3 * F.col("dur") / 4, F.lit(0.05))).select("event_id")


@query
def thin_W15(spark, sf_dir):
    return series.thinned(light_curves(spark, sf_dir), ["tic_id"], ["t", "event_id"], 10).select("event_id")


# -- features ----------------------------------------------------------------


@query
def shape_T12(spark, sf_dir):
    return rounded(features.shape(unit_curves(spark, sf_dir), min_points=2, min_total=32))


@query
def odd_even_T13(spark, sf_dir):
    return rounded(features.odd_even(unit_curves(spark, sf_dir), min_points=1, min_epochs=2))


@query
def centroid_T14(spark, sf_dir):
    return rounded(features.centroid(curves(spark, sf_dir), min_points=2))


@query
def ts_stats_T15(spark, sf_dir):
    return rounded(features.statistics(unit_curves(spark, sf_dir)))


@query
def dft_T16(spark, sf_dir):
    return rounded(features.dft(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), 5)


@query
def hz_T18(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (4000 + F.col("c_custkey") % 3000).cast("double").alias("teff"), (0.5 + F.col("c_custkey") % 10 * 0.1).alias("rad"), (0.6 + F.col("c_custkey") % 7 * 0.1).alias("mass"), (5 + F.col("c_custkey") % 700).cast("double").alias("period"))
    return rounded(features.habitable_zone(c).select("c_custkey", "a_au", "inner_au", "outer_au", "hz_in_zone", "hz_proximity"))


@query
def density_prior_T23(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 10 * 0.1).alias("rad"), (0.6 + F.col("c_custkey") % 7 * 0.1).alias("mass"), (1 + F.col("c_custkey") % 30).cast("double").alias("period"))
    return rounded(features.density_prior(c).select("c_custkey", "ln_a", "ln_a_sd"))


@query
def size_class_T27(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.size_class(F.when(F.col("p_size") < 45, F.col("p_size") / 2.5)).alias("size_class"))


@query
def diagnostics_T29(spark, sf_dir):
    return rounded(features.diagnostics(unit_curves(spark, sf_dir)))


# -- search, vetting, ranking ------------------------------------------------


@query
def bls_T9(spark, sf_dir):
    return rounded(search.box_search(series.normalised(light_curves(spark, sf_dir)), **search.SQL_GRID))


@query
def candidates_T11(spark, sf_dir):
    found = rounded(search.box_search(series.normalised(light_curves(spark, sf_dir)), **search.SQL_GRID).select("tic_id", "sde"))
    return found.withColumn("is_candidate", search.is_candidate(F.col("sde"), min_sde=3.0))


@query
def ranked_dips(spark, sf_dir):
    return rounded(search.ranked_dips(light_curves(spark, sf_dir), **search.SQL_GRID))


def _fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    d = lambda m, s: F.when(k % m != 0, (k % m) * s)
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("tic_id"), d(11, 0.5).alias("odd_even_sigma"), d(7, 0.05).alias("odd_even_frac"), d(13, 0.4).alias("secondary_sigma"), d(5, 0.04).alias("secondary_frac"),
        d(17, 0.2).alias("centroid_sigma"), d(29, 0.8).alias("radius"), d(19, 1.0).alias("snr"), d(10, 0.105).alias("b"), (k % 6 != 0).alias("converged"), d(9, 0.1).alias("p"),
    )


@query
def vetting_R1(spark, sf_dir):
    return vetting.vetted(_fits(spark, sf_dir)).select("tic_id", "flags", "verdict", F.size("hard").alias("n_hard"))


@query
def rank_R3(spark, sf_dir):
    return rounded(vetting.rank_score(vetting.vetted(_fits(spark, sf_dir))).select("tic_id", "rank_score"))


@query
def catalog_R5(spark, sf_dir):
    scored = rounded(vetting.rank_score(vetting.vetted(_fits(spark, sf_dir))).select("tic_id", "verdict", "rank_score"))
    return vetting.catalogue(scored)


@query
def posterior_summary_T28(spark, sf_dir):
    return rounded(vetting.posterior_summary(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice"))


@query
def kpi_R9(spark, sf_dir):
    s = features.statistics(unit_curves(spark, sf_dir)).where("rms is not null")
    return s.groupBy(F.width_bucket("rms", F.lit(0.0), F.lit(2.0), F.lit(20)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


# -- evaluation --------------------------------------------------------------


@query
def confusion_A20(spark, sf_dir):
    return metrics.confusion(scores(spark, sf_dir))


@query
def prf_A21(spark, sf_dir):
    return rounded(metrics.precision_recall_f1(scores(spark, sf_dir)))


@query
def roc_auc_A22(spark, sf_dir):
    return rounded(metrics.roc_auc(scores(spark, sf_dir)))


@query
def avg_precision_A23(spark, sf_dir):
    return rounded(metrics.average_precision(scores(spark, sf_dir)))


@query
def brier_A24(spark, sf_dir):
    return rounded(metrics.brier(scores(spark, sf_dir)))


@query
def group_split_M2(spark, sf_dir):
    return metrics.group_split(groups(spark, sf_dir))


@query
def learning_fraction_W14(spark, sf_dir):
    return metrics.learning_groups(groups(spark, sf_dir))


# -- streams, grouped tasks, learning ----------------------------------------


@query
def tumbling_bins(spark, sf_dir):
    return rounded(streaming.run_available(streaming.tumbling_bins(streaming.event_stream(spark, sf_dir)), "bins"), 4)


@query
def session_segments(spark, sf_dir):
    return streaming.run_available(streaming.session_segments(streaming.event_stream(spark, sf_dir)), "sessions")


@query
def biweight_W7(spark, sf_dir):
    return rounded(fitting.detrended(light_curves(spark, sf_dir), width=3.0))


@query
def inject_T19(spark, sf_dir):
    return rounded(fitting.injected(series.normalised(light_curves(spark, sf_dir))))


@query
def fit_T25(spark, sf_dir):
    lc = unit_curves(spark, sf_dir).withColumn("ln_a", F.lit(2.0))
    return rounded(fitting.fitted(lc, min_points=10))


@query
def gbt_M4(spark, sf_dir):
    train, test, columns = _text_features(spark, sf_dir)
    model = plans.fit_classifier(train, columns, trees=300, depth=6, rate=0.05, rows=0.8, group="grp")
    return rounded(plans.scored(model, test).select("doc_id", "label", "score"))


# -- windows, epochs, derived parameters, selection --------------------------


@query
def fold_T1(spark, sf_dir):
    return rounded(series.folded(curves(spark, sf_dir)).select("event_id", "phi"))


@query
def hours_T3(spark, sf_dir):
    return rounded(curves(spark, sf_dir).select("event_id", X.hours_from_mid(F.col("t"), F.col("period"), F.col("t0")).alias("hours")), 5)


@query
def gap_fill_T5(spark, sf_dir):
    lc = light_curves(spark, sf_dir).withColumn("flux", F.when(F.col("event_id") % 4 != 0, F.col("flux")))
    return rounded(series.gap_filled(lc).select("event_id", "flux"), 4)


@query
def adaptive_bin_T22(spark, sf_dir):
    return rounded(series.adaptive_bins(light_curves(spark, sf_dir), most=60, size=2.0))


@query
def epoch_join_J8(spark, sf_dir):
    return rounded(series.epoch_windows(unit_curves(spark, sf_dir)), 5)


@query
def epochs_X10(spark, sf_dir):
    return rounded(series.epochs(curves(spark, sf_dir)), 5)


@query
def derived_T26(spark, sf_dir):
    k = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (1.0 + k % 40).alias("period"), (0.01 + F.col("l_discount")).alias("rp_rs"), (F.col("l_tax") * 12).alias("b"), (3.0 + F.col("l_quantity")).alias("a_rs"),
        F.lit(0.002).alias("sigma"), F.col("l_linenumber").alias("n_in"), F.when(k % 5 != 0, (k % 5) * 0.4).alias("rad"), F.when(k % 7 != 0, 4000.0 + k % 3000).alias("teff"),
    )
    out = features.derived_parameters(rows).select("l_orderkey", "l_linenumber", "inc_deg", "depth_ppm", "t14_hr", "fit_snr", "rp_rearth", "a_au", "teq_k", "hz_score", "in_hz")
    return rounded(out, 4)


@query
def select_M12(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.when(k % 9 == 0, "SYN_").otherwise(""), k.cast("string")).alias("tic_id"), F.when(k % 8 == 0, "failed").otherwise("done").alias("status"), F.when(k % 6 != 0, 1.0).alias("period"),
        F.when(k % 4 != 0, (k % 10) * 0.1).alias("p_transit"), ((k % 23) * 0.5).alias("sde"), F.when(k % 3 == 0, 0.001).when(k % 3 == 1, 0.5).alias("fap"),
    )
    return rounded(search.selected(rows).select("tic_id", "p_transit", "sde"))


@query
def group_folds_M3(spark, sf_dir):
    return stacking.group_folds(groups(spark, sf_dir))


@query
def plot_fold_R7(spark, sf_dir):
    """The folded, binned curve behind a plot, with the star's deepest bin beside it."""
    bins = series.fold_bins(unit_curves(spark, sf_dir), 40)
    low = bins.groupBy("tic_id").agg(F.min("flux").alias("lowest"), F.sum("n").alias("points"))
    return rounded(bins.join(low, "tic_id").select("tic_id", "bin", "flux", "n", "lowest", "points"))


def _text_features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(train, test, features) of documents and their quality labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").cast("double").alias("chars"), F.size(F.split("text", " ")).cast("double").alias("words"), F.size(F.split("text", "[.]")).cast("double").alias("stops"))
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id").withColumn("grp", F.concat("source", F.lit("/"), F.col("doc_id") % 5))
    train, test = plans.split_by_group(rows)
    # learners pass over the rows many times: a few numbers of each document are written once, the texts read once
    both = written(train.withColumn("held", F.lit(False)).unionByName(test.withColumn("held", F.lit(True))), "text-features")
    return both.where("NOT held").drop("held"), both.where("held").drop("held"), ["chars", "words", "stops"]


@query
def stacked_M6(spark, sf_dir):
    train, test, columns = _text_features(spark, sf_dir)
    return rounded(stacking.stacked(train, test, columns).select("doc_id", "label", "score"))


@query
def learning_curve_M9(spark, sf_dir):
    return rounded(stacking.learning_curve(*_text_features(spark, sf_dir)))


@query
def importance_M10(spark, sf_dir):
    train, test, columns = _text_features(spark, sf_dir)
    return rounded(stacking.permutation_importance(plans.fit_classifier(train, columns), test, columns, "doc_id", repeats=2))


@query
def posterior_T25(spark, sf_dir):
    """Chains of full length for the best few dips: a top-k report, as a chain takes seconds."""
    best = search.ranked_dips(light_curves(spark, sf_dir), top=8, **search.SQL_GRID).select("tic_id")
    lc = unit_curves(spark, sf_dir).withColumn("ln_a", F.lit(2.0)).join(F.broadcast(best), "tic_id", "left_semi")
    s = fitting.sampled(lc, min_points=10).groupBy("tic_id").agg(F.count("*").alias("n"), F.first("converged").alias("converged"), F.first("acceptance").alias("acceptance"), F.first("tau").alias("tau"), F.first("method").alias("method"), *[F.median(c).alias(c) for c in ("tc", "rp_rs", "b", "ln_a", "ln_sigma")])
    return rounded(s)
