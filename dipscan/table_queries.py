"""Registered queries over readers, writers, projections, filters, scalars and small aggregates.

Each stands beside its DuckDB SQL.  Writers put their files into a new folder of
the shared checkpoint folder, and the query returns what a reader finds there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import functions as X
from . import plans, sinks, sources
from .operators import catalog, features, fitting, metrics, ordered, search, series
from .oracles import _BIN, _BOX, _LC, _PHI, _SCORES, _UNIT
from .queries import curves, groups, rounded, scores, unit_curves
from .sources import light_curves, table
from .shared import shared_folder
from .streaming import event_stream, run_available

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _ddl(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


# -- readers and writers -----------------------------------------------------

CUSTOMER = "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string"


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_S1_K1(spark, sf_dir):
    path = shared_folder(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return sources.read_csv(spark, path, _ddl(CUSTOMER))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation WHERE n_nationkey % 3 <> 0")
def csv_comments_S2(spark, sf_dir):
    path = shared_folder(spark, "comments")
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").select(F.concat(F.when(k % 3 == 0, "# ").otherwise(""), k.cast("string"), F.lit(","), "n_name").alias("value"))
    n.write.text(path)
    return spark.read.schema("n_nationkey string, n_name string").option("comment", "#").csv(path)


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 5 <> 0")
def csv_malformed_S3(spark, sf_dir):
    """Rows whose key is no number are left out."""
    path = shared_folder(spark, "malformed")
    k = F.col("s_suppkey")
    sinks.write_csv(table(spark, sf_dir, "supplier").select(F.when(k % 5 == 0, F.concat(F.lit("x"), k)).otherwise(k.cast("string")).alias("s_suppkey"), "s_name"), path)
    return sources.read_csv(spark, path, _ddl("s_suppkey bigint, s_name string"), mode="DROPMALFORMED")


@query("SELECT s_suppkey, s_name FROM supplier")
def csv_padded_S4(spark, sf_dir):
    path = shared_folder(spark, "padded")
    s = table(spark, sf_dir, "supplier")
    s.select(F.format_string("  %d ", "s_suppkey").alias(" s_suppkey "), F.format_string(" %s  ", "s_name").alias("s_name  ")).write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return sources.read_csv(spark, path, _ddl("s_suppkey bigint, s_name string"))


@query("SELECT o_orderkey % 3 AS part, count(*) AS n, count(DISTINCT o_custkey) AS stars FROM orders GROUP BY ALL")
def csv_append_K2(spark, sf_dir):
    """A checkpoint that grows by appended files."""
    path = shared_folder(spark, "append")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 3).alias("part"))
    for part in range(3):
        sinks.append_csv(o.where(F.col("part") == part), path)
    rows = sources.read_csv(spark, path, _ddl("o_orderkey bigint, o_custkey bigint, part bigint"))
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("stars"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS version FROM customer")
def csv_upsert_K5(spark, sf_dir):
    old, new = shared_folder(spark, "old"), shared_folder(spark, "new")
    c = table(spark, sf_dir, "customer").select("c_custkey")
    sinks.write_csv(c.where("c_custkey % 3 != 0 OR c_custkey % 2 != 0").withColumn("version", F.lit("old")), old)
    schema = _ddl("c_custkey bigint, version string")
    sinks.upsert_csv(c.where("c_custkey % 2 = 0").withColumn("version", F.lit("new")), old, ["c_custkey"], schema, new)
    return sources.read_csv(spark, new, schema)


@query("SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size END AS size, p_brand AS brand FROM part")
def json_S15_K4(spark, sf_dir):
    path = shared_folder(spark, "json")
    sinks.write_json(table(spark, sf_dir, "part").select("p_partkey", F.struct(F.when(F.col("p_size") > 10, F.col("p_size")).alias("size"), F.col("p_brand").alias("brand")).alias("fit")), path)
    return sources.read_json(spark, path, _ddl("p_partkey bigint, fit struct<size: int, brand: string>")).select("p_partkey", "fit.size", "fit.brand")


def _arrays(spark: SparkSession, sf_dir: str) -> str:
    folder = shared_folder(spark, "arrays")
    sinks.write_arrays(light_curves(spark, sf_dir), folder).write.format("noop").mode("overwrite").save()
    return folder


@query(f"WITH {_LC} SELECT tic_id, count(*) AS n, round(sum(flux), 4) AS flux, round(min(t), 5) AS first, round(max(t), 5) AS last, sum(quality)::BIGINT AS quality FROM lc GROUP BY tic_id")
def arrays_S13_K3(spark, sf_dir):
    """Curves through an array file for each star and back."""
    rows = sources.scan_npz(spark, _arrays(spark, sf_dir))
    return rounded(rows.groupBy("tic_id").agg(F.count("*").alias("n"), F.round(F.sum("flux"), 4).alias("flux"), F.round(F.min("t"), 5).alias("first"), F.round(F.max("t"), 5).alias("last"), F.sum("quality").alias("quality")))


@query(f"WITH {_LC} SELECT DISTINCT tic_id, true AS has_bytes FROM lc WHERE tic_id IS NOT NULL")
def listing_S16(spark, sf_dir):
    files = sources.listed(spark, _arrays(spark, sf_dir))
    return files.select(F.regexp_extract("path", r"TIC_(.*)\.npz$", 1).alias("tic_id"), (F.col("size") > 0).alias("has_bytes"))


@query("SELECT c_name, CAST(c_custkey AS DOUBLE) AS c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN round(c_acctbal, 6) END AS balance, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment FROM customer")
def fits_table_K7(spark, sf_dir):
    folder = shared_folder(spark, "fits")
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_name", "c_custkey", F.when(k % 4 != 0, F.col("c_acctbal")).alias("balance"), F.when(k % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    sinks.write_fits(c, folder).write.format("noop").mode("overwrite").save()
    return rounded(sources.scan_fits_table(spark, folder, _ddl("c_name string, c_custkey double, balance double, segment string")))


@query()
def model_S17_K6(spark, sf_dir):
    """Scores of a model that was saved and loaded; the tests hold them against the model itself."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), (F.col("p_size") > 25).cast("int").alias("label"))
    path = shared_folder(spark, "model")
    sinks.save_model(plans.fit_classifier(rows.where(k % 2 == 0), ["size", "price"], trees=3), path)
    return rounded(plans.scored(sinks.load_model(path), rows.where(k % 2 == 1)).select("p_partkey", "score"))


# -- projections and filters -------------------------------------------------


@query("SELECT c_custkey AS id, c_name AS name, 'CP' AS disposition, 0 AS label, CAST(NULL AS DOUBLE) AS depth FROM customer")
def columns_P1_P2_P3_P4(spark, sf_dir):
    """Rename what is there, keep a list, add constants, then exactly the fixed columns."""
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", " c_custkey ")
    c = catalog.keep_columns(catalog.rename(c, {"c_custkey": "id", "c_name": "name", "absent": "x"}), ["id", "name", "absent"])
    c = c.withColumn("disposition", F.lit("CP")).withColumn("label", F.lit(0))
    return catalog.reindex(c, {"id": "bigint", "name": "string", "disposition": "string", "label": "int", "depth": "double"})


@query("""WITH t AS (SELECT *, CAST(NULL AS DOUBLE) AS empty FROM customer), n AS (SELECT count(COLUMNS(*)) FROM t),
u AS (UNPIVOT n ON COLUMNS(*) INTO NAME feature VALUE filled)
SELECT u.feature FROM u JOIN (DESCRIBE t) d ON d.column_name = u.feature WHERE filled > 0 AND feature <> 'c_custkey' AND (column_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE') OR starts_with(column_type, 'DECIMAL'))""")
def feature_columns_P5(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("empty", F.lit(None).cast("double"))
    names = catalog.feature_columns(c, exclude={"c_custkey"})
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query("SELECT p_partkey, CASE WHEN p_size % 5 IN (0, 1) THEN NULL ELSE p_retailprice END AS price FROM part")
def infinite_to_null_P6(spark, sf_dir):
    odd = F.when(F.col("p_size") % 5 == 0, F.lit(float("inf"))).when(F.col("p_size") % 5 == 1, F.lit(float("nan"))).otherwise(F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", X.no_nan(odd).alias("price"))


@query(f"WITH {_LC} SELECT event_id FROM lc WHERE flux IS NOT NULL AND event_id % 3 <> 0 AND t IS NOT NULL")
def finite_mask_F3(spark, sf_dir):
    lc = light_curves(spark, sf_dir).withColumn("flux", F.when(F.col("event_id") % 3 != 0, F.col("flux")).otherwise(float("nan")))
    return lc.where(X.finite(F.col("t"), F.col("flux"))).select("event_id")


@query(f"WITH {_LC} SELECT event_id FROM lc QUALIFY count(*) OVER (PARTITION BY tic_id) >= 66")
def min_count_F4(spark, sf_dir):
    return series.at_least(light_curves(spark, sf_dir), 66).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice IS NOT NULL AND o_orderkey % 7 > 0 AND starts_with(o_orderpriority, '1-')")
def predicates_F1_F5_F6(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where((F.col("o_orderstatus") == "F") & F.col("o_totalprice").isNotNull() & (F.col("o_orderkey") % 7 > 0) & F.col("o_orderpriority").startswith("1-")).select("o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN NULL ELSE c_mktsegment END AS segment FROM customer")
def bad_values_F9_F10(spark, sf_dir):
    seg = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(~seg.isin("BUILDING", "MACHINERY"), seg).alias("segment"))


@query("""WITH p AS (SELECT o_orderkey, [(o_orderkey % 10) / 10.0::DOUBLE, (9 - o_orderkey % 10) / 10.0::DOUBLE] AS probs FROM orders)
SELECT o_orderkey, CASE WHEN probs[1] >= probs[2] THEN 0 ELSE 1 END AS predicted, round(list_max(probs), 6) AS confidence, list_max(probs) < 0.65::DOUBLE AS to_review FROM p""")
def routing_F11_M7_R8(spark, sf_dir):
    """Predicted class and the active-learning queue: rows whose best probability is low."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.array((k % 10) / 10.0, (9 - k % 10) / 10.0).alias("probs"))
    return rounded(search.routed(rows, "probs").select("o_orderkey", "predicted", "confidence", "to_review"))


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 20 AND p_retailprice BETWEEN 900 AND 1500 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13')")
def dashboard_F12(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.where(F.col("p_size").between(5, 20) & F.col("p_retailprice").between(900, 1500) & F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13")).select("p_partkey")


# -- joins and sets ----------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN s_suppkey IS NOT NULL THEN round(s_acctbal, 6) END AS p_transit FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def fits_left_J3(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("p_transit"))
    return rounded(table(spark, sf_dir, "customer").select("c_custkey").join(s, "c_custkey", "left"))


@query("""WITH r AS (SELECT c_custkey AS grp, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(CAST(c_custkey AS VARCHAR) || '42'), CAST(c_custkey AS VARCHAR)) AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
p AS (SELECT grp, rn <= greatest(1, round_even(n * 0.25::DOUBLE, 0)) AS held FROM r)
SELECT count(*) AS shared_groups FROM (SELECT grp FROM p WHERE held INTERSECT SELECT grp FROM p WHERE NOT held)""")
def disjoint_J12_U3(spark, sf_dir):
    """No group on both sides of the split: the intersection is empty."""
    parts = metrics.group_split(groups(spark, sf_dir))
    side = lambda p: parts.where(F.col("part") == p).select("grp")
    return side("train").intersect(side("test")).agg(F.count("*").alias("shared_groups"))


# -- aggregates and windows --------------------------------------------------


@query(f"""WITH {_LC} SELECT tic_id, round(median(flux), 6) AS med, round(stddev_pop(flux), 6) AS std, round(var_pop(flux), 5) AS var, round(min(flux), 6) AS low, round(max(flux), 6) AS high,
round(max(t) - min(t), 6) AS baseline, count(DISTINCT quality) AS kinds, count(*) FILTER (quality > 0) AS flagged FROM lc GROUP BY tic_id""")
def stats_A3_A5_A6_A9_A18(spark, sf_dir):
    s = light_curves(spark, sf_dir).groupBy("tic_id").agg(
        F.median("flux").alias("med"), F.stddev_pop("flux").alias("std"), F.round(F.var_pop("flux"), 5).alias("var"), F.min("flux").alias("low"), F.max("flux").alias("high"),
        (F.max("t") - F.min("t")).alias("baseline"), F.count_distinct("quality").alias("kinds"), F.count_if(F.col("quality") > 0).alias("flagged"),
    )
    return rounded(s)


@query(f"WITH {_UNIT}, s AS (SELECT *, stddev_pop(flux) OVER (PARTITION BY tic_id) AS sd FROM u) SELECT tic_id, round(avg(CASE WHEN flux > 1 + 1.5 * sd THEN 1.0 ELSE 0.0 END), 6) AS above, round(avg(CASE WHEN flux < 1 - sd THEN 1.0 ELSE 0.0 END), 6) AS below FROM s WHERE flux IS NOT NULL GROUP BY tic_id")
def outlier_share_A12(spark, sf_dir):
    sd = F.stddev_pop("flux").over(series.star())
    rows = unit_curves(spark, sf_dir).withColumn("sd", sd).where("flux is not null")
    return rounded(rows.groupBy("tic_id").agg(F.avg((F.col("flux") > 1 + 1.5 * F.col("sd")).cast("double")).alias("above"), F.avg((F.col("flux") < 1 - F.col("sd")).cast("double")).alias("below")))


@query(f"WITH {_PHI} SELECT tic_id, CAST({_BIN.format(n=16)} AS INTEGER) AS bin, round(avg(flux), 6) AS flux, count(flux) AS n FROM f WHERE phi < 0.5 GROUP BY ALL")
def binned_mean_A14_X9(spark, sf_dir):
    rows = series.folded(unit_curves(spark, sf_dir)).withColumn("bin", X.bin_index(F.col("phi"), -0.5, 0.5, 16)).where("bin is not null")
    return rounded(rows.groupBy("tic_id", "bin").agg(F.avg("flux").alias("flux"), F.count("flux").alias("n")))


@query(f"WITH {_PHI} SELECT tic_id, round(median(flux) FILTER (abs(phi) < 0.1), 6) AS core, round(median(flux) FILTER (abs(phi) > 0.3), 6) AS base FROM f GROUP BY tic_id")
def masked_medians_A16(spark, sf_dir):
    a = F.abs("phi")
    f = series.folded(unit_curves(spark, sf_dir))
    return rounded(f.groupBy("tic_id").agg(F.median(F.when(a < 0.1, F.col("flux"))).alias("core"), F.median(F.when(a > 0.3, F.col("flux"))).alias("base")))


@query(f"WITH {_LC} SELECT tic_id, event_id AS deepest FROM lc WHERE flux IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tic_id ORDER BY flux, t, event_id) = 1")
def argmin_A19(spark, sf_dir):
    """Row of the lowest flux; ties go to the earlier row."""
    best = light_curves(spark, sf_dir).where("flux is not null").groupBy("tic_id").agg(F.min(F.struct("flux", "t", "event_id")).alias("m"))
    return best.select("tic_id", F.col("m.event_id").alias("deepest"))


@query("""WITH a AS (SELECT avg(abs((l_quantity - 25) / 25)) AS v, 'l_quantity' AS feature FROM lineitem UNION ALL SELECT avg(abs((l_discount - 0.05::DOUBLE) / 0.05::DOUBLE)), 'l_discount' FROM lineitem
UNION ALL SELECT avg(abs((l_tax - 0.04::DOUBLE) / 0.04::DOUBLE)), 'l_tax' FROM lineitem) SELECT feature, round(v + 1e-9::DOUBLE, 5) AS mean_abs FROM a ORDER BY v DESC, feature LIMIT 2""")
def attribution_A25(spark, sf_dir):
    """Mean absolute contribution of each feature, the largest first: a top-k report.

    A mean of two-digit values can lie in the middle of two roundings, so both sides round a little above it.
    """
    centre = {"l_quantity": 25.0, "l_discount": 0.05, "l_tax": 0.04}
    values = table(spark, sf_dir, "lineitem").select([((F.col(c) - m) / m).alias(c) for c, m in centre.items()])
    return rounded(metrics.mean_abs_attribution(values, list(centre), top=2).withColumn("mean_abs", F.col("mean_abs") + 1e-9), 5)


@query(f"""WITH {_LC}, d AS (SELECT tic_id, t - lag(t) OVER w AS dt, flux - lag(flux) OVER w AS df FROM lc WINDOW w AS (PARTITION BY tic_id ORDER BY t, event_id)), m AS (SELECT *, median(df) OVER (PARTITION BY tic_id) AS md FROM d)
SELECT tic_id, round(median(dt), 6) AS cadence, round(avg(abs(df)), 6) AS mean_abs_change, round(median(abs(df - md)), 6) AS mad FROM m GROUP BY tic_id""")
def differences_W2_W3(spark, sf_dir):
    w = series.in_time()
    d = light_curves(spark, sf_dir).select("tic_id", (F.col("t") - F.lag("t").over(w)).alias("dt"), (F.col("flux") - F.lag("flux").over(w)).alias("df"))
    d = d.withColumn("md", F.median("df").over(series.star()))
    return rounded(d.groupBy("tic_id").agg(F.median("dt").alias("cadence"), F.avg(F.abs("df")).alias("mean_abs_change"), F.median(F.abs(F.col("df") - F.col("md"))).alias("mad")))


@query("SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || '-7'), c_custkey) AS place FROM customer")
def shuffle_W11(spark, sf_dir):
    """A seeded shuffle within groups, the same on every run."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    order = [F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit("-7"))), "c_custkey"]
    return ordered.ranked_within(c, "c_mktsegment", order, "place").select("c_custkey", "c_mktsegment", F.col("place").cast("bigint").alias("place"))


@query(f"WITH {_UNIT}, e AS (SELECT tic_id, event_id, CAST(floor((t - t0) / period) AS BIGINT) AS k FROM u) SELECT event_id, k, CAST((dense_rank() OVER (PARTITION BY tic_id ORDER BY k) - 1) % 2 AS INTEGER) AS parity FROM e")
def epoch_parity_W12(spark, sf_dir):
    """Parity of each epoch among the epochs that have rows."""
    k = F.floor((F.col("t") - F.col("t0")) / F.col("period"))
    rows = unit_curves(spark, sf_dir).select("tic_id", "event_id", k.alias("k"))
    return rows.select("event_id", "k", ((F.dense_rank().over(Window.partitionBy("tic_id").orderBy("k")) - 1) % 2).cast("int").alias("parity"))


@query(f"WITH {_SCORES}, g AS (SELECT score, count(*) AS n, sum(y)::BIGINT AS pos FROM s GROUP BY score) SELECT score, n, pos, sum(n) OVER (ORDER BY score)::BIGINT AS below, round(sum(n) OVER (ORDER BY score) - (n - 1) / 2.0, 6) AS mid_rank FROM g")
def mid_ranks_W13(spark, sf_dir):
    """Mid-ranks of distinct scores: one row for each score, not for each row."""
    g = scores(spark, sf_dir).groupBy("score").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    g = ordered.running(g, ["score"], {"below": F.col("n")})
    return rounded(g.withColumn("mid_rank", F.col("below") - (F.col("n") - 1) / 2.0))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(o_orderkey || 'pick'), o_orderkey LIMIT 100")
def random_choice_O4(spark, sf_dir):
    """A reproducible choice without replacement: the first rows by a seeded hash."""
    return table(spark, sf_dir, "orders").orderBy(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit("pick"))), "o_orderkey").limit(100).select("o_orderkey", "o_custkey")


@query(f"WITH {_LC} SELECT event_id, row_number() OVER (PARTITION BY tic_id ORDER BY t, event_id) AS place FROM lc")
def in_order_O1_O2(spark, sf_dir):
    return light_curves(spark, sf_dir).select("event_id", F.row_number().over(series.in_time()).cast("bigint").alias("place"))


# -- scalars -----------------------------------------------------------------


@query(r"""SELECT c_custkey, upper(trim(c_name)) AS up, lower(c_mktsegment) AS low, replace(c_name, '#', '-') AS dashed, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, starts_with(c_name, 'Cust') AS starts,
contains(c_mktsegment, 'O') AS has_o, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS padded, substr(c_name, 1, 4) AS head, regexp_extract('/data/TIC_' || c_custkey || '.npz', '([^/]+)\.[^.]*$', 1) AS stem, concat_ws('; ', c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'even' END) AS flags FROM customer""")
def strings_X2(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.upper(F.trim("c_name")).alias("up"), F.lower("c_mktsegment").alias("low"), F.replace("c_name", F.lit("#"), F.lit("-")).alias("dashed"), F.regexp_replace("c_name", "[^0-9]", "").alias("digits"),
        F.col("c_name").startswith("Cust").alias("starts"), F.col("c_mktsegment").contains("O").alias("has_o"), F.lpad(k, 6, "0").alias("padded"), F.substring("c_name", 1, 4).alias("head"),
        F.regexp_extract(F.concat(F.lit("/data/TIC_"), k, F.lit(".npz")), r"([^/]+)\.[^.]*$", 1).alias("stem"), F.concat_ws("; ", "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "even")).alias("flags"),
    )


@query("SELECT p_partkey, format('{} +{:03d} / -{:02d}', p_brand, p_size, p_size % 7) AS shown FROM part")
def format_X3(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.format_string("%s +%03d / -%02d", "p_brand", "p_size", F.col("p_size") % 7).alias("shown"))


@query("""SELECT o_orderkey, ((o_orderkey - 500) % 7 + 7) % 7 AS pm, floor(o_totalprice / 1000)::BIGINT AS fl, round(sqrt(o_totalprice), 6) AS sq, round(ln(o_totalprice), 6) AS ln_p, round(exp(-o_totalprice / 100000), 6) AS ex, round(pow(o_orderkey % 10, 2.5::DOUBLE), 6) AS pw,
round(sqrt(9.0 + pow(o_orderkey % 10, 2)), 6) AS hy, round(asin((o_orderkey % 10) / 10.0::DOUBLE), 6) AS asn, round(degrees(acos((o_orderkey % 10) / 10.0::DOUBLE)), 6) AS acs, least(greatest(o_totalprice, 50000.0::DOUBLE), 90000.0::DOUBLE) AS clipped,
round(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey::DOUBLE / (o_orderkey % 4) END, 6) AS safe, coalesce(nullif(o_orderkey % 3, 0), -1) AS defaulted, CAST(o_orderkey & 37 AS BIGINT) AS bits FROM orders""")
def arithmetic_X4_X5_X6_X7_X8(spark, sf_dir):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    d = (k % 10).cast("double")
    return rounded(table(spark, sf_dir, "orders").select(
        "o_orderkey", F.pmod(k - 500, F.lit(7)).alias("pm"), F.floor(p / 1000).alias("fl"), F.sqrt(p).alias("sq"), F.ln(p).alias("ln_p"), F.exp(-p / 100000).alias("ex"), F.pow(d, F.lit(2.5)).alias("pw"),
        F.hypot(F.lit(3.0), d).alias("hy"), F.asin(d / 10).alias("asn"), F.degrees(F.acos(d / 10)).alias("acs"), X.clip(p, 50000.0, 90000.0).alias("clipped"),
        X.ratio(k.cast("double"), (k % 4).cast("double")).alias("safe"), F.coalesce(F.nullif(k % 3, F.lit(0)), F.lit(-1)).alias("defaulted"), k.bitwiseAND(37).alias("bits"),
    ))


@query("""SELECT p_partkey, len(list_concat([p_size], [p_size + 1, p_size + 2])) AS n, (p_size + 1)::INTEGER AS second, CAST(p_size * 3 AS BIGINT) AS tiled, p_brand || '=' || p_size AS zipped, coalesce(map {'Brand#11': 1, 'Brand#12': 2}[p_brand], -1) AS mapped FROM part""")
def collections_X11_X12_X14(spark, sf_dir):
    s = F.col("p_size")
    both = F.concat(F.array(s), F.array(s + 1, s + 2))
    pairs = F.arrays_zip(F.array("p_brand").alias("name"), F.array(s).alias("value"))
    codes = F.create_map(F.lit("Brand#11"), F.lit(1), F.lit("Brand#12"), F.lit(2))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.size(both).cast("bigint").alias("n"), F.slice(both, 2, 2)[0].alias("second"), F.aggregate(F.array_repeat(s, 3), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("tiled"),
        F.concat(pairs[0]["name"], F.lit("="), pairs[0]["value"].cast("string")).alias("zipped"), F.coalesce(F.try_element_at(codes, F.col("p_brand")), F.lit(-1)).alias("mapped"),
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code, try_cast(CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS VARCHAR) || '.5' END AS DOUBLE) AS number FROM orders")
def stamps_codes_X15_X16_X17(spark, sf_dir):
    """Codes come from the table of distinct classes, not from a window over all rows."""
    o = table(spark, sf_dir, "orders")
    coded = catalog.class_codes(o, "o_orderpriority", "code")
    raw = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(".5")))
    return coded.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"), "code", raw.try_cast("double").alias("number"))


# -- domain and plans --------------------------------------------------------


@query(f"""WITH {_UNIT}, {_BOX.format(src='u')}, s AS (SELECT tic_id, min(t) AS start, max(t) - min(t) AS baseline, stddev_pop(flux) AS sd FROM u GROUP BY tic_id)
SELECT tic_id, round(period, 6) AS period, round(depth, 6) AS depth, round(depth * 1e6, 1) AS depth_ppm, round(period / 20 * 24, 6) AS duration_hr, CAST(floor(baseline / period) AS BIGINT) AS transit_count, round(sde, 6) AS sde,
round(depth / nullif(sd, 0) * sqrt(n_in), 6) AS snr, round(start + (bin + 0.5::DOUBLE) / 20 * period, 6) AS t0, CASE WHEN depth >= 0 THEN round(sqrt(depth), 6) END AS rp_rs, 0.05::DOUBLE AS phase_coverage FROM box JOIN s USING (tic_id)""")
def geometry_T10(spark, sf_dir):
    g = search.geometry(series.normalised(light_curves(spark, sf_dir)), **search.SQL_GRID)
    return rounded(g.withColumn("depth_ppm", F.round("depth_ppm", 1)))


@query(f"""WITH {_UNIT}, a AS (SELECT event_id, flux, 2 * pi() * (t - t0) / period AS angle FROM u), d AS (SELECT *, CASE WHEN cos(angle) > 0 THEN sqrt((8.0::DOUBLE * sin(angle)) ** 2 + (0.2::DOUBLE * cos(angle)) ** 2) ELSE 9 END AS d FROM a),
  g AS (SELECT sqrt((i + 0.5::DOUBLE) / 300) AS r, 1 - sqrt(1 - (i + 0.5::DOUBLE) / 300) AS dark FROM range(300) x(i)), l AS (SELECT r, 1 - 0.3::DOUBLE * dark - 0.1::DOUBLE * dark * dark AS light FROM g),
  m AS (SELECT event_id, 1 - sum(acos(greatest(-1, least(1, CASE WHEN d > 0 THEN (d * d + r * r - 0.01::DOUBLE) / (2 * d * r) WHEN r < 0.1::DOUBLE THEN -1 ELSE 1 END))) / pi() * light) / sum(light) AS model FROM d CROSS JOIN l WHERE d < 1.1::DOUBLE GROUP BY event_id),
  f AS (SELECT event_id, flux, coalesce(model, 1) AS model, (flux - coalesce(model, 1)) / 0.5::DOUBLE AS res FROM d LEFT JOIN m USING (event_id))
SELECT event_id, round(model, 6) AS model, round(res, 6) AS residual, round(-0.5::DOUBLE * res * res - ln(0.5::DOUBLE), 6) AS log_like FROM f""")
def model_residual_T20_T24(spark, sf_dir):
    """Model flux, residual and log-likelihood terms of every row; the tests hold the model against closed forms."""
    lc = unit_curves(spark, sf_dir).withColumn("rp_rs", F.lit(0.1)).withColumn("a_rs", F.lit(8.0)).withColumn("b", F.lit(0.2)).withColumn("sigma", F.lit(0.5))
    return rounded(fitting.residuals(lc).select("event_id", "model", "residual", "log_like"))


@query("""SELECT c_custkey::VARCHAR AS tic_id, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS synthetic, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 3 END AS label, CASE WHEN c_custkey % 4 <> 0 THEN round(c_acctbal, 6) END AS balance FROM customer WHERE c_custkey % 7 <> 0""")
def assembly_M1(spark, sf_dir):
    """Training rows: done, labelled; features without keys, infinities as null."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.cast("string").alias("tic_id"), F.when(k % 7 == 0, -1).when(k % 3 == 0, 0).otherwise(3).alias("label"), F.lit("done").alias("status"), F.when(k % 4 == 0, float("inf")).otherwise(F.col("c_acctbal")).alias("balance"), (k % 5 == 0).cast("int").alias("synthetic"))
    rows, names = plans.assembled(c)
    return rounded(rows.select("tic_id", "label", *names))


@query("""WITH k AS (SELECT o_orderkey AS k FROM orders) SELECT CAST(k AS VARCHAR) AS tic_id, 'done' AS status, round(k % 9 * 0.1::DOUBLE, 6) AS rp_rs, round(k % 9 * 0.1::DOUBLE + 0.01::DOUBLE, 6) AS hi FROM k WHERE k % 6 <> 0""")
def catalog_rows_R4_R6(spark, sf_dir):
    """Nested fit results flattened; failed targets keep a status and go at the end."""
    k = F.col("o_orderkey")
    value = F.struct((k % 9 * 0.1).alias("med"), (k % 9 * 0.1 + 0.01).alias("hi"))
    fits = table(spark, sf_dir, "orders").select(k.cast("string").alias("tic_id"), F.when(k % 6 == 0, "failed").otherwise("done").alias("status"), F.when(k % 6 != 0, F.struct(value.alias("rp_rs"))).alias("fit"))
    return rounded(fits.where("status = 'done'").select("tic_id", "status", F.col("fit.rp_rs.med").alias("rp_rs"), F.col("fit.rp_rs.hi").alias("hi")))


@query("SELECT event_type, count(*) AS n, count(*) >= 50 AS retrain FROM events GROUP BY event_type")
def label_trigger_R8(spark, sf_dir):
    """Labels counted by a stream; a class with 50 of them calls for new training."""
    counts = event_stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    return run_available(counts, "labels").withColumn("retrain", F.col("n") >= 50)
