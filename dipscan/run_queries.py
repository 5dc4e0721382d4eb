"""Registered queries over whole runs: searches over each star's own periods, fits that go
on, training runs, cached tables, the series behind plots, and streams that resume.

Each stands beside its DuckDB SQL where SQL can express it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import functions as X
from . import plans, sinks, sources
from .operators import batches, fitting, neighbours, ordered, plots, posterior, search, series, templates
from .plans import boosting
from .oracles import _LC, _PHI, _TOI, _UNIT
from .queries import _text_features, curves, rounded, unit_curves
from .shared import shared_folder
from .sources import light_curves, table, toi_catalogue
from .streaming import retraining
from .streaming import event_stream, first_of_each, run_available

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- search over each star's own periods --------------------------------------

GATES = {"min_raw": 40, "min_binned": 30}  # for curves of about 67 rows
BINS, WIDTHS = 20, (1, 2, 3)


@query(f"""WITH {_UNIT}, a AS (SELECT tic_id, t, flux, count(*) OVER (PARTITION BY tic_id) AS c, min(t) OVER (PARTITION BY tic_id) AS first FROM u WHERE t IS NOT NULL AND flux IS NOT NULL),
  b AS (SELECT tic_id, avg(t) AS t, avg(flux) AS flux FROM a WHERE c >= 40 GROUP BY tic_id, floor((t - first) / (10 / 1440.0::DOUBLE)) QUALIFY count(*) OVER (PARTITION BY tic_id) >= 30),
  w AS (SELECT tic_id, min(t) AS start, max(t) - min(t) AS base, count(*) AS n, avg(flux) AS mean, var_pop(flux) AS var FROM b GROUP BY tic_id),
  h AS (SELECT *, least(27.0::DOUBLE, base / 2) AS high FROM w), m AS (SELECT *, CAST(ceil((1 / 0.5::DOUBLE - 1 / high) * base * 3 / (1 / 20.0::DOUBLE)) AS BIGINT) + 1 AS trials FROM h WHERE high >= 0.5),
  g AS (SELECT tic_id, unnest(range(trials)) AS i, trials, high FROM m), p AS (SELECT tic_id, i, 1 / (1 / 0.5::DOUBLE - i * ((1 / 0.5::DOUBLE - 1 / high) / greatest(1, trials - 1))) AS period FROM g),
  x AS (SELECT tic_id, i, period, flux - mean AS dev, (t - start) / period AS x FROM p JOIN b USING (tic_id) JOIN m USING (tic_id)),
  c AS (SELECT tic_id, i, period, least(CAST(floor((x - floor(x)) * 20) AS INTEGER), 19) AS bin, sum(dev) AS s, count(*) AS r FROM x GROUP BY ALL),
  o AS (SELECT tic_id, i, period, v.w, (bin - v.d + 20) % 20 AS bin, sum(s) AS s, sum(r) AS r FROM c CROSS JOIN (VALUES (1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)) v(w, d) GROUP BY ALL),
  e AS (SELECT o.*, n, CASE WHEN s < 0 AND r < n THEN round(s * s / (r * (n - r)), 9) ELSE 0 END AS sr FROM o JOIN m USING (tic_id)),
  q AS (SELECT tic_id, i, max(sr) AS sr FROM e GROUP BY ALL), z AS (SELECT tic_id, avg(sr) AS mean_sr, stddev_pop(sr) AS sd FROM q GROUP BY tic_id),
  k AS (SELECT e.* FROM e WHERE sr > 0 QUALIFY row_number() OVER (PARTITION BY tic_id ORDER BY sr DESC, period, w, bin) = 1)
SELECT w.tic_id, round(k.period, 6) AS period, round(-k.s / k.r - k.s / (k.n - k.r), 6) AS depth, round(k.period / 20 * k.w * 24, 6) AS duration_hr, CAST(floor(base / k.period) AS BIGINT) AS transit_count,
  round((k.sr - mean_sr) / sd, 5) AS sde, round(start + (k.bin + k.w * 0.5) / 20 * k.period, 6) AS t0, round((-k.s / k.r - k.s / (k.n - k.r)) / sqrt(var) * sqrt(k.r), 6) AS snr, coalesce(round((k.sr - mean_sr) / sd, 5) >= 4, false) AS is_candidate
FROM w LEFT JOIN k USING (tic_id) LEFT JOIN z USING (tic_id)""")
def search_T9_T10_T11(spark, sf_dir):
    """Periods from 0.5 days to half of each curve, several dip lengths, geometry and the decision (cut 4 here, no FAP)."""
    found = search.candidates(unit_curves(spark, sf_dir), bins=BINS, widths=WIDTHS, **GATES)
    found = rounded(found.select("tic_id", "period", "depth", "duration_hr", "transit_count", F.round("sde", 5).alias("sde"), "t0", "snr"))
    return found.withColumn("is_candidate", search.is_candidate(F.col("sde"), min_sde=4.0))


BANK = templates.template_bank(20, low=0.1, high=0.2, step=1.4)


def _best_shapes(src: str, out: str) -> str:
    """The strongest shape of the bank for each star of ``src`` (tic_id, event_id, t, flux), as ``out``; the bank stands as values."""
    bank = ", ".join(f"({k}, {d}, {g}::DOUBLE)" for k, shape in enumerate(BANK[0]) for d, g in enumerate(shape) if g > 0)
    return f"""{out}a AS (SELECT tic_id, t, flux, count(*) OVER (PARTITION BY tic_id) AS c, min(t) OVER (PARTITION BY tic_id) AS first FROM {src} WHERE t IS NOT NULL AND flux IS NOT NULL),
  {out}b AS MATERIALIZED (SELECT tic_id, avg(t) AS t, avg(flux) AS flux FROM {out}a WHERE c >= 40 GROUP BY tic_id, floor((t - first) / (10 / 1440.0::DOUBLE)) QUALIFY count(*) OVER (PARTITION BY tic_id) >= 30),
  {out}w AS MATERIALIZED (SELECT tic_id, min(t) AS start, max(t) - min(t) AS base, count(*) AS n, avg(flux) AS mean, var_pop(flux) AS var FROM {out}b GROUP BY tic_id),
  {out}h AS (SELECT *, least(27.0::DOUBLE, base / 2) AS high FROM {out}w), {out}m AS (SELECT *, CAST(ceil((1 - 1 / high) * base / (1 / 20.0::DOUBLE)) AS BIGINT) + 1 AS trials FROM {out}h WHERE high >= 1),
  {out}g AS (SELECT tic_id, unnest(range(trials)) AS i, trials, high FROM {out}m), {out}p AS (SELECT tic_id, i, 1 / (1.0::DOUBLE - i * ((1.0::DOUBLE - 1 / high) / greatest(1, trials - 1))) AS period FROM {out}g),
  {out}x AS (SELECT tic_id, i, period, flux - mean AS dev, (t - start) / period AS x FROM {out}p JOIN {out}b USING (tic_id) JOIN {out}m USING (tic_id)),
  {out}c AS (SELECT tic_id, i, period, least(CAST(floor((x - floor(x)) * 20) AS INTEGER), 19) AS bin, sum(dev) AS s, count(*) AS r FROM {out}x GROUP BY ALL),
  {out}o AS (SELECT tic_id, i, period, v.k, (bin - v.d + 20) % 20 AS bin, sum(s * g) AS s, sum(r * g) AS rg, sum(r * g * g) AS rgg, sum(r) AS r FROM {out}c CROSS JOIN (VALUES {bank}) v(k, d, g) GROUP BY ALL),
  {out}e AS (SELECT o.*, n, rgg - rg * rg / n AS spread, CASE WHEN s < -1e-12 AND rgg - rg * rg / n > 1e-6 THEN round(s * s / (rgg - rg * rg / n), 9) ELSE 0 END AS power FROM {out}o o JOIN {out}m USING (tic_id)),
  {out}q AS (SELECT tic_id, i, max(power) AS power FROM {out}e GROUP BY ALL), {out}z AS (SELECT tic_id, avg(power) AS mean_power, stddev_pop(power) AS sd FROM {out}q GROUP BY tic_id),
  {out}k AS (SELECT * FROM {out}e WHERE power > 0 QUALIFY row_number() OVER (PARTITION BY tic_id ORDER BY power DESC, period, k, bin) = 1),
  {out} AS MATERIALIZED (SELECT w.tic_id, w.start, w.base, w.n, w.var, k.period, k.k, k.bin, k.power, -k.s / k.spread AS depth, k.r AS n_in, (k.power - mean_power) / nullif(sd, 0) AS sde, k.power / nullif(w.var, 0) AS strength, floor(log2(w.n)) AS nc, floor(log2(greatest(w.base, 1e-9::DOUBLE))) AS bc
    FROM {out}w w LEFT JOIN {out}k k USING (tic_id) LEFT JOIN {out}z USING (tic_id))"""


_PICK = lambda values: "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "][k + 1]"
_SHUFFLED = """r1 AS (SELECT tic_id, event_id, t, row_number() OVER (PARTITION BY tic_id ORDER BY t, event_id) AS place FROM u WHERE t IS NOT NULL AND flux IS NOT NULL),
  r2 AS (SELECT tic_id, flux, row_number() OVER (PARTITION BY tic_id ORDER BY md5('42/' || event_id), event_id) AS place FROM u WHERE t IS NOT NULL AND flux IS NOT NULL), mixed AS (SELECT tic_id, event_id, t, flux FROM r1 JOIN r2 USING (tic_id, place))"""
_LAW = """l0 AS (SELECT nc, bc, avg(strength) AS mean, stddev_samp(strength) AS sd, count(*) AS draws FROM noise WHERE strength IS NOT NULL GROUP BY ALL), l1 AS (SELECT avg(strength) AS mean, stddev_samp(strength) AS sd FROM noise WHERE strength IS NOT NULL),
  law AS (SELECT nc, bc, CASE WHEN draws < 30 THEN l1.mean ELSE l0.mean END AS mean, CASE WHEN draws < 30 THEN l1.sd ELSE l0.sd END * sqrt(6) / pi() AS scale FROM l0, l1)"""


@query(f"""WITH {_UNIT}, {_best_shapes('u', 'best')}, {_SHUFFLED}, {_best_shapes('mixed', 'noise')}, {_LAW},
  f AS (SELECT best.*, 1 - exp(-exp(-(strength - (mean - scale * 0.5772156649015329::DOUBLE)) / nullif(scale, 0))) AS fap FROM best LEFT JOIN law USING (nc, bc))
SELECT tic_id, 'done' AS status, round(period, 6) AS period, round(depth, 6) AS depth, round(period * {_PICK(BANK[1])} * 24, 6) AS duration_hr, CAST(floor(base / period) AS BIGINT) AS transit_count, round(sde, 5) AS sde, round(depth / sqrt(var) * sqrt(n_in), 5) AS snr,
  round(fap, 5) AS fap, round(start + (bin + {_PICK(BANK[2])} / 2) / 20 * period, 6) AS t0, round(CASE WHEN depth >= 0 THEN sqrt(depth / {templates.CENTRAL!r}::DOUBLE) END, 6) AS rp_rs, round({_PICK(BANK[1])}, 6) AS phase_coverage, coalesce(round(sde, 5) >= 3.5 AND (fap IS NULL OR round(fap, 5) < 0.2), false) AS is_candidate FROM f""")
def template_candidates_T9_T10_T11(spark, sf_dir):
    """Limb-darkened dips of three lengths over each star's own periods; the chance of a false alarm comes from permuted curves and decides (cuts scaled: sde 3.5, fap 0.2)."""
    found = templates.template_candidates(unit_curves(spark, sf_dir), bank=BANK, low=1.0, oversampling=1, min_raw=40, min_binned=30)
    found = found.drop("depth_ppm", "is_candidate").withColumns({"sde": F.round("sde", 5), "fap": F.round("fap", 5), "snr": F.round("snr", 5)})
    return rounded(found).withColumn("is_candidate", search.is_candidate(F.col("sde"), F.col("fap"), 3.5, 0.2))


_POWERS = f"""WITH {_UNIT}, d AS (SELECT tic_id, t, flux - avg(flux) OVER (PARTITION BY tic_id) AS dev, count(flux) OVER (PARTITION BY tic_id) AS n, min(t) OVER (PARTITION BY tic_id) AS start FROM u),
  g AS (SELECT 1.0::DOUBLE + i * ((10.0::DOUBLE - 1.0) / 40) AS period FROM range(40) r(i)), x AS (SELECT tic_id, period, n, dev, (t - start) / period AS x FROM d CROSS JOIN g),
  c AS (SELECT tic_id, period, n, floor((x - floor(x)) * 20) AS bin, sum(dev) AS s, count(*) AS r FROM x GROUP BY ALL),
  p AS (SELECT tic_id, period, max(CASE WHEN s < 0 AND r < n THEN round(s * s / (r * (n - r)), 9) ELSE 0 END) AS sr FROM c GROUP BY tic_id, period),
  b AS (SELECT tic_id, period AS top FROM p QUALIFY row_number() OVER (PARTITION BY tic_id ORDER BY sr DESC, period) = 1)"""


@query(f"""{_POWERS} SELECT tic_id, round(period, 6) AS period, round(sr, 6) AS sr, period = top AS best, abs(period / top / 0.5 - 1) < 0.05::DOUBLE AS half, abs(period / top / 2 - 1) < 0.05::DOUBLE AS "double" FROM p JOIN b USING (tic_id)""")
def periodogram_S18_K8(spark, sf_dir):
    """Powers on a grid, written once and read from the cache by the second call, with the marks of the plot."""
    folder = shared_folder(spark, "powers")
    compute = lambda: search.powers(series.normalised(light_curves(spark, sf_dir)), 1.0, 10.0, 40)
    plans.cached(spark, folder, compute)
    return rounded(plots.periodogram(plans.cached(spark, folder, compute), 0.05))


# -- the series behind plots --------------------------------------------------


@query(f"WITH {_UNIT}, h AS (SELECT *, ((t - t0 + period / 2) - floor((t - t0 + period / 2) / period) * period - period / 2) * 24 AS hours FROM u) SELECT tic_id, event_id, CAST(round_even((t - t0) / period, 0) AS BIGINT) % 2 AS parity, round(hours, 5) AS hours, round(flux, 5) AS flux FROM h WHERE abs(hours) < dur * 24")
def plot_odd_even_K8(spark, sf_dir):
    p = plots.parity_points(unit_curves(spark, sf_dir))
    return rounded(p.withColumn("parity", F.col("parity").cast("bigint")), 5)


@query(f"WITH {_PHI}, s AS (SELECT *, floor((phi - floor(phi) - 0.25) / (0.5::DOUBLE / 10)) AS bin FROM f) SELECT tic_id, CAST(bin AS INTEGER) AS bin, round(avg(flux), 6) AS flux, count(flux) AS n FROM s WHERE bin BETWEEN 0 AND 9 AND phi - floor(phi) < 0.75 GROUP BY ALL")
def plot_secondary_K8(spark, sf_dir):
    return rounded(plots.secondary_bins(unit_curves(spark, sf_dir), 10))


@query(f"WITH {_PHI}, s AS (SELECT *, floor((phi + 0.5::DOUBLE) / (1.0::DOUBLE / 10)) AS bin FROM f WHERE phi < 0.5) SELECT tic_id, CAST(bin AS INTEGER) AS bin, round(median(c1), 6) AS c1, round(median(c2), 6) AS c2, count(*) AS n FROM s GROUP BY ALL")
def plot_centroid_K8(spark, sf_dir):
    return rounded(plots.centroid_bins(unit_curves(spark, sf_dir), 10))


@query("""WITH s AS (SELECT l_suppkey, l_quantity::DOUBLE AS x, l_discount::DOUBLE AS y FROM lineitem), r AS (SELECT l_suppkey, min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh FROM s GROUP BY l_suppkey)
SELECT l_suppkey, coalesce(least(floor((x - xl) / nullif(xh - xl, 0) * 5), 4), 0)::INTEGER AS i, coalesce(least(floor((y - yl) / nullif(yh - yl, 0) * 5), 4), 0)::INTEGER AS j, count(*) AS n FROM s JOIN r USING (l_suppkey) GROUP BY ALL""")
def plot_corner_K8(spark, sf_dir):
    samples = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("double").alias("x"), F.col("l_discount").cast("double").alias("y"))
    return plots.corner_bins(samples, ["l_suppkey"], "x", "y", 5)


_BAND_HOURS = (-6.0, -4.0, -3.0, -2.0, -1.0, 0.0, 1.5, 3.5, 5.0)


@query(f"""WITH p AS (SELECT l_suppkey, row_number() OVER () AS k, (l_linenumber - 4) / 100.0::DOUBLE AS tc, 0.05::DOUBLE + l_discount::DOUBLE AS rp, least(0.9, l_tax::DOUBLE * 10) AS b FROM lineitem),
  d AS (SELECT l_suppkey, k, h, rp, 2 * pi() * (h / 24 - tc) / 5 AS angle, b FROM p, unnest({list(_BAND_HOURS)!r}::DOUBLE[]) t(h)), z AS (SELECT *, CASE WHEN cos(angle) > 0 THEN sqrt((8 * sin(angle)) ** 2 + (b * cos(angle)) ** 2) ELSE 9 END AS z FROM d),
  g AS (SELECT sqrt((i + 0.5::DOUBLE) / 40) AS r, 1 - sqrt(1 - (i + 0.5::DOUBLE) / 40) AS dark FROM range(40) x(i)), l AS (SELECT r, 1 - 0.3::DOUBLE * dark - 0.1::DOUBLE * dark * dark AS light FROM g),
  m AS (SELECT k, h, 1 - sum(acos(greatest(-1, least(1, CASE WHEN z > 0 THEN (z * z + r * r - rp * rp) / (2 * z * r) WHEN r < rp THEN -1 ELSE 1 END))) / pi() * light) / sum(light) AS flux FROM z CROSS JOIN l WHERE z < 1 + rp GROUP BY k, h),
  f AS (SELECT l_suppkey, d.h, round(coalesce(flux, 1), 9) AS flux FROM d LEFT JOIN m ON m.k = d.k AND m.h = d.h),
  q AS (SELECT l_suppkey, h, quantile_disc(flux, {list(posterior.LIMITS)!r}) AS q FROM f GROUP BY ALL)
SELECT CAST(l_suppkey AS VARCHAR) AS tic_id, h AS hours, {", ".join(f"round(q[{k + 1}], 6) AS q{k}" for k in range(5))} FROM q""")
def model_band_R7(spark, sf_dir):
    """Bands of the model over draws of mid-time, radius and impact parameter, one set for each supplier."""
    x = lambda c: F.col(c).cast("double")
    draws = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("tic_id"), ((F.col("l_linenumber") - 4) / 100.0).alias("tc"), (0.05 + x("l_discount")).alias("rp_rs"), F.least(F.lit(0.9), x("l_tax") * 10).alias("b"),
        F.log(F.lit(8.0)).alias("ln_a"), F.lit(5.0).alias("period"), F.lit(0.0).alias("t0"),
    )
    return rounded(posterior.model_band(draws, _BAND_HOURS, rings=40))


@query(f"""WITH {_UNIT}, a AS (SELECT tic_id, event_id, flux, 2 * pi() * (t - t0) / period AS angle, ((t - t0 + period / 2) - floor((t - t0 + period / 2) / period) * period - period / 2) * 24 AS hours FROM u), d AS (SELECT *, CASE WHEN cos(angle) > 0 THEN sqrt((8.0::DOUBLE * sin(angle)) ** 2 + (0.2::DOUBLE * cos(angle)) ** 2) ELSE 9 END AS d FROM a),
  g AS (SELECT sqrt((i + 0.5::DOUBLE) / 300) AS r, 1 - sqrt(1 - (i + 0.5::DOUBLE) / 300) AS dark FROM range(300) x(i)), l AS (SELECT r, 1 - 0.3::DOUBLE * dark - 0.1::DOUBLE * dark * dark AS light FROM g),
  m AS (SELECT event_id, 1 - sum(acos(greatest(-1, least(1, CASE WHEN d > 0 THEN (d * d + r * r - 0.01::DOUBLE) / (2 * d * r) WHEN r < 0.1::DOUBLE THEN -1 ELSE 1 END))) / pi() * light) / sum(light) AS model FROM d CROSS JOIN l WHERE d < 1.1::DOUBLE GROUP BY event_id),
  f AS (SELECT tic_id, floor((hours + 24) / (48.0::DOUBLE / 8)) AS bin, (flux - coalesce(model, 1)) / 0.5::DOUBLE AS res FROM d LEFT JOIN m USING (event_id) WHERE hours < 24)
SELECT tic_id, CAST(bin AS INTEGER) AS bin, round(avg(res), 6) AS residual, count(*) AS n FROM f WHERE bin BETWEEN 0 AND 7 AND res IS NOT NULL GROUP BY ALL""")
def plot_residuals_R7(spark, sf_dir):
    lc = unit_curves(spark, sf_dir).withColumns({"rp_rs": F.lit(0.1), "a_rs": F.lit(8.0), "b": F.lit(0.2), "sigma": F.lit(0.5)})
    return rounded(posterior.residual_bins(lc, 24.0, 8))


@query("""WITH c AS (SELECT l_suppkey AS k, l_linenumber % 4 AS chain, row_number() OVER (PARTITION BY l_suppkey, l_linenumber % 4 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS step, l_extendedprice::DOUBLE / 1000 AS x FROM lineitem),
  m AS (SELECT k, chain, (min(step) + max(step)) / 2 AS middle FROM c GROUP BY ALL), h AS (SELECT k, chain, step >= middle AS late, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM c JOIN m USING (k, chain) GROUP BY ALL),
  r AS (SELECT k, count(DISTINCT chain) AS chains, avg(n) AS n, min(n) AS least, avg(v) AS w, var_samp(m) AS b FROM h GROUP BY k), a AS (SELECT k, count(*) AS draws, avg(x) AS mean, stddev_pop(x) AS sd FROM c GROUP BY k),
  b AS (SELECT k, chain, step // 10 AS j, avg(x) AS m, sum(x) AS s, sum(x * x) AS q FROM c GROUP BY ALL HAVING count(*) = 10), e AS (SELECT k, 10 * count(*) AS d, sum(q) / (10 * count(*)) - (sum(s) / (10 * count(*))) ** 2 AS v, var_samp(m) AS bv FROM b GROUP BY k)
SELECT a.k AS tic_id, chains, draws, round(mean, 5) AS mean, round(sd, 5) AS sd, CASE WHEN least > 1 AND w > 0 THEN round(sqrt(((n - 1) / n * w + b) / w), 5) END AS rhat, round(least(d, d * v / (10 * nullif(bv, 0))), 4) AS ess FROM a JOIN r USING (k) LEFT JOIN e USING (k)""")
def chain_diagnostics_A26(spark, sf_dir):
    """Split R-hat and batch-means effective size over four chains of prices for each supplier."""
    w = Window.partitionBy("l_suppkey", F.col("l_linenumber") % 4).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    chains = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tic_id"), (F.col("l_linenumber") % 4).alias("chain"), (F.row_number().over(w) - 1).alias("step"), (F.col("l_extendedprice").cast("double") / 1000).alias("x"))
    found = posterior.split_rhat(chains, ["tic_id"], "chain", "step", "x").join(posterior.batch_effective_size(chains, ["tic_id"], "chain", "step", "x", 10), "tic_id", "left")
    return rounded(found.withColumn("ess", F.round("ess", 4)), 5)


@query(f"WITH {_TOI} SELECT label, count(*) AS n, count(DISTINCT tic_id) AS stars FROM toi GROUP BY label")
def kpi_classes_R9(spark, sf_dir):
    rows = toi_catalogue(spark, sf_dir).withColumn("label", X.disposition_label(F.col("disposition")))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("tic_id").alias("stars"))


# -- files ---------------------------------------------------------------------


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("tic_id"), "o_orderkey", place.alias("tce"))
    k = F.col("o_orderkey")
    return o.select("tic_id", "tce", (1 + k % 20).cast("double").alias("period"), F.when(k % 3 != 0, (k % 700) / 8.0).alias("epoch"), (k % 5000).cast("double").alias("depth"), ((k % 40) / 4.0).alias("duration"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS tic_id, 'TCE_' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS tce_ext, (1 + o_orderkey % 20)::DOUBLE AS period,
CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 700) / 8.0::DOUBLE END AS epoch_btjd, (o_orderkey % 5000)::DOUBLE AS depth_ppm, (o_orderkey % 40) / 4.0::DOUBLE AS duration_hr FROM orders""")
def fits_headers_S8_S9(spark, sf_dir):
    """Headers of files in folders below one, a row for each extension."""
    folder = shared_folder(spark, "signals")
    sinks.write_signals(_signals(spark, sf_dir), folder).write.format("noop").mode("overwrite").save()
    return sources.scan_fits(spark, folder).drop("path")


@query(f"""WITH {_LC}, g AS (SELECT *, coalesce(t - lag(t) OVER w > 2.0::DOUBLE, false) AS cut FROM lc WHERE flux IS NOT NULL AND event_id % 5 <> 0 WINDOW w AS (PARTITION BY tic_id ORDER BY t, event_id)),
  s AS (SELECT *, sum(cut::INTEGER) OVER (PARTITION BY tic_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM g), n AS (SELECT tic_id, seg, count(*) AS n, sum(flux) AS f, sum(c1) AS c1, sum(c2) AS c2, sum(quality) AS q, min(t) AS a, max(t) AS b FROM s GROUP BY ALL)
SELECT tic_id, n, round(a, 5) AS first, round(b, 5) AS last, round(f, 3) AS flux, round(c1, 3) AS c1, round(c2, 3) AS c2, q::BIGINT AS quality FROM n QUALIFY row_number() OVER (PARTITION BY tic_id ORDER BY n DESC, seg) = 1""")
def segment_S14(spark, sf_dir):
    """Array files to the longest segment of each star, six columns in step."""
    folder = shared_folder(spark, "segments")
    lc = light_curves(spark, sf_dir).withColumn("flux", F.when(F.col("event_id") % 5 != 0, F.col("flux")))
    sinks.write_arrays(lc, folder).write.format("noop").mode("overwrite").save()
    seg = sources.scan_segments(spark, folder, gap=2.0)
    return rounded(seg.groupBy("tic_id").agg(F.count("*").alias("n"), F.round(F.min("t"), 5).alias("first"), F.round(F.max("t"), 5).alias("last"), *[F.round(F.sum(c), 3).alias(c) for c in ("flux", "c1", "c2")], F.sum("quality").alias("quality")))


@query(f"WITH {_UNIT} SELECT 'SYN_' || tic_id AS tic_id, count(*) AS n, true AS sound FROM u GROUP BY tic_id")
def injected_ranges_T19(spark, sf_dir):
    """Rows of every injected curve, and whether what was injected lies in the ranges it is drawn from."""
    lc = unit_curves(spark, sf_dir)
    made = fitting.injected(lc).groupBy("tic_id").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b"), *[F.first(c).alias(c) for c in ("inj_period", "inj_rp", "inj_t0", "inj_depth_ppm")], F.count_distinct("inj_period", "inj_rp", "inj_t0").alias("draws"))
    high = F.greatest(F.lit(1.1), F.least(F.lit(30.0), (F.col("b") - F.col("a")) / 3))
    sound = (F.col("draws") == 1) & F.col("inj_period").between(1, high) & F.col("inj_rp").between(0.01, 0.15) & (F.col("inj_t0") >= F.col("a")) & (F.col("inj_t0") <= F.col("a") + F.col("inj_period")) & (F.col("inj_depth_ppm") >= 0)
    return made.select("tic_id", "n", sound.alias("sound"))


# -- runs that go on -------------------------------------------------------------


@query(f"""WITH {_UNIT}, a AS (SELECT tic_id, flux, abs((t - t0 + period / 2) - floor((t - t0 + period / 2) / period) * period - period / 2) AS away, dur FROM u)
SELECT tic_id, 1::BIGINT AS fits, count(*) FILTER (away < greatest(3 * dur, 0.05::DOUBLE) AND flux IS NOT NULL) AS n_points FROM a GROUP BY tic_id""")
def resumed_fits_R10(spark, sf_dir):
    """A run over half of the stars, then one over all: each star is fitted once."""
    folder = shared_folder(spark, "fits")
    lc = unit_curves(spark, sf_dir).withColumn("ln_a", F.lit(2.0))
    fitting.fit_pending(lc.where(F.col("tic_id").cast("bigint") % 2 == 0), folder, units=4, min_points=10)
    fits = fitting.fit_pending(lc, folder, units=4, min_points=10)
    return fits.groupBy("tic_id").agg(F.count("*").alias("fits"), F.sum("n_points").alias("n_points"))


@query(f"""WITH {_UNIT}, a AS (SELECT tic_id, CAST(tic_id AS BIGINT) % 6 AS k, count(flux) AS n, count(*) FILTER (abs((t - t0 + period / 2) - floor((t - t0 + period / 2) / period) * period - period / 2) < greatest(3 * dur, 0.05::DOUBLE) AND flux IS NOT NULL) AS near FROM u GROUP BY tic_id),
  s AS (SELECT tic_id, k, n, near, CASE WHEN k = 0 THEN 'failed: ValueError' WHEN k = 1 THEN 'too few points' ELSE 'done' END AS kind FROM a)
SELECT tic_id, kind, CASE k WHEN 1 THEN 0 WHEN 0 THEN NULL ELSE near END AS n_points, count(*) OVER (PARTITION BY kind) AS stars FROM s""")
def isolated_fits_R6(spark, sf_dir):
    """A batch in which the fits of one star in six break down and one in six has no flux: status, points used, and the tally of its kind."""
    k = F.col("tic_id").cast("bigint") % 6
    lc = unit_curves(spark, sf_dir).withColumn("ln_a", F.lit(2.0)).withColumn("dur", F.when(k == 0, float("nan")).otherwise(F.col("dur"))).withColumn("flux", F.when(k != 1, F.col("flux")))
    done, failed = batches.settled(fitting.fitted(lc, min_points=10), name="fits")
    kinds = batches.status_tally(done, failed)
    rows = done.select("tic_id", F.col("status").alias("kind"), "n_points").unionByName(failed.select("tic_id", F.regexp_extract("status", r"^(failed: \w+)", 1).alias("kind"), F.lit(None).cast("int").alias("n_points")))
    return rows.join(kinds.withColumnRenamed("status", "kind"), "kind")


@query(f"""WITH {_UNIT}, n AS (SELECT tic_id, CAST(tic_id AS BIGINT) % 5 = 0 AS broken, count(*) AS c FROM u GROUP BY tic_id)
SELECT tic_id, CASE WHEN broken THEN 'failed: ValueError' ELSE 'done' END AS kind, count(*) OVER (PARTITION BY broken) AS stars FROM n""")
def isolated_searches_R6(spark, sf_dir):
    """A search over curves of which one in five is infinite."""
    lc = unit_curves(spark, sf_dir).withColumn("flux", F.when(F.col("tic_id").cast("bigint") % 5 == 0, float("inf")).otherwise(F.col("flux")))
    done, failed = batches.settled(search.period_search(lc, bins=20, widths=(1,), oversampling=1, low=2.0, isolate=True), name="searches")
    kinds = batches.status_tally(done, failed).withColumnRenamed("status", "kind")
    rows = done.select("tic_id", F.col("status").alias("kind")).unionByName(failed.select("tic_id", F.regexp_extract("status", r"^(failed: \w+)", 1).alias("kind")))
    return rows.join(kinds, "kind")


@query(f"""WITH {_UNIT}, s AS (SELECT DISTINCT tic_id, CAST(tic_id AS BIGINT) AS k FROM u), n AS (SELECT tic_id, count(*) AS n FROM u WHERE flux IS NOT NULL GROUP BY tic_id)
SELECT tic_id, 'done' AS status, round(0.08::DOUBLE + k % 5 * 0.02::DOUBLE, 2) AS rp_rs, 0.0::DOUBLE AS shift, 0.0::DOUBLE AS "left" FROM s JOIN n USING (tic_id)""")
def noise_free_fits_T25(spark, sf_dir):
    """Fits of curves that are the model itself: the planted radius and mid-time come back, and nothing is left over."""
    k = F.col("tic_id").cast("bigint")
    lc = unit_curves(spark, sf_dir).withColumns({"rp_rs": 0.08 + k % 5 * 0.02, "a_rs": F.lit(4.0), "b": F.lit(0.3), "sigma": F.lit(1.0)})
    exact = fitting.residuals(lc, rings=100).select("event_id", F.col("model").alias("flux"))
    rows = lc.drop("flux").join(exact, "event_id").withColumn("ln_a", F.log(F.lit(4.0)))
    t0 = rows.groupBy("tic_id").agg(F.min("t0").alias("t0"))
    found = fitting.fitted(rows, min_points=10).join(t0, "tic_id")
    return found.select("tic_id", "status", F.round("rp_rs", 2).alias("rp_rs"), F.abs(F.round(F.col("tc") - F.col("t0"), 1)).alias("shift"), F.round(F.sqrt("chi2_red") * F.col("sigma_ppm") / 1e6, 3).alias("left"))


@query("""WITH d AS (SELECT d.doc_id, d.source || '/' || (d.doc_id % 5) AS grp, l.quality AS label FROM documents d JOIN labels l USING (doc_id)), g AS (SELECT grp, max(label) AS label FROM d GROUP BY grp),
  r AS (SELECT grp, row_number() OVER (PARTITION BY label ORDER BY md5(grp || '42'), grp) AS rn, count(*) OVER (PARTITION BY label) AS n FROM g), p AS (SELECT grp, rn <= greatest(1, round_even(n * 0.25::DOUBLE, 0)) AS held FROM r)
SELECT count(*) FILTER (NOT held) AS n_train, count(DISTINCT grp) FILTER (NOT held) AS train_groups, count(*) FILTER (held) AS n_test, sum(label) FILTER (held)::BIGINT AS n_positive, 3 AS features, count(DISTINCT label)::INTEGER AS classes, true AS sound FROM d JOIN p USING (grp)""")
def train_run_M11(spark, sf_dir):
    """Model and metrics of a whole run; its counts, and whether every metric lies where it can."""
    docs, columns = _text_rows(spark, sf_dir)
    m = plans.train_run(docs, columns, shared_folder(spark, "run"), trees=5)
    sound = F.lit(True)
    for c in ("accuracy", "macro_f1", "auc", "ap", "brier"):
        sound = sound & F.coalesce(F.col(c).between(0, 1), F.lit(True))
    return m.select("n_train", "train_groups", "n_test", "n_positive", "features", "classes", sound.alias("sound"))


@query("""WITH d AS (SELECT l.quality AS label FROM documents d JOIN labels l USING (doc_id)), n AS (SELECT label, count(*) AS n FROM d GROUP BY label)
SELECT label, max(n) OVER () AS rows, max(n) OVER () - n AS synthetic FROM n""")
def oversampled_M5(spark, sf_dir):
    """Both classes of the labelled documents, the smaller one filled up between neighbours."""
    docs, columns = _text_rows(spark, sf_dir)
    made = plans.oversampled(docs, columns)
    return made.groupBy("label").agg(F.count("*").alias("rows"), F.count_if("synthetic").alias("synthetic"))


def _text_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    train, test, columns = _text_features(spark, sf_dir)
    return train.unionByName(test), columns


_STUMP = ("total", "month", "weekday", "priority")


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, [floor(o_totalprice / 20000)::DOUBLE, month(o_orderdate)::DOUBLE, dayofweek(o_orderdate) + 1.0::DOUBLE, substr(o_orderpriority, 1, 1)::DOUBLE] AS x FROM orders),
  p AS (SELECT avg(y) AS p, count(*) AS n, avg(y) * (1 - avg(y)) AS h FROM o), u AS (SELECT o_orderkey, y, j, x[j + 1] AS v FROM o, range(4) t(j)),
  b AS (SELECT j, v, sum(p - y) AS g, count(*) AS c FROM u, p GROUP BY j, v), s AS (SELECT j, v, sum(g) OVER w AS gl, sum(c) OVER w AS nl FROM b WINDOW w AS (PARTITION BY j ORDER BY v)),
  k AS (SELECT j, v, nl, gl, (SELECT sum(g) FROM b WHERE j = 0) AS ga FROM s),
  e AS (SELECT j, v, gl, nl, ga, n, h, round(gl ** 2 / (nl * h + 1) + (ga - gl) ** 2 / ((n - nl) * h + 1) - ga ** 2 / (n * h + 1), 7) AS gain FROM k, p WHERE nl >= 20 AND n - nl >= 20),
  t AS (SELECT * FROM e ORDER BY gain DESC, j, v LIMIT 1), l AS (SELECT j, v AS cut, -gl / (nl * h + 1) AS below, -(ga - gl) / ((n - nl) * h + 1) AS above, nl / n AS share FROM t),
  f AS (SELECT o_orderkey, j, CASE WHEN x[j + 1] <= cut THEN below ELSE above END AS v, share * below + (1 - share) * above AS mean FROM o, l)
SELECT o_orderkey, round(ln(p / (1 - p)) + 0.5 * v, 5) AS margin, round(ln(p / (1 - p)) + 0.5 * mean, 5) AS expected, """ + ", ".join(f"CASE WHEN j = {j} THEN round(0.5 * (v - mean), 5) ELSE 0 END AS {c}" for j, c in enumerate(_STUMP)) + " FROM f, p")
def stump_contributions_M4_M10(spark, sf_dir):
    """The first split of leaf-wise growth over all orders, and what each feature adds to every order's margin."""
    o = _order_rows(spark, sf_dir)
    model = boosting.boosted(o, list(_STUMP), trees=1, leaves=2, rate=0.5)
    rows = boosting.explained(model, o, "o_orderkey")
    return rounded(rows.select("o_orderkey", "margin", "expected", *[F.col("contributions")[j].alias(c) for j, c in enumerate(_STUMP)]), 5)


def _order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("label"), F.floor(F.col("o_totalprice") / 20000).cast("double").alias("total"),
        F.month("o_orderdate").cast("double").alias("month"), F.dayofweek("o_orderdate").cast("double").alias("weekday"), F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"),
    )


@query(f"""WITH s AS ({ORACLES["stump_contributions_M4_M10"]}), p AS (SELECT avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS p FROM orders)
SELECT count(*) AS orders, count(DISTINCT margin) AS leaves, round(min(margin), 5) AS low, round(max(margin), 5) AS high, round(avg(margin), 4) AS mean FROM s, p""")
def model_round_trip_S17_K6(spark, sf_dir):
    """Margins by a model that was written and read again; the SQL has them from the training rows."""
    o, folder = _order_rows(spark, sf_dir), shared_folder(spark, "boosted")
    boosting.save(boosting.boosted(o, list(_STUMP), trees=1, leaves=2, rate=0.5), folder, spark)
    rows = boosting.explained(boosting.load(folder, spark), o, "o_orderkey").select(F.round("margin", 5).alias("margin"))
    return rows.agg(F.count("*").alias("orders"), F.count_distinct("margin").alias("leaves"), F.min("margin").alias("low"), F.max("margin").alias("high"), F.round(F.avg("margin"), 4).alias("mean"))


@query()
def leafwise_contributions_M4_M10(spark, sf_dir):
    """Trees of up to 63 leaves with early stopping on the labelled documents; margins of the held-out ones and what they are made of."""
    train, test, columns = _text_features(spark, sf_dir)
    model = boosting.boosted(train, columns, group="grp", trees=20)
    rows = boosting.explained(model, test, "doc_id")
    return rounded(rows.select("doc_id", "margin", "expected", *[F.col("contributions")[j].alias(c) for j, c in enumerate(columns)]))


@query()
def attribution_M10_A25(spark, sf_dir):
    """Mean size of the contributions to the margins of all labelled documents, largest first."""
    docs, columns = _text_rows(spark, sf_dir)
    return rounded(boosting.attribution(boosting.boosted(docs, columns, trees=10, leaves=15), docs, "doc_id"))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup_Str5(spark, sf_dir):
    """Every event arrives twice; each is kept once."""
    twice = event_stream(spark, sf_dir).unionByName(event_stream(spark, sf_dir))
    return run_available(first_of_each(twice).select("event_id", "user_id", "event_type"), "once", "append")


@query("SELECT event_id % 3 AS part, count(*) AS n FROM events GROUP BY ALL")
def stream_resume_Str2(spark, sf_dir):
    """Files that come after the first run are all that the second one reads."""
    files, folder = shared_folder(spark, "files"), shared_folder(spark, "resumed")
    events = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 3).alias("part"))
    for some in (F.col("part") < 2, F.col("part") == 2):
        events.where(some).write.mode("append").parquet(files)
        found = run_available(spark.readStream.schema(events.schema).parquet(files), "resumed", "append", folder=folder)
    return found.groupBy("part").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT doc_id, quality AS label, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM labels), n AS (SELECT count(*) AS n FROM labels),
  b AS (SELECT doc_id, label, least(3, place * 4 // n) AS batch FROM d, n), t AS (SELECT DISTINCT batch FROM b),
  c AS (SELECT t.batch, count(*) AS labels, sum(b.label) AS ones FROM t JOIN b ON b.batch <= t.batch GROUP BY t.batch), v AS (SELECT *, labels // greatest(1, (SELECT n FROM n) // 3) AS version FROM c)
SELECT CAST(version AS INTEGER) AS version, min(batch) AS batch, min(labels) AS labels, round(min_by(ones / labels, batch), 6) AS share FROM v WHERE version > 0 GROUP BY version""")
def retrained_R8_Str6(spark, sf_dir):
    """Labels arrive in four batches; a model is trained each time that another third of them is there.  The stream is run twice, and trains nothing twice."""
    folder, files = shared_folder(spark, "retrained"), shared_folder(spark, "arriving")
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    n = rows.count()
    placed = ordered.ranked(rows, ["id"], "place").withColumn("part", F.least(F.lit(3), F.floor((F.col("place") - 1) * 4 / n))).select("id", "label", "part")

    def train(known: DataFrame, model: str) -> dict[str, float]:
        docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").cast("double").alias("chars"))
        fitted = boosting.boosted(known.join(docs, "id"), ["chars"], trees=1, leaves=4)
        spark.createDataFrame([(t.feature, t.cut, t.left, t.right, t.value) for t in fitted.trees], "feature array<int>, cut array<int>, left array<int>, right array<int>, value array<double>").write.mode("overwrite").parquet(model)
        return {"share": known.agg(F.avg("label")).first()[0]}

    for k in range(4):
        placed.where(F.col("part") == k).select("id", "label").coalesce(1).write.mode("append").parquet(files)
        found = retraining.retrained(spark.readStream.schema("id bigint, label bigint").parquet(files), folder, train, max(1, n // 3))
    return rounded(found.select("version", "batch", "labels", F.col("metrics")["share"].alias("share")))


@query("""WITH c AS (SELECT c_custkey AS id, c_acctbal::DOUBLE / 1000 AS x, c_nationkey::DOUBLE AS y FROM customer),
  d AS (SELECT a.id, b.id AS neighbour, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM c a JOIN c b ON a.id <> b.id)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS INTEGER) AS place, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) <= 3""")
def neighbours_M5(spark, sf_dir):
    """Distances of each customer's three nearest in balance and nation."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal").cast("double") / 1000).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return rounded(neighbours.nearest(rows, ["x", "y"], 3).select("id", "place", "distance"))
