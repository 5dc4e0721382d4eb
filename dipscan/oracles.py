"""DuckDB SQL for the registered queries."""

from __future__ import annotations

_LC = """lc AS (SELECT CAST(user_id AS VARCHAR) AS tic_id, event_id, epoch_us(ts) / 86400000000.0::DOUBLE AS t, value AS flux,
  CASE event_type WHEN 'click' THEN 64 WHEN 'signup' THEN 1 WHEN 'purchase' THEN 32 WHEN 'error' THEN 16 ELSE 0 END AS quality,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS c1, CAST(event_id % 97 AS DOUBLE) AS c2 FROM events)"""
_UNIT = _LC + """, u AS (SELECT tic_id, event_id, t, flux / nullif(median(flux) OVER (PARTITION BY tic_id), 0) AS flux, quality, c1, c2,
  2.0::DOUBLE + CAST(tic_id AS BIGINT) % 7 * 0.5::DOUBLE AS period, min(t) OVER (PARTITION BY tic_id) AS t0, 0.6::DOUBLE AS dur FROM lc)"""
_PHI = _UNIT + """, f0 AS (SELECT *, (t - t0) / period - floor((t - t0) / period) AS raw FROM u), f AS (SELECT *, CASE WHEN raw > 0.5 THEN raw - 1 ELSE raw END AS phi FROM f0)"""
_BIN = """floor((phi + 0.5::DOUBLE) / (1.0::DOUBLE / {n}))"""
_TOI = """toi AS (SELECT CAST(o_custkey AS VARCHAR) AS tic_id, o_orderkey AS toi, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 0 WHEN '3-MEDIUM' THEN 1 ELSE 3 END AS label FROM orders)"""
_SCORES = """s AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, round((o_orderkey % 97 + CASE WHEN o_orderstatus = 'F' THEN 20 ELSE 0 END) / 120.0::DOUBLE, 4) AS score FROM orders), p AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM s)"""
_BOX = """d AS (SELECT tic_id, t, flux - avg(flux) OVER (PARTITION BY tic_id) AS dev, count(flux) OVER (PARTITION BY tic_id) AS n, min(t) OVER (PARTITION BY tic_id) AS start FROM {src}),
  g AS (SELECT 1.0::DOUBLE + i * ((10.0::DOUBLE - 1.0) / 60) AS period FROM range(60) r(i)),
  x AS (SELECT tic_id, period, n, dev, (t - start) / period AS x FROM d CROSS JOIN g),
  c AS (SELECT tic_id, period, n, CAST(floor((x - floor(x)) * 20) AS BIGINT) AS bin, sum(dev) AS s, count(*) AS r FROM x GROUP BY ALL),
  c2 AS (SELECT *, CASE WHEN s < 0 AND r < n THEN round(s * s / (r * (n - r)), 9) ELSE 0.0 END AS sr FROM c),
  b AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY tic_id, period ORDER BY sr DESC, bin) = 1),
  m AS (SELECT tic_id, avg(sr) AS mean, stddev_pop(sr) AS sd FROM b GROUP BY tic_id),
  best AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY tic_id ORDER BY sr DESC, period, bin) = 1),
  box AS (SELECT best.tic_id, period, bin, sr, (sr - mean) / nullif(sd, 0) AS sde, -s / r - s / nullif(n - r, 0) AS depth, r AS n_in FROM best JOIN m ON best.tic_id = m.tic_id)"""
_FITS = """k AS (SELECT o_orderkey AS k FROM orders), fits AS (SELECT CAST(k AS VARCHAR) AS tic_id,
  CASE WHEN k % 11 <> 0 THEN (k % 11) * 0.5::DOUBLE END AS oes, CASE WHEN k % 7 <> 0 THEN (k % 7) * 0.05::DOUBLE END AS oef, CASE WHEN k % 13 <> 0 THEN (k % 13) * 0.4::DOUBLE END AS ses, CASE WHEN k % 5 <> 0 THEN (k % 5) * 0.04::DOUBLE END AS sef,
  CASE WHEN k % 17 <> 0 THEN (k % 17) * 0.2::DOUBLE END AS ces, CASE WHEN k % 29 <> 0 THEN (k % 29) * 0.8::DOUBLE END AS radius, CASE WHEN k % 19 <> 0 THEN (k % 19) * 1.0::DOUBLE END AS snr, CASE WHEN k % 10 <> 0 THEN (k % 10) * 0.105::DOUBLE END AS b, k % 6 <> 0 AS converged, CASE WHEN k % 9 <> 0 THEN (k % 9) * 0.1::DOUBLE END AS p FROM k),
  fl AS (SELECT *, list_filter([CASE WHEN oes > 3 AND oef > 0.10::DOUBLE THEN 'odd-even' END, CASE WHEN ses > 3 AND sef > 0.10::DOUBLE THEN 'secondary' END, CASE WHEN ces > 3 THEN 'centroid' END, CASE WHEN radius > 20 THEN 'radius' END], lambda x: x IS NOT NULL) AS hard,
  list_filter([CASE WHEN snr < 7 THEN 'low-snr' END, CASE WHEN b > 0.9::DOUBLE THEN 'grazing' END, CASE WHEN NOT converged THEN 'not-converged' END], lambda x: x IS NOT NULL) AS soft FROM fits),
  v AS (SELECT *, CASE WHEN len(hard) > 0 THEN 'FALSE-POSITIVE LIKELY' WHEN len(soft) > 0 THEN 'CAUTION' ELSE 'PASS' END AS verdict FROM fl),
  r AS (SELECT *, round(coalesce(p, 1.0::DOUBLE) * CASE verdict WHEN 'PASS' THEN 1.0::DOUBLE WHEN 'CAUTION' THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END * CASE WHEN snr IS NOT NULL THEN least(snr / 10, 1.0::DOUBLE) END, 6) AS rank_score FROM v)"""

_CLIP = _LC + "".join(f""", k{i} AS (SELECT * FROM (SELECT *, median(flux) OVER (PARTITION BY tic_id) + 1.5::DOUBLE * stddev_pop(flux) OVER (PARTITION BY tic_id) AS top{i} FROM {'lc' if i == 1 else f'k{i - 1}'}) WHERE flux <= top{i})""" for i in range(1, 6))


def _corr(lag: int) -> str:
    return f"""SELECT tic_id, (n * sxy - sx * sy) / nullif(CASE WHEN (n * sxx - sx * sx) * (n * syy - sy * sy) > 0 THEN sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) END, 0) AS ac FROM
  (SELECT tic_id, count(*) AS n, sum(flux) AS sx, sum(y) AS sy, sum(flux * y) AS sxy, sum(flux * flux) AS sxx, sum(y * y) AS syy FROM (SELECT tic_id, flux, lag(flux, {lag}) OVER (PARTITION BY tic_id ORDER BY t, event_id) AS y FROM lc) WHERE y IS NOT NULL AND flux IS NOT NULL GROUP BY tic_id)"""


ORACLES: dict[str, str] = {
    "quality_mask_F2": f"WITH {_LC} SELECT event_id, quality FROM lc WHERE quality & 543 = 0",
    "label_map_P7": f"WITH {_TOI} SELECT toi, label FROM toi",
    "norm_id_X1": """SELECT c_custkey, regexp_replace(trim(CASE c_custkey % 4 WHEN 0 THEN 'TIC ' || c_custkey WHEN 1 THEN 'TIC_' || c_custkey WHEN 2 THEN ' ' || c_custkey || '.0' ELSE 'SYN_' || c_custkey END), '^(TIC_|TIC )|\\.0$', '', 'g') AS tic_id FROM customer""",
    "priority_labels_W1": f"""WITH {_TOI}, a AS (SELECT CAST(c_custkey AS VARCHAR) AS tic_id, 0 AS label, 'nasa_confirmed' AS source, 0 AS pr FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT tic_id, label, 'exofop_toi', 1 FROM toi UNION ALL SELECT CAST(c_custkey AS VARCHAR), -1, 'spoc_tce', 2 FROM customer)
      SELECT tic_id, label, source FROM a QUALIFY row_number() OVER (PARTITION BY tic_id ORDER BY pr, label) = 1""",
    "upsert_J6": """WITH b AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, c_acctbal + 1000 AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 <> 1)
      SELECT coalesce(n.c_custkey, b.c_custkey) AS c_custkey, round(coalesce(n.c_acctbal, b.c_acctbal), 6) AS c_acctbal, n.c_mktsegment FROM b FULL JOIN n ON b.c_custkey = n.c_custkey""",
    "lookup_left_J1": f"""WITH {_TOI}, l AS (SELECT tic_id, label FROM toi QUALIFY row_number() OVER (PARTITION BY tic_id ORDER BY toi DESC) = 1) SELECT CAST(c_custkey AS VARCHAR) AS tic_id, coalesce(label, -1) AS label FROM customer LEFT JOIN l ON l.tic_id = CAST(c_custkey AS VARCHAR)""",
    "stellar_join_J2": "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey",
    "semi_J4": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "anti_resume_J5": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "host_resolve_J7": "SELECT CASE WHEN c_custkey % 5 = 0 THEN 'SYN_' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS tic_id, CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey + 1 AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END AS host FROM customer",
    "interleave_W10": "SELECT c_custkey, c_mktsegment, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(CAST(c_custkey AS VARCHAR) || '42'), c_custkey) AS INTEGER) AS rn FROM customer ORDER BY rn, c_mktsegment LIMIT 100",
    "union_by_name_U1": "SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, round(s_acctbal, 6) FROM supplier",
    "value_counts_A1": f"WITH {_LC} SELECT quality, count(*) AS n FROM lc GROUP BY quality",
    "status_tally_A2": "SELECT count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS other, count(DISTINCT o_custkey) AS stars FROM orders",
    "dedup_first_A4": "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1",
    "impute_A17": "WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END AS price FROM part) SELECT p_partkey, round(coalesce(price, (SELECT median(price) FROM p)), 6) AS price, price IS NULL AS price_imputed FROM p",
    "topk_O3": "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 20",
    "set_difference_U2": "SELECT c_custkey AS id, c_custkey IN (SELECT s_suppkey FROM supplier) AS common FROM customer",
    "json_flatten_P8": """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"event_id":' || event_id || coalesce(',"k":' || json_extract_string(props, '$.k'), '') || '}' AS json FROM events""",
    "median_norm_T4": f"WITH {_LC} SELECT event_id, round(flux / nullif(median(flux) OVER (PARTITION BY tic_id), 0), 6) AS flux FROM lc",
    "mad_A7": f"WITH {_LC}, d AS (SELECT tic_id, abs(flux - median(flux) OVER (PARTITION BY tic_id)) AS dev FROM lc) SELECT tic_id, round(median(dev) * 1.4826::DOUBLE, 6) AS sigma FROM d GROUP BY tic_id",
    "p2p_sigma_A8": f"WITH {_LC}, d AS (SELECT tic_id, flux - lag(flux) OVER (PARTITION BY tic_id ORDER BY t, event_id) AS d FROM lc), e AS (SELECT tic_id, abs(d - median(d) OVER (PARTITION BY tic_id)) AS dev FROM d WHERE d IS NOT NULL) SELECT tic_id, round(median(dev) * 1.4826::DOUBLE / sqrt(2.0::DOUBLE), 6) AS sigma FROM e GROUP BY tic_id",
    "moments_A10": f"""WITH {_LC}, m AS (SELECT *, avg(flux) OVER (PARTITION BY tic_id) AS mu FROM lc) SELECT tic_id, round(stddev_pop(flux), 6) AS std, round(avg((flux - mu) ** 3) / nullif(avg((flux - mu) ** 2) ** 1.5, 0), 6) AS skewness, round(avg((flux - mu) ** 4) / nullif(avg((flux - mu) ** 2) ** 2, 0) - 3, 6) AS kurtosis, round(avg(flux), 6) AS mean FROM m GROUP BY tic_id""",
    "percentiles_A11": f"WITH {_LC} SELECT tic_id, round(quantile_cont(flux, 0.05), 6) AS p05, round(median(flux), 6) AS p50, round(quantile_cont(flux, 0.95), 6) AS p95 FROM lc GROUP BY tic_id",
    "mean_abs_change_A13": f"WITH {_LC}, d AS (SELECT tic_id, flux, abs(flux - lag(flux) OVER (PARTITION BY tic_id ORDER BY t, event_id)) AS d FROM lc) SELECT tic_id, round(avg(d) + 1e-9::DOUBLE, 4) AS mean_abs_change, round(sum(flux * flux) + 1e-9::DOUBLE, 4) AS abs_energy FROM d GROUP BY tic_id",
    "lag_gap_W4": f"WITH {_LC}, d AS (SELECT event_id, t - lag(t) OVER (PARTITION BY tic_id ORDER BY t, event_id) AS dt FROM lc) SELECT event_id, round(dt, 6) AS dt, coalesce(dt > 0.3::DOUBLE * 4.5::DOUBLE, false) AS after_gap FROM d",
    "longest_segment_T6": f"""WITH {_LC}, c AS (SELECT *, CASE WHEN coalesce(t - lag(t) OVER w > 2, false) THEN 1 ELSE 0 END AS cut FROM lc WINDOW w AS (PARTITION BY tic_id ORDER BY t, event_id)), s AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY tic_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg FROM c),
      n AS (SELECT tic_id, seg, count(*) AS n FROM s GROUP BY tic_id, seg QUALIFY row_number() OVER (PARTITION BY tic_id ORDER BY count(*) DESC, seg) = 1) SELECT event_id, s.tic_id, s.seg FROM s JOIN n ON s.tic_id = n.tic_id AND s.seg = n.seg""",
    "sigma_clip_W6": f"WITH {_CLIP} SELECT event_id FROM k5",
    "biweight_W7": f"""WITH RECURSIVE {_LC}, g AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY tic_id ORDER BY t, event_id) > 1.5::DOUBLE, false) AS cut FROM lc),
  s AS (SELECT *, sum(cut::INTEGER) OVER (PARTITION BY tic_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM g),
  x AS (SELECT tic_id, event_id, t, flux, coalesce(list(flux) FILTER (flux IS NOT NULL) OVER (PARTITION BY tic_id, seg ORDER BY t RANGE BETWEEN 1.5::DOUBLE PRECEDING AND 1.5::DOUBLE FOLLOWING), []) AS xs FROM s),
  r AS (SELECT event_id, xs, list_median(xs) AS mid, 0 AS k, len(xs) = 0 AS done FROM x
    UNION ALL SELECT event_id, xs, CASE WHEN spread = 0 THEN mid ELSE new END, k + 1, spread = 0 OR abs(new - mid) < 1e-10::DOUBLE * greatest(1, abs(mid)) FROM (
      SELECT *, list_sum(list_transform(xs, lambda v, i: v * ws[i])) / list_sum(ws) AS new FROM (
        SELECT *, list_transform(xs, lambda v: CASE WHEN abs((v - mid) / nullif(5 * spread, 0)) < 1 THEN (1 - ((v - mid) / (5 * spread)) ** 2) ** 2 ELSE 0 END) AS ws FROM (
          SELECT *, list_median(list_transform(xs, lambda v: abs(v - mid))) AS spread FROM r WHERE NOT done AND k < 10)))),
  m AS (SELECT event_id, arg_max(mid, k) AS trend FROM r GROUP BY event_id)
SELECT tic_id, x.event_id, round(t, 6) AS t, round(trend, 6) AS trend, round(flux / nullif(trend, 0), 6) AS flat_flux FROM x LEFT JOIN m ON x.event_id = m.event_id""",
    "rolling_median_W7": f"WITH {_LC} SELECT event_id, round(median(flux) OVER (PARTITION BY tic_id ORDER BY t RANGE BETWEEN 1.0 PRECEDING AND 1.0 FOLLOWING), 6) AS trend FROM lc",
    "time_bin_T7": f"WITH {_LC}, k AS (SELECT *, CAST(floor((t - min(t) OVER (PARTITION BY tic_id)) / 1.0::DOUBLE) AS BIGINT) AS k FROM lc) SELECT tic_id, k, round(avg(t), 5) AS t, round(avg(flux), 5) AS flux, count(*) AS n FROM k GROUP BY tic_id, k",
    "fold_bin_T2": f"WITH {_PHI} SELECT tic_id, CAST({_BIN.format(n=20)} AS INTEGER) AS bin, round(avg(flux), 6) AS flux, count(*) AS n FROM f WHERE phi < 0.5 GROUP BY 1, 2",
    "phase_std_T17": f"WITH {_PHI}, b AS (SELECT tic_id, {_BIN.format(n=20)} AS bin, avg(flux) AS flux FROM f WHERE phi < 0.5 GROUP BY 1, 2) SELECT tic_id, round(stddev_pop(flux), 6) AS phase_folded_std FROM b GROUP BY tic_id",
    "binned_median_A15": f"WITH {_PHI} SELECT tic_id, CAST({_BIN.format(n=10)} AS INTEGER) AS bin, round(median(flux), 6) AS flux, round(1.253::DOUBLE * stddev_pop(flux) / sqrt(count(flux)), 6) AS error, count(flux) AS n FROM f WHERE phi < 0.5 GROUP BY 1, 2 HAVING count(flux) >= 5",
    "autocorr_W8": f"WITH {_LC}, a AS ({_corr(1)}), b AS ({_corr(10)}) SELECT a.tic_id, round(a.ac, 6) AS ac1, round(b.ac, 6) AS ac10 FROM a JOIN b ON a.tic_id = b.tic_id",
    "quality_gate_T8": f"""WITH {_LC}, g AS (SELECT tic_id, t, flux / nullif(median(flux) OVER (PARTITION BY tic_id), 0) AS flux FROM lc WHERE quality & 543 = 0), d AS (SELECT *, abs(flux - median(flux) OVER (PARTITION BY tic_id)) AS dev FROM g), s AS (SELECT tic_id, max(t) - min(t) AS b, median(dev) * 1.4826::DOUBLE AS rms FROM d GROUP BY tic_id)
      SELECT tic_id, round(b, 6) AS baseline_days, round(rms, 6) AS rms, CASE WHEN b < 28 THEN 'short baseline' WHEN rms > 0.9::DOUBLE THEN 'noisy' END AS reason, CASE WHEN b < 28 OR rms > 0.9::DOUBLE THEN 'gated' ELSE 'done' END AS status FROM s""",
    "interp_J10": f"""WITH {_LC}, g AS (SELECT tic_id, floor(min(t)) + k + 0.123456::DOUBLE AS t FROM lc, range(30) r(k) GROUP BY tic_id, k), a AS (SELECT g.tic_id, g.t, lc.t AS ta, lc.flux AS fa FROM g ASOF LEFT JOIN lc ON g.tic_id = lc.tic_id AND g.t >= lc.t), b AS (SELECT a.*, lc.t AS tb, lc.flux AS fb FROM a ASOF LEFT JOIN lc ON a.tic_id = lc.tic_id AND a.t <= lc.t)
      SELECT tic_id, round(t, 6) AS t, round(fa + (fb - fa) / nullif(tb - ta, 0) * (t - ta), 6) AS flux FROM b""",
    "nearest_epoch_J9": f"WITH {_UNIT} SELECT event_id, CAST(round_even((t - t0) / period, 0) AS BIGINT) AS epoch FROM u",
    "transit_window_T21": f"WITH {_UNIT}, x AS (SELECT *, t - t0 + period / 2 AS x FROM u) SELECT event_id FROM x WHERE abs(x - floor(x / period) * period - period / 2) < greatest(3 * dur / 4, 0.05::DOUBLE)",
    "thin_W15": f"""WITH {_LC}, i AS (SELECT event_id, row_number() OVER (PARTITION BY tic_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY tic_id) AS n FROM lc) SELECT event_id FROM i WHERE n <= 10 OR i = 0 OR floor(i * 9 / greatest(n - 1, 1)::DOUBLE) > floor((i - 1) * 9 / greatest(n - 1, 1)::DOUBLE)""",
    "shape_T12": f"""WITH {_PHI}, h AS (SELECT *, dur / period / 2 AS half, abs(phi) AS a FROM f), z AS (SELECT *, a > half * 0.8::DOUBLE AND a < half * 3 AS base, a < half * 0.35::DOUBLE AS core, a >= half * 0.55::DOUBLE AND a < half * 0.85::DOUBLE AS sh, phi >= -half AND phi < half * -0.1::DOUBLE AS lf, phi > half * 0.1::DOUBLE AND phi <= half AS rt, least(abs(phi - 0.5), abs(phi + 0.5)) < half AS sc FROM h),
      s AS (SELECT tic_id, count(flux) AS n, median(flux) FILTER (base) AS mb, median(flux) FILTER (core) AS mc, median(flux) FILTER (sh) AS ms, median(flux) FILTER (lf) AS ml, median(flux) FILTER (rt) AS mr, median(flux) FILTER (sc) AS m2, count(*) FILTER (base) AS nb, count(*) FILTER (core) AS nc, count(*) FILTER (sh) AS ns, count(*) FILTER (lf) AS nl, count(*) FILTER (rt) AS nr, count(*) FILTER (sc) AS n2 FROM z GROUP BY tic_id),
      q AS (SELECT *, mb - mc AS d, n >= 32 AND nb >= 2 AND nc >= 2 AND mb - mc > 0 AS ok FROM s)
      SELECT tic_id, CASE WHEN ok AND ns >= 2 THEN round(least(greatest((mb - ms) / d, 0), 2), 6) END AS flat_bottom_score, CASE WHEN ok AND nl >= 2 AND nr >= 2 THEN round((mr - ml) / d, 6) END AS ingress_egress_asym, CASE WHEN ok AND n2 >= 2 THEN round(greatest(mb - m2, 0), 6) END AS secondary_depth, CASE WHEN ok AND n2 >= 2 THEN round(greatest(mb - m2, 0) / d, 6) END AS secondary_ratio FROM q""",
    "odd_even_T13": f"""WITH {_UNIT}, k AS (SELECT *, round_even((t - t0) / period, 0) AS k, ceil((min(t) OVER (PARTITION BY tic_id) - t0) / period) AS first FROM u), e AS (SELECT tic_id, k, CAST((k - first) AS BIGINT) % 2 AS parity, 1 - median(flux) AS depth FROM k WHERE abs(t - t0 - k * period) < dur / 2 AND k >= first GROUP BY ALL),
      s AS (SELECT tic_id, CASE WHEN count(*) FILTER (parity = 1) >= 2 THEN median(depth) FILTER (parity = 1) END AS o, CASE WHEN count(*) FILTER (parity = 0) >= 2 THEN median(depth) FILTER (parity = 0) END AS e FROM e GROUP BY tic_id) SELECT tic_id, round(o, 6) AS odd_depth, round(e, 6) AS even_depth, round(o / nullif(e, 0), 6) AS odd_even_ratio FROM s""",
    "centroid_T14": f"""WITH {_PHI}, h AS (SELECT *, dur / period / 2 AS half, abs(phi) AS a FROM f), z AS (SELECT *, a < half * 0.5 AS i, a > half * 1.5 AND a < half * 6 AS o FROM h), s AS (SELECT tic_id, count(*) FILTER (i) AS ni, count(*) FILTER (o) AS no, (median(c1) FILTER (i) - median(c1) FILTER (o)) / nullif(stddev_pop(c1) FILTER (o), 0) AS x, (median(c2) FILTER (i) - median(c2) FILTER (o)) / nullif(stddev_pop(c2) FILTER (o), 0) AS y FROM z GROUP BY tic_id)
      SELECT tic_id, CASE WHEN ni >= 2 AND no >= 2 THEN round(sqrt(x * x + y * y), 6) END AS centroid_proxy FROM s""",
    "ts_stats_T15": f"""WITH {_UNIT}, m AS (SELECT *, avg(flux) OVER w AS mu, stddev_pop(flux) OVER w AS sd FROM u WINDOW w AS (PARTITION BY tic_id)) SELECT tic_id, round(stddev_pop(flux), 6) AS rms, round(avg((flux - mu) ** 3) / nullif(avg((flux - mu) ** 2) ** 1.5, 0), 6) AS skewness, round(avg((flux - mu) ** 4) / nullif(avg((flux - mu) ** 2) ** 2, 0) - 3, 6) AS kurtosis, round(max(flux) - min(flux), 6) AS flux_range,
      round(avg(CASE WHEN flux > 1 + 3 * sd THEN 1.0::DOUBLE ELSE 0 END), 6) AS above_3sigma_frac, round(avg(CASE WHEN flux < 1 - 3 * sd THEN 1.0::DOUBLE ELSE 0 END), 6) AS below_3sigma_frac, round(quantile_cont(flux, 0.05), 6) AS flux_percentile_5, round(quantile_cont(flux, 0.95), 6) AS flux_percentile_95 FROM m GROUP BY tic_id HAVING count(flux) >= 10""",
    "dft_T16": """WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS x, len(embedding) AS n FROM embeddings), c AS (SELECT vec_id, CAST(k AS INTEGER) AS k, sum(x * cos(2 * pi() * k * j / n)) AS re, sum(-x * sin(2 * pi() * k * j / n)) AS im FROM x, range(10) r(k) GROUP BY vec_id, k) SELECT vec_id, k, round(re, 5) AS re, round(sqrt(re * re + im * im), 5) AS modulus FROM c""",
    "hz_T18": """WITH s AS (SELECT c_custkey, CAST(4000 + c_custkey % 3000 AS DOUBLE) AS teff, 0.5::DOUBLE + c_custkey % 10 * 0.1::DOUBLE AS rad, 0.6::DOUBLE + c_custkey % 7 * 0.1::DOUBLE AS mass, CAST(5 + c_custkey % 700 AS DOUBLE) AS period FROM customer), l AS (SELECT c_custkey, sqrt((teff / 5778) ** 4 * rad ** 2 / 1.1::DOUBLE) AS i, sqrt((teff / 5778) ** 4 * rad ** 2 / 0.36::DOUBLE) AS o, cbrt((period / 365.25::DOUBLE) ** 2 * mass) AS a FROM s)
      SELECT c_custkey, round(a, 6) AS a_au, round(i, 6) AS inner_au, round(o, 6) AS outer_au, CASE WHEN a >= i AND a <= o THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hz_in_zone, round(abs(a - (i + o) / 2) / ((o - i) / 2), 6) AS hz_proximity FROM l""",
    "density_prior_T23": """WITH s AS (SELECT c_custkey, c_custkey % 10 * 0.1::DOUBLE AS rad, 0.6::DOUBLE + c_custkey % 7 * 0.1::DOUBLE AS mass, CAST(1 + c_custkey % 30 AS DOUBLE) AS period FROM customer) SELECT c_custkey, CASE WHEN rad > 0 THEN round(ln(cbrt(mass / nullif(rad ** 3, 0) * 1410 * 6.674e-11 * (period * 86400) ** 2 / (3 * pi()))), 6) END AS ln_a, CASE WHEN rad > 0 THEN 0.1::DOUBLE END AS ln_a_sd FROM s""",
    "size_class_T27": "SELECT p_partkey, CASE WHEN p_size >= 45 OR p_size IS NULL THEN 'unknown' WHEN p_size / 2.5 < 1.25 THEN 'Earth-size' WHEN p_size / 2.5 < 2 THEN 'Super-Earth' WHEN p_size / 2.5 < 6 THEN 'Neptune-size' WHEN p_size / 2.5 < 15 THEN 'Jupiter-size' ELSE 'too large for a planet (likely stellar companion)' END AS size_class FROM part",
    "diagnostics_T29": f"""WITH {_UNIT}, x AS (SELECT *, round_even((t - t0) / period, 0) AS k FROM u), y AS (SELECT *, abs(t - t0 - k * period) AS ph, CAST(k AS BIGINT) % 2 AS par FROM x), s AS (SELECT tic_id, avg(flux) FILTER (ph > dur * 0.75 AND ph < dur * 3) AS base, stddev_pop(flux) FILTER (ph > dur * 0.75 AND ph < dur * 3) AS sd, avg(flux) FILTER (ph < dur * 0.25 AND par = 0) AS ev, avg(flux) FILTER (ph < dur * 0.25 AND par = 1) AS od, count(*) FILTER (ph < dur * 0.25 AND par = 0) AS ne, count(*) FILTER (ph < dur * 0.25 AND par = 1) AS no FROM y GROUP BY tic_id)
      SELECT tic_id, round(base - od, 6) AS odd_depth, round(base - ev, 6) AS even_depth, round(abs(od - ev) / nullif(sd * sqrt(1.0::DOUBLE / nullif(no, 0) + 1.0::DOUBLE / nullif(ne, 0)), 0), 6) AS odd_even_sigma FROM s""",
    "bls_T9": f"WITH {_UNIT}, {_BOX.format(src='u')} SELECT tic_id, round(period, 6) AS period, bin, round(sr, 6) AS sr, round(sde, 6) AS sde, round(depth, 6) AS depth, n_in FROM box",
    "candidates_T11": f"WITH {_UNIT}, {_BOX.format(src='u')} SELECT tic_id, round(sde, 6) AS sde, coalesce(round(sde, 6) >= 3, false) AS is_candidate FROM box",
    "ranked_dips": f"""WITH {_LC}, w0 AS (SELECT tic_id, t, flux / nullif(median(flux) OVER (PARTITION BY tic_id), 0) AS flux, max(t) OVER (PARTITION BY tic_id) - min(t) OVER (PARTITION BY tic_id) AS base FROM lc WHERE quality & 543 = 0), w AS (SELECT * FROM w0 WHERE base >= 13.5), {_BOX.format(src='w')}, z AS (SELECT *, round(sde, 6) AS q FROM box)
      SELECT tic_id, round(period, 6) AS period, bin, round(sr, 6) AS sr, q AS sde, round(depth, 6) AS depth, n_in, CAST(row_number() OVER (ORDER BY q DESC, tic_id) AS INTEGER) AS rank FROM z WHERE q >= 2 ORDER BY q DESC, tic_id LIMIT 50""",
    "vetting_R1": f"WITH {_FITS} SELECT tic_id, array_to_string(list_concat(hard, soft), '; ') AS flags, verdict, CAST(len(hard) AS INTEGER) AS n_hard FROM v",
    "rank_R3": f"WITH {_FITS} SELECT tic_id, rank_score FROM r",
    "catalog_R5": f"WITH {_FITS} SELECT tic_id, verdict, rank_score, CAST(row_number() OVER (ORDER BY rank_score DESC NULLS LAST, tic_id) AS INTEGER) AS rank FROM r",
    "posterior_summary_T28": "WITH q AS (SELECT l_suppkey, quantile_cont(l_extendedprice, [0.5, 0.1587, 0.8413, 0.025, 0.975]) AS p FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, round(p[1], 6) AS med, round(p[1] - p[2], 6) AS lo, round(p[3] - p[1], 6) AS hi, round(p[4], 6) AS ci95_lo, round(p[5], 6) AS ci95_hi FROM q",
    "kpi_R9": f"WITH {_UNIT}, s AS (SELECT tic_id, stddev_pop(flux) AS rms FROM u GROUP BY tic_id HAVING count(flux) >= 10) SELECT CAST(least(greatest(floor(rms / 0.1::DOUBLE) + 1, 0), 21) AS INTEGER) AS bucket, count(*) AS n FROM s GROUP BY 1",
    "confusion_A20": f"WITH {_SCORES} SELECT y, pred, count(*) AS n FROM p GROUP BY y, pred",
    "prf_A21": f"""WITH {_SCORES}, k AS (SELECT y AS k FROM p UNION SELECT pred FROM p), c AS (SELECT k, count(*) FILTER (y = k) AS support, count(*) FILTER (pred = k) AS said, count(*) FILTER (y = k AND pred = k) AS hit FROM p, k GROUP BY k), q AS (SELECT *, coalesce(hit / nullif(said, 0)::DOUBLE, 0) AS pr, coalesce(hit / nullif(support, 0)::DOUBLE, 0) AS re FROM c) SELECT k, support, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1 FROM q""",
    "roc_auc_A22": f"WITH {_SCORES}, m AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM p) SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y)))::DOUBLE, 6) AS auc FROM m",
    "avg_precision_A23": f"WITH {_SCORES}, g AS (SELECT score, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM p GROUP BY score), c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS al FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT round(sum(pos * tp / al) / sum(pos), 6) AS ap FROM c",
    "brier_A24": f"WITH {_SCORES} SELECT round(avg((score - y) * (score - y)), 6) AS brier FROM p",
    "group_split_M2": "WITH r AS (SELECT CAST(c_custkey AS VARCHAR) AS grp, c_mktsegment AS label, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(CAST(c_custkey AS VARCHAR) || '42'), CAST(c_custkey AS VARCHAR)) AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT grp, label, CASE WHEN rn <= greatest(1, round_even(n * 0.25::DOUBLE, 0)) THEN 'test' ELSE 'train' END AS part FROM r",
    "learning_fraction_W14": "WITH r AS (SELECT CAST(c_custkey AS VARCHAR) AS grp, c_mktsegment AS label, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(CAST(c_custkey AS VARCHAR) || '42'), CAST(c_custkey AS VARCHAR)) AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT grp, label FROM r WHERE rn <= greatest(4, floor(n * 0.4::DOUBLE))",
    "tumbling_bins": "SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "session_segments": """WITH c AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 43200000000 THEN 0 ELSE 1 END AS cut FROM events), s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS seg FROM c)
      SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, seg""",
    "fold_T1": f"WITH {_PHI} SELECT event_id, round(phi, 6) AS phi FROM f",
    "hours_T3": f"WITH {_UNIT}, x AS (SELECT *, t - t0 + period / 2 AS x FROM u) SELECT event_id, round((x - floor(x / period) * period - period / 2) * 24, 5) AS hours FROM x",
    "gap_fill_T5": f"""WITH {_LC}, g AS (SELECT tic_id, event_id, t, CASE WHEN event_id % 4 <> 0 THEN flux END AS flux FROM lc), known AS (SELECT * FROM g WHERE flux IS NOT NULL),
      a AS (SELECT g.tic_id, g.event_id, g.t, g.flux, p.t AS ta, p.flux AS fa FROM g ASOF LEFT JOIN known p ON g.tic_id = p.tic_id AND g.t >= p.t), b AS (SELECT a.*, q.t AS tb, q.flux AS fb FROM a ASOF LEFT JOIN known q ON a.tic_id = q.tic_id AND a.t <= q.t)
      SELECT event_id, round(coalesce(flux, fa + (fb - fa) / nullif(tb - ta, 0) * (t - ta)), 4) AS flux FROM b""",
    "adaptive_bin_T22": f"""WITH {_LC}, k AS (SELECT *, count(*) OVER (PARTITION BY tic_id) AS c, CAST(floor((t - min(t) OVER (PARTITION BY tic_id)) / 2.0::DOUBLE) AS BIGINT) AS k FROM lc)
      SELECT tic_id, round(avg(t), 6) AS t, round(avg(flux), 6) AS flux, count(*) AS n FROM k GROUP BY tic_id, CASE WHEN c > 60 THEN k END, CASE WHEN c <= 60 THEN event_id END""",
    "epoch_join_J8": f"""WITH {_UNIT}, s AS (SELECT tic_id, min(t) AS a, max(t) AS b, min(period) AS period, min(t0) AS t0 FROM u GROUP BY tic_id),
      e AS (SELECT tic_id, CAST(unnest(range(CAST(ceil((a - t0) / period) AS BIGINT), CAST(floor((b - t0) / period) AS BIGINT) + 1)) AS BIGINT) AS epoch, t0, period FROM s)
      SELECT e.tic_id, epoch, round(e.t0 + epoch * e.period, 5) AS mid, count(u.flux) AS n, round(avg(u.flux), 5) AS flux FROM e LEFT JOIN u ON e.tic_id = u.tic_id AND abs(u.t - e.t0 - epoch * e.period) < u.dur / 2 GROUP BY e.tic_id, epoch, e.t0, e.period""",
    "epochs_X10": f"""WITH {_UNIT}, s AS (SELECT tic_id, min(t) AS a, max(t) AS b, min(period) AS period, min(t0) AS t0 FROM u GROUP BY tic_id)
      SELECT tic_id, epoch, round(t0 + epoch * period, 5) AS mid FROM (SELECT tic_id, t0, period, CAST(unnest(range(CAST(ceil((a - t0) / period) AS BIGINT), CAST(floor((b - t0) / period) AS BIGINT) + 1)) AS BIGINT) AS epoch FROM s)""",
    "derived_T26": """WITH x AS (SELECT l_orderkey, l_linenumber, 1.0::DOUBLE + l_orderkey % 40 AS p, 0.01::DOUBLE + l_discount AS rp, l_tax * 12 AS b, 3.0::DOUBLE + l_quantity AS a, l_linenumber AS n_in,
        CASE WHEN l_orderkey % 5 <> 0 THEN (l_orderkey % 5) * 0.4::DOUBLE END AS r, CASE WHEN l_orderkey % 7 <> 0 THEN 4000.0::DOUBLE + l_orderkey % 3000 END AS teff FROM lineitem),
      y AS (SELECT *, acos(least(greatest(b / a, 0), 1)) AS inc, r * r * pow(teff / 5772.0::DOUBLE, 4) AS l, a * r * 0.00465047::DOUBLE AS au FROM x),
      z AS (SELECT *, sqrt(greatest(pow(1 + rp, 2) - b * b, 0)) / nullif(a * sin(inc), 0) AS chord, sqrt(l / 1.1::DOUBLE) AS i, sqrt(l / 0.36::DOUBLE) AS o FROM y),
      h AS (SELECT *, abs(au - (i + o) / 2) / ((o - i) / 2) AS hz FROM z)
      SELECT l_orderkey, l_linenumber, round(degrees(inc), 4) AS inc_deg, round(rp * rp * 1e6::DOUBLE, 4) AS depth_ppm, round(p / pi() * asin(CASE WHEN chord IS NULL THEN 0 ELSE least(greatest(chord, 0), 1) END) * 24, 4) AS t14_hr, round(rp * rp / 0.002::DOUBLE * sqrt(greatest(n_in, 1)), 4) AS fit_snr,
        round(rp * r * 109.076::DOUBLE, 4) AS rp_rearth, round(au, 4) AS a_au, round(CASE WHEN r IS NOT NULL THEN teff * sqrt(0.5::DOUBLE / a) END, 4) AS teq_k, round(hz, 4) AS hz_score, hz <= 1 AS in_hz FROM h""",
    "select_M12": """WITH k AS (SELECT o_orderkey AS k FROM orders), x AS (SELECT k, CASE WHEN k % 9 = 0 THEN 'SYN_' ELSE '' END || k AS tic_id, CASE WHEN k % 4 <> 0 THEN (k % 10) * 0.1::DOUBLE END AS p, (k % 23) * 0.5::DOUBLE AS sde, CASE k % 3 WHEN 0 THEN 0.001::DOUBLE WHEN 1 THEN 0.5::DOUBLE END AS fap FROM k WHERE k % 8 <> 0 AND k % 6 <> 0 AND k % 9 <> 0)
      SELECT tic_id, round(p, 6) AS p_transit, round(sde, 6) AS sde FROM x WHERE CASE WHEN p IS NOT NULL THEN p >= 0.5::DOUBLE ELSE sde >= 7 AND coalesce(fap < 0.01::DOUBLE, true) END""",
    "group_folds_M3": "SELECT CAST(c_custkey AS VARCHAR) AS grp, c_mktsegment AS label, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(CAST(c_custkey AS VARCHAR) || '42'), CAST(c_custkey AS VARCHAR)) - 1) % 5 AS INTEGER) AS fold FROM customer",
    "plot_fold_R7": f"WITH {_PHI}, b AS (SELECT tic_id, CAST({_BIN.format(n=40)} AS INTEGER) AS bin, avg(flux) AS flux, count(*) AS n FROM f WHERE phi < 0.5 GROUP BY 1, 2) SELECT tic_id, bin, round(flux, 6) AS flux, n, round(min(flux) OVER (PARTITION BY tic_id), 6) AS lowest, CAST(sum(n) OVER (PARTITION BY tic_id) AS BIGINT) AS points FROM b",
}
