"""Chains, bands and neighbours against closed forms and brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dipscan import plans
from dipscan.operators import fitting, neighbours, posterior


def long_rows(spark, chains, star="1"):
    m, n = chains.shape
    pdf = pd.DataFrame({"tic_id": star, "chain": np.repeat(np.arange(m), n), "step": np.tile(np.arange(n), m), "value": chains.ravel()})
    return spark.createDataFrame(pdf)


def test_rhat_equals_its_formula_and_tells_mixed_from_unmixed(spark):
    rng = np.random.default_rng(1)
    good, bad = rng.normal(size=(4, 501)), rng.normal(size=(4, 500)) + np.arange(4)[:, None]
    rows = long_rows(spark, good, "good").unionByName(long_rows(spark, bad, "bad")).repartition(9)
    got = {r.tic_id: r for r in posterior.split_rhat(rows, ["tic_id"], "chain", "step", "value").collect()}
    for name, x in (("good", good), ("bad", bad)):
        half = x.shape[1] // 2
        parts = [p for c in x for p in (c[:half], c[half:])]
        n, within, between = np.mean([len(p) for p in parts]), np.mean([p.var(ddof=1) for p in parts]), np.var([p.mean() for p in parts], ddof=1)
        assert math.isclose(got[name].rhat, math.sqrt(((n - 1) / n * within + between) / within), rel_tol=1e-9)
        assert got[name].draws == x.size and got[name].chains == 4 and math.isclose(got[name]["mean"], x.mean(), abs_tol=1e-9)
    assert got["good"].rhat < 1.02 and got["bad"].rhat > 1.3
    assert posterior.split_rhat(rows.where("step = 0"), ["tic_id"], "chain", "step", "value").first().rhat is None


@pytest.mark.parametrize("rho", [0.0, 0.5, 0.9])
def test_effective_size_of_autoregressive_chains(spark, rho):
    rng = np.random.default_rng(3)
    x = np.zeros((4, 6_000))
    noise = rng.normal(size=x.shape)
    x[:, 0] = noise[:, 0] / math.sqrt(1 - rho * rho)
    for i in range(1, x.shape[1]):
        x[:, i] = rho * x[:, i - 1] + noise[:, i]
    theory = x.size * (1 - rho) / (1 + rho)
    rows = long_rows(spark, x)
    got = posterior.bulk_effective_sizes(rows).first()
    assert got.status == "done" and math.isclose(got.ess, theory, rel_tol=0.15)
    batch = posterior.batch_effective_size(rows, ["tic_id"], "chain", "step", "value", 100).first().ess
    assert math.isclose(batch, theory, rel_tol=0.35)


def test_band_holds_the_planted_models(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows, truth = [], {}
    hours = np.linspace(-3, 3, 13)
    for s in range(12):
        t = np.sort(rng.uniform(0, 20, 500))
        period, tc, rp, b, a = 4.0, 1.0, rng.uniform(0.06, 0.12), rng.uniform(0.0, 0.6), 8.0
        flux = fitting.transit_model(fitting.separation(t, tc, period, a, b), rp, rings=100) + rng.normal(0, 5e-4, len(t))
        truth[str(s)] = fitting.transit_model(fitting.separation(tc + hours / 24, tc, period, a, b), rp, rings=100)
        rows.append(pd.DataFrame({"tic_id": str(s), "event_id": np.arange(500), "t": t, "flux": flux, "period": period, "t0": tc, "dur": 0.18, "ln_a": math.log(a)}))
    lc = spark.createDataFrame(pd.concat(rows, ignore_index=True))
    folder = f"file://{tmp_path}/samples"
    options = {"steps": 400, "longest": 400, "keep": 600, "ln_a_sd": 0.05}
    samples = posterior.cached_samples(spark, folder, lc, **options)
    again = posterior.cached_samples(spark, folder, lc.where("1 / 0 > 0"), **options)  # nothing is sampled a second time
    assert again.count() == samples.count() > 0
    band = posterior.model_band(samples.withColumns({"period": F.lit(4.0), "t0": F.lit(1.0)}), hours.tolist()).toPandas()
    inside = [r.q0 - 2e-4 <= truth[r.tic_id][np.abs(hours - r.hours).argmin()] <= r.q4 + 2e-4 for r in band.itertuples()]
    assert len(inside) == 12 * 13 and np.mean(inside) >= 0.95
    assert (band.q0 <= band.q2).all() and (band.q2 <= band.q4).all() and (band[band.hours == 0].q4 - band[band.hours == 0].q0).max() < 3e-3
    points = posterior.trend_points(lc.where("tic_id = '0'")).toPandas()
    assert len(points) == 500 and points.in_dip.sum() > 5 and set(points[points.in_dip].epoch) <= {0, 1, 2, 3, 4}


@pytest.mark.parametrize("case", ["spread", "copies", "line", "few"])
def test_neighbours_equal_all_pairs(spark, case):
    rng = np.random.default_rng(6)
    x = {"spread": rng.normal(size=(900, 3)), "copies": np.concatenate([np.ones((400, 2)), rng.integers(0, 4, (200, 2))]), "line": np.stack([np.arange(300), np.zeros(300)], axis=1), "few": rng.normal(size=(3, 2))}[case].astype(float)
    names = [f"x{j}" for j in range(x.shape[1])]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=np.arange(len(x))[::-1] * 3)).repartition(5)
    extra = df.limit(1).select(*[F.lit(None).cast("double").alias(c) for c in names], (F.col("id") * 0 + 10 ** 6).alias("id"))
    got = neighbours.nearest(df.unionByName(extra), names, 4, pivots=16, block=50).toPandas().sort_values(["id", "place"])
    ids = np.arange(len(x))[::-1] * 3
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for row in rng.choice(len(x), min(60, len(x)), replace=False):
        want = sorted((float(d[row, j]), int(ids[j])) for j in range(len(x)) if j != row)[:4]
        have = got[got.id == ids[row]]
        assert have["neighbour"].tolist() == [i for _, i in want] and np.allclose(have["distance"], [v for v, _ in want])
    assert len(got) == len(x) * min(4, len(x) - 1)


def test_cells_are_passed_over(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4_000, 2)) * 0.05 + rng.integers(0, 12, (4_000, 1)) * 10.0
    centres = np.unique(np.round(x, -1), axis=0)[:, :1].repeat(2, axis=1)
    d = neighbours._from_pivots(x, centres)
    cell, off = d.argmin(axis=1), d.min(axis=1)
    radius = np.array([off[cell == c].max() if (cell == c).any() else -1 for c in range(len(centres))])
    reach = radius + np.array([np.sort(off[cell == c])[5] if (cell == c).sum() > 5 else np.inf for c in range(len(centres))])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), pa.array(np.ones(len(x), np.int64)), pa.array([[i] for i in range(len(x))]), pa.array(cell.astype(np.int32)), pa.array(off)], names=["x", "n", "ids", "cell", "off"])
    sent = sum(b.num_rows for b in neighbours._candidates(centres, radius, reach, np.ones(len(centres), np.int64))(iter([batch])))
    assert sent <= 1.5 * len(x)  # of 12 cells, almost only the own one


def test_oversampling_uses_the_nearest(spark):
    rows = [(i, 0, float(i % 50), 0.0) for i in range(200)] + [(1000 + i, 1, float(v), 0.0) for i, v in enumerate([0, 1, 2, 100, 101, 102])]
    df = spark.createDataFrame(rows, "doc_id bigint, label int, x double, y double")
    made = plans.oversampled(df, ["x", "y"], neighbours=2).where("synthetic").toPandas()
    assert len(made) == 194 and ((made.x <= 2) | (made.x >= 100)).all()  # never between the two clumps


def test_boxes_hold_as_many_rows_at_any_size():
    rng = np.random.default_rng(8)
    for n in (4_000, 32_000):
        x = np.stack([rng.uniform(0, 10, n), rng.integers(0, 25, n).astype(float)], axis=1)
        splits, low, high = neighbours.boxes(x[rng.choice(n, n // 500 * 16, replace=False)], 16)
        own = neighbours._box_of(splits, x)
        assert len(low) > n / 1_500 and np.bincount(own).max() < 2_500
        assert ((x >= low[own]) & (x <= high[own])).all()
        row, box = neighbours._within(splits, low, high, x, np.full(n, 0.01))
        assert n <= len(row) < 2 * n and set(zip(range(n), own.tolist())) <= set(zip(row.tolist(), box.tolist()))


def test_bands_are_exact_up_to_crowded_stars(spark):
    rng = np.random.default_rng(12)
    n = {"a": 30_000, "b": 7, "c": 1}
    star = rng.permutation(np.repeat(list(n), list(n.values())))
    pdf = pd.DataFrame({"tic_id": star, "tc": rng.normal(0, 0.02, len(star)), "rp_rs": rng.uniform(0.05, 0.2, len(star)), "b": rng.uniform(0, 0.9, len(star)), "ln_a": np.log(8.0), "period": 5.0, "t0": 1.0})
    hours = [-2.2, 0.3, 9.0]
    p = pdf[["tc", "rp_rs", "b"]].to_numpy()
    flux = np.stack([fitting.transit_model(fitting.separation(1.0 + h / 24, p[:, 0], 5.0, 8.0, p[:, 2]), p[:, 1], rings=20) for h in hours], axis=1)
    samples = spark.createDataFrame(pdf).repartition(7)
    assert sorted(posterior.model_band(samples, hours).columns) == ["hours", "q0", "q1", "q2", "q3", "q4", "tic_id"]

    def ranks(band):
        """How far each percentile lies from its rank."""
        out = {}
        for r in band.collect():
            values = np.sort(np.round(flux[star == r.tic_id][:, hours.index(r.hours)], 9))
            for k, q in enumerate(posterior.LIMITS):
                at = max(1, math.ceil(q * len(values) - 1e-9)) - 1
                a, b = np.searchsorted(values, r[f"q{k}"] - 2e-9), np.searchsorted(values, r[f"q{k}"] + 2e-9, "right") - 1
                out[r.tic_id, r.hours, k] = max(0, a - at, at - b)
        return out

    exact = ranks(posterior.model_band(samples, hours, rings=20))
    assert len(exact) == 45 and set(exact.values()) == {0}
    crowded = ranks(posterior.model_band(samples, hours, rings=20, most=100))
    assert len(crowded) == 45 and max(crowded.values()) <= 6 and all(v == 0 for (s, *_), v in crowded.items() if s != "a")
