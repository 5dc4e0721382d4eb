"""Templates, false alarms, isolation of stars and work units."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dipscan import plans
from dipscan.operators import batches, fitting, search, templates


def curves(spark, stars, n, noise=1e-3, seed=1, days=20.0, dip=None):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(stars):
        t = np.sort(rng.uniform(0, days, n))
        f = 1 + rng.normal(0, noise, n)
        if dip:
            f *= dip(t, s)
        rows.append(pd.DataFrame({"tic_id": str(s), "event_id": np.arange(n) + s * n, "t": t, "flux": f}))
    return spark.createDataFrame(pd.concat(rows, ignore_index=True))


def test_bank_covers_lengths_in_steps():
    shapes, lengths, covers = templates.template_bank(200)
    assert np.allclose(lengths[1:] / lengths[:-1], 1.05) and lengths[0] == 1 / 200 and lengths[-1] <= 0.12 < lengths[-1] * 1.05
    assert ((shapes > 0).sum(axis=1) <= covers).all() and shapes.max() <= 1 and shapes[-1].max() > 0.99
    middle = shapes[-1][: covers[-1]]
    assert np.allclose(middle, middle[::-1], atol=1e-8) and (np.diff(middle[: covers[-1] // 2]) >= -2e-3).all()
    # rounder than a box: limb darkening makes the middle deeper than the flanks
    assert middle[covers[-1] // 4] < middle[covers[-1] // 2]


def test_correlations_equal_direct_fits():
    rng = np.random.default_rng(2)
    t, f = np.sort(rng.uniform(0, 12, 80)), rng.normal(1, 0.1, 80)
    shapes, _, _ = templates.template_bank(12, low=0.1, high=0.4, step=1.5)
    periods = np.array([3.1, 2.2, 1.7])
    best = (0.0,)
    for p in periods:
        cell = np.floor(((t - t.min()) / p % 1) * 12).astype(int)
        for k, shape in enumerate(shapes):
            for first in range(12):
                x = shape[(cell - first) % 12]
                if x.var() * len(x) < 1e-6:
                    continue
                slope, _ = np.polyfit(x, f, 1)
                gain = ((f - f.mean()) ** 2).sum() - ((f - np.polyval(np.polyfit(x, f, 1), x)) ** 2).sum()
                if slope < 0 and gain > best[0] + 1e-9:
                    best = (gain, p, first, k, -slope)
    period, first, k, power, _, depth, _ = templates.strongest_shape(t, f, periods, shapes)
    assert (period, first, k) == best[1:4] and math.isclose(power, best[0], abs_tol=1e-8) and math.isclose(depth, best[4], abs_tol=1e-8)


def test_shapes_find_planted_dips_better_than_boxes():
    rng = np.random.default_rng(8)
    shapes, lengths, covers = templates.template_bank(96, step=1.1)
    t = np.arange(0, 27, 1 / 30)
    better, right = [], 0
    for _ in range(10):
        period = rng.uniform(2, 8)
        f = fitting.transit_model(fitting.separation(t, 0.4 + rng.uniform(0, 1), period, 9, 0.2), 0.05, rings=100) + rng.normal(0, 1.5e-3, len(t))
        trials = search.trial_periods(26.9, 1.5, 27, 1 / 96, 1)
        a = templates.strongest_shape(t, f, trials, shapes)
        b = search.strongest_box(t, f, trials, 96, tuple(sorted(set(covers.tolist()))))
        better.append(a[3] / (len(t) * b[3]))  # both in sums of squares
        right += abs(a[0] / period - 1) < 0.01
    assert np.mean(better) > 1.02 and right >= 9


def test_false_alarms_are_as_rare_as_they_say(spark):
    bank = templates.template_bank(24, low=1 / 12, high=0.12, step=1.3)
    options = {"bank": bank, "oversampling": 1, "low": 2.0, "min_raw": 20, "min_binned": 20}
    noise = curves(spark, 2_000, 70)
    found = templates.template_candidates(noise, **options).select("fap").toPandas()["fap"].dropna()
    assert len(found) > 1_990
    assert 0.005 <= (found < 0.01).mean() <= 0.02
    assert 0.03 <= (found < 0.05).mean() <= 0.07
    dip = lambda t, s: fitting.transit_model(fitting.separation(t, 0.3, 3.3, 7, 0.1), 0.05, rings=60)
    planted = templates.template_candidates(curves(spark, 40, 260, noise=5e-4, dip=dip), min_sde=4.0, least=20, **options).toPandas()
    assert (planted["fap"] < 0.01).mean() > 0.5 and (planted["is_candidate"] == ((planted["sde"] >= 4) & (planted["fap"] < 0.01))).all()


def test_permuted_curves_keep_times_and_values(spark):
    lc = curves(spark, 3, 30)
    mixed = templates.permuted(lc).toPandas().sort_values("event_id")
    own = lc.toPandas().sort_values("event_id")
    assert (mixed["t"].to_numpy() == own["t"].to_numpy()).all() and not (mixed["flux"].to_numpy() == own["flux"].to_numpy()).all()
    for s in "012":
        assert sorted(mixed.loc[mixed.tic_id == s, "flux"]) == sorted(own.loc[own.tic_id == s, "flux"])


def test_broken_curves_leave_the_others_alone(spark):
    lc = curves(spark, 12, 60).withColumns({"period": F.lit(3.0), "t0": F.lit(1.0), "dur": F.lit(0.5), "ln_a": F.lit(2.0)})
    bad = F.col("tic_id").isin("3", "7")
    broken = lc.withColumn("flux", F.when(bad, float("inf")).otherwise(F.col("flux")))
    for run in (lambda x: search.period_search(x, low=2.0, oversampling=1, isolate=True), lambda x: templates.template_search(x, low=2.0, bins=24, oversampling=1)):
        clean = {tuple(r) for r in run(lc).where(~bad).collect()}
        rows = run(broken)
        assert {tuple(r) for r in rows.where(~bad).collect()} == clean
        assert {r.status.split(":")[1] for r in rows.where(bad).collect()} == {" ValueError"}
    done, failed = batches.settled(fitting.fitted(lc.withColumn("period", F.when(bad, -1.0).otherwise(3.0))))
    assert {r.tic_id for r in failed.collect()} == {"3", "7"} and done.count() == 10
    tally = {r.status: r.stars for r in batches.status_tally(done, failed).collect()}
    assert tally["failed: ValueError"] == 2 and sum(tally.values()) == 12
    with pytest.raises(batches.BatchFailed):
        batches.settled(fitting.fitted(lc.withColumn("period", F.lit(-1.0))))
    # a task that cannot go on at all is a row as well
    rows = batches.per_star(lc.select("tic_id", "t"), lambda pdf: 1 / 0 if pdf["tic_id"].iloc[0] == "5" else pdf[["tic_id", "t"]], "tic_id string, t double", True).collect()
    assert [(r.t, r.status) for r in rows if r.tic_id == "5"] == [(None, "failed: ZeroDivisionError: division by zero")]
    assert sum(r.status == "done" for r in rows) == 11 * 60
    made = fitting.injected(lc.withColumn("t", F.when(bad, None).otherwise(F.col("t"))), isolate=True).groupBy("tic_id").agg(F.max("status").alias("status")).collect()
    assert len(made) == 12 and sum(r.status == "done" for r in made) >= 10


def test_a_run_that_breaks_off_goes_on_after_its_last_unit(spark, tmp_path):
    folder = f"file://{tmp_path}/fits"
    lc = curves(spark, 30, 40).withColumns({"period": F.lit(3.0), "t0": F.lit(1.0), "dur": F.lit(0.5), "ln_a": F.lit(2.0)})
    schema = fitting.T._parse_datatype_string(fitting.FIT_SCHEMA)
    calls = []

    def breaks(rows):
        calls.append(1)
        if len(calls) == 3:
            # the third unit writes a part and dies before its record
            fitting.fitted(rows, min_points=5).write.parquet(f"{folder}/unit-lost")
            raise RuntimeError("executor lost")
        return fitting.fitted(rows, min_points=5)

    with pytest.raises(RuntimeError):
        batches.in_units(lc, folder, breaks, schema, units=5)
    held, commits = batches.committed(folder, schema, spark)
    first = {r.part: r.stars for r in commits.collect()}
    assert len(first) == 2 and held.select("tic_id").distinct().count() == sum(first.values()) < 30
    done = fitting.fit_pending(lc, folder, units=5, min_points=5)
    assert done.count() == 30 == done.select("tic_id").distinct().count()
    later = {r.part: r.stars for r in batches.committed(folder, schema, spark)[1].collect()}
    assert first.items() <= later.items() and sum(later.values()) == 30  # the first units were not fitted again
    assert fitting.fit_pending(lc, folder, units=5, min_points=5).count() == 30
    more = fitting.fit_pending(lc.unionByName(lc.withColumn("tic_id", F.concat(F.lit("n"), "tic_id"))), folder, units=5, min_points=5)
    assert more.count() == 60


def test_cache_recovers_from_a_write_that_broke_off(spark, tmp_path):
    folder = f"file://{tmp_path}/cache"
    (tmp_path / "cache" / "_temporary").mkdir(parents=True)
    (tmp_path / "cache" / "data-0").mkdir()
    (tmp_path / "cache" / "data-0" / "part-0.parquet").write_bytes(b"half a fi")
    assert plans.cached(spark, folder, lambda: spark.range(5)).count() == 5
    assert plans.cached(spark, folder, lambda: 1 / 0).count() == 5


def test_replayed_label_batches_train_nothing_twice(spark, tmp_path):
    from dipscan.streaming import retraining

    folder, calls = f"file://{tmp_path}/labels", []

    def train(known, model):
        calls.append(known.count())
        if len(calls) == 2:
            raise RuntimeError("lost while training")
        return {"share": known.agg(F.avg("label")).first()[0]}

    each = retraining.on_labels(spark, folder, train, threshold=10)
    batch = lambda a, b: spark.createDataFrame([(i, i % 2) for i in range(a, b)], "id int, label int")
    each(batch(0, 6), 0)
    assert calls == []
    each(batch(4, 13), 1)  # three ids are labelled again
    each(batch(4, 13), 1)
    assert calls == [13]
    with pytest.raises(RuntimeError):
        each(batch(13, 21), 2)
    assert retraining.versions(spark, folder).count() == 1
    each(batch(13, 21), 2)  # the replay of a batch that broke off trains what is due
    each(batch(13, 21), 2)
    each(batch(0, 6), 0)
    assert calls == [13, 21, 21]
    assert [(r.version, r.batch, r.labels) for r in retraining.versions(spark, folder).orderBy("version").collect()] == [(1, 1, 13), (2, 2, 21)]
    each(batch(21, 55), 3)
    assert calls[-1] == 55 and retraining.versions(spark, folder).agg(F.max("version")).first()[0] == 5


def test_angles_are_taken_near_the_dip_only(monkeypatch):
    rng = np.random.default_rng(3)
    n, period, ar = 4000, np.array([2.0, 3.5, 5.0, 4.0]), np.array([7.0, 12.0, 1.1, 30.0])
    t, of = rng.uniform(-5, 5, n), np.sort(rng.integers(0, 4, n))
    x = np.array([[0.1, 0.3, 0.9], [-0.6, 0.005, 0.0], [0.0, 0.2, 0.5], [0.5, 0.3, 1.0]])
    z = fitting.separation(t, x[of, 0], period[of], ar[of], x[of, 2])
    seen, plain = [], fitting.separation
    monkeypatch.setattr(fitting, "separation", lambda t, *a: seen.append(len(t)) or plain(t, *a))
    got = fitting.curves_model(t, of, x, period, ar, 0.3)
    assert (got == fitting.transit_model(z, x[of, 1], rings=100)).all() and (got < 1).sum() > 100
    assert sum(seen) < 0.3 * n


def test_units_make_the_curves_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for pdf in frames:
            made.add(len(pdf))
            yield pdf

    rows = spark.range(60).select(F.col("id").cast("string").alias("tic_id")).mapInPandas(counted, "tic_id string")
    done = batches.in_units(rows, batches.shared_folder(spark, "once"), lambda r: r, rows.schema, units=5)
    assert made.value == 60 and sorted(int(r.tic_id) for r in done.collect()) == list(range(60))
