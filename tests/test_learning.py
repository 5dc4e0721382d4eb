"""Stacking, permutation importance, the learning curve and the ensemble sampler."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dipscan import plans
from dipscan.operators import features, fitting
from dipscan.plans import stacking


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x, noise = rng.normal(size=600), rng.normal(size=600)
    y = (x + 0.5 * rng.normal(size=600) > 0).astype(int)
    data = [(i, f"g{i // 6}", float(x[i]), float(noise[i]), int(y[i])) for i in range(600)]
    return spark.createDataFrame(data, "doc_id bigint, grp string, x1 double, x2 double, label int").cache()


def test_stack_and_importance(spark, rows):
    train, test = plans.split_by_group(rows)
    assert train.select("grp").intersect(test.select("grp")).isEmpty()
    got = stacking.stacked(train, test, ["x1", "x2"], k=2, trees=5).select("doc_id", "label", "score").toPandas()
    assert len(got) == test.count()
    pos, neg = got.score[got.label == 1].to_numpy(), got.score[got.label == 0].to_numpy()
    assert (pos[:, None] > neg[None, :]).mean() > 0.85
    assert abs(got.score.mean() - got.label.mean()) < 0.15
    model = plans.fit_classifier(train, ["x1", "x2"], trees=5)
    drop = {r.feature: r.drop_mean for r in stacking.permutation_importance(model, test, ["x1", "x2"], "doc_id", repeats=2).collect()}
    assert drop["x1"] > 0.2 > abs(drop["x2"]) + 0.05


def test_learners_read_packed_rows_with_no_shuffle_behind_them(spark, rows, monkeypatch):
    seen, plain = [], stacking.learners

    class Seen:
        def __init__(self, learner):
            self.learner = learner

        def fit(self, df):
            seen.append((df.rdd.getNumPartitions(), df._jdf.queryExecution().executedPlan().toString()))
            return self.learner.fit(df)

    monkeypatch.setattr(stacking, "learners", lambda *a: {name: Seen(learner) for name, learner in plain(*a).items()})
    train, test = plans.split_by_group(rows)
    stacking.stacked(train, test, ["x1", "x2"], k=2, trees=2)
    assert len(seen) == 6 and all(parts == 1 and "Exchange" not in plan and "Join" not in plan for parts, plan in seen)


def test_balanced_weights(spark):
    made = plans.balanced(spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 4), (None, 5)], "label int, x int")).orderBy("x").collect()
    assert [(r.label, r.x, r.weight) for r in made] == [(0, 1, 4 / 6), (0, 2, 4 / 6), (0, 3, 4 / 6), (1, 4, 2.0)]


def test_folds_and_permutation(spark, rows):
    folds = stacking.with_folds(rows, 4)
    assert folds.count() == 600
    assert folds.groupBy("grp").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    mixed = stacking.permuted(rows, "x1", "doc_id", 1, rows_per_bucket=100).orderBy("doc_id").toPandas()
    plain = rows.orderBy("doc_id").toPandas()
    assert sorted(mixed.x1) == sorted(plain.x1) and (mixed.x1 != plain.x1).mean() > 0.9
    assert (mixed.x2 == plain.x2).all()


def test_learning_curve(spark, rows):
    train, test = plans.split_by_group(rows)
    got = stacking.learning_curve(train, test, ["x1", "x2"], shares=(0.3, 1.0), trees=5).orderBy("share").collect()
    assert got[0].n_train < got[1].n_train == train.count()
    assert all(r.auc > 0.8 for r in got)


def test_oversampling_lies_between_neighbours(spark):
    rng = np.random.default_rng(8)
    rows = [(i, 0, float(v), 1.0) for i, v in enumerate(rng.normal(0, 1, 60))] + [(100 + i, 1, 10.0 + i, None if i == 3 else 2.0) for i in range(7)] + [(200, 2, 50.0, 3.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, label int, x double, y double")
    made = plans.oversampled(df, ["x", "y"]).toPandas()
    assert made.groupby("label").size().to_dict() == {0: 60, 1: 60, 2: 60}
    new = made[made.synthetic]
    assert len(new) == 112 and new[new.label == 1].x.between(10, 16).all() and (new[new.label == 2].x == 50).all()
    assert len(set(new[new.label == 1].x.round(6))) > 40
    assert sorted(plans.oversampled(df, ["x", "y"]).toPandas().x) == sorted(made.x)
    assert plans.oversampled(df.where("false"), ["x", "y"]).count() == 0


def test_early_stop(spark, rows):
    train, test = plans.split_by_group(rows)
    model = plans.fit_classifier(train, ["x1", "x2"], trees=60, rate=0.5, rows=0.8, group="grp")
    assert model.stages[-1].getNumTrees < 60
    got = plans.scored(model, test).toPandas()
    assert (got[got.label == 1].score.mean() - got[got.label == 0].score.mean()) > 0.4


def test_run_needs_two_classes(spark, rows, tmp_path):
    with pytest.raises(ValueError, match="classes"):
        plans.train_run(rows.where("label = 1 OR grp = 'x'"), ["x1"], f"file://{tmp_path}/one")
    assert not (tmp_path / "one").exists()
    made = rows.unionByName(rows.limit(30).withColumn("grp", F.lit("SYN_1")))
    m = plans.train_run(made, ["x1", "x2"], f"file://{tmp_path}/two", trees=5).first()
    assert m.n_train + m.n_test == 630 and m.classes == 2 and m.auc > 0.8 and (tmp_path / "two" / "model").exists()


def test_walk_recovers_a_gaussian():
    rng = np.random.default_rng(1)
    chain, accepted = fitting.stretch_walk(lambda p: -0.5 * float(((p - [1, -2]) ** 2 / [1, 4]).sum()), rng.normal(size=(16, 2)), 1500, rng)
    flat = chain[300:].reshape(-1, 2)
    assert np.allclose(flat.mean(axis=0), [1, -2], atol=0.25) and np.allclose(flat.std(axis=0), [1, 2], rtol=0.15)
    assert 0.3 < accepted < 0.9 and 2 < fitting.autocorrelation_time(chain) < 60


def test_posterior_holds_the_truth(spark):
    rng = np.random.default_rng(2)
    t = np.sort(rng.uniform(0, 20, 1500))
    flux = fitting.transit_model(fitting.separation(t, 1.0, 4.0, np.exp(2.0), 0.2), 0.1) + rng.normal(0, 5e-4, len(t))
    rows = [("1", i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, flux))] + [("2", 0, 1.0, 1.0)]
    lc = spark.createDataFrame(rows, "tic_id string, event_id bigint, t double, flux double")
    lc = lc.withColumn("period", F.lit(4.0)).withColumn("t0", F.lit(1.01)).withColumn("dur", F.lit(0.2)).withColumn("ln_a", F.lit(2.0))
    got = fitting.sampled(lc, walkers=16, steps=100, longest=200, keep=500).toPandas()
    assert set(got.tic_id) == {"1"} and len(got) == 500
    assert abs(got.tc.median() - 1.0) < 0.01 and abs(got.rp_rs.median() - 0.1) < 0.005


def test_derived_without_star(spark):
    row = spark.createDataFrame([(4.0, 0.1, 0.0, 10.0, 0.001, 0, None, None)], "period double, rp_rs double, b double, a_rs double, sigma double, n_in int, rad double, teff double")
    got = features.derived_parameters(row).first()
    assert got.inc_deg == pytest.approx(90) and got.depth_ppm == pytest.approx(1e4) and got.fit_snr == pytest.approx(10)
    assert got.t14_hr == pytest.approx(4 / np.pi * np.arcsin(0.11) * 24) and got.a_au is None and got.in_hz is None


def test_text_features_are_read_from_a_small_table(spark):
    from dipscan import queries

    train, test, columns = queries._text_features(spark, "/root/testdata/sf0.001")
    assert train.count() and test.count() and set(columns) < set(train.columns)
    assert not any("documents" in f for df in (train, test) for f in df.inputFiles())
    assert not {r.grp for r in train.collect()} & {r.grp for r in test.collect()}
