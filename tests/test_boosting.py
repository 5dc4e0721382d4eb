"""Leaf-wise growth and contributions against brute force."""

import heapq
import itertools
import math
import random

import numpy as np
import pytest

from dipscan.plans import boosting


def table(spark, n=600, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.randint(0, 9), rng.choice([None, *range(5)]), float("nan") if rng.random() < 0.05 else rng.randint(0, 3) / 2
        y = int((a > 5) ^ ((b or 0) > 2) if rng.random() > 0.1 else rng.random() > 0.5)
        rows.append((i, float(a), None if b is None else float(b), c, y, f"g{i % 30}"))
    return spark.createDataFrame(rows, "id int, a double, b double, c double, label int, grp string"), rows


def plain_tree(x, g, h, leaves, l2, least):
    """Best-first growth by trying every value of every feature; missing is below all."""
    def best(rows):
        found = (0.0, 0, 0.0)
        for j in range(x.shape[1]):
            for cut in sorted({x[r, j] for r in rows}):
                left = [r for r in rows if x[r, j] <= cut]
                right = [r for r in rows if x[r, j] > cut]
                if len(left) < least or len(right) < least:
                    continue
                score = lambda s: sum(g[r] for r in s) ** 2 / (sum(h[r] for r in s) + l2)
                gain = score(left) + score(right) - score(rows)
                if gain > found[0] + 1e-6:
                    found = (gain, j, cut)
        return found

    done, heap, k = [], [], itertools.count()
    start = list(range(len(x)))
    heapq.heappush(heap, (-best(start)[0], next(k), start, best(start)))
    size = 1
    while heap:
        gain, _, rows, (_, j, cut) = heapq.heappop(heap)
        if -gain <= 1e-6 or size >= leaves:
            done.append(rows)
            continue
        size += 1
        for part in ([r for r in rows if x[r, j] <= cut], [r for r in rows if x[r, j] > cut]):
            found = best(part)
            heapq.heappush(heap, (-found[0], next(k), part, found))
    return sorted((sorted(rows), -sum(g[r] for r in rows) / (sum(h[r] for r in rows) + l2)) for rows in done)


def test_trees_equal_plain_gains(spark):
    df, rows = table(spark)
    model = boosting.boosted(df.repartition(7), ["a", "b", "c"], trees=3, leaves=6, rate=0.3, l2=1.0, least=10, refresh=2)
    x = np.array([[-math.inf if v is None or math.isnan(v) else v for v in r[1:4]] for r in rows])
    raw = np.array([[math.nan if v is None else v for v in r[1:4]] for r in rows])
    y = np.array([r[4] for r in rows])
    margin = np.full(len(rows), math.log(y.mean() / (1 - y.mean())))
    assert len(model.trees) == 3
    for tree in model.trees:
        p = 1 / (1 + np.exp(-margin))
        want = plain_tree(x, p - y, p * (1 - p), 6, 1.0, 10)
        leaf = tree.leaf(model.bins(raw))
        got = sorted((sorted(np.flatnonzero(leaf == k).tolist()), tree.value[k]) for k in np.unique(leaf))
        assert [rows for rows, _ in got] == [rows for rows, _ in want]
        assert np.allclose([v for _, v in got], [v for _, v in want], atol=1e-6)
        assert 3 <= sum(f < 0 for f in tree.feature) <= 6
        margin += 0.3 * np.array(tree.value)[leaf]
    assert np.allclose(model.margin(model.bins(raw)), margin)


def test_layout_and_early_stop(spark):
    df, _ = table(spark, 1500)
    options = {"trees": 40, "leaves": 8, "least": 20, "group": "grp", "patience": 3, "rate": 0.5}
    one = boosting.boosted(df.coalesce(1), ["a", "b", "c"], **options)
    many = boosting.boosted(df.repartition(9), ["a", "b", "c"], **options)
    assert [t.value for t in one.trees] == [t.value for t in many.trees] and one.losses == many.losses
    assert 0 < len(one.trees) < 40 and len(one.trees) == int(np.argmin(one.losses))
    assert one.losses[len(one.trees)] < one.losses[0] - 0.1


def brute_shapley(tree, edges_model, x, features):
    """Values over all subsets; a feature that is left out follows both branches by their cover."""
    def expect(node, some):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        left, right = tree.left[node], tree.right[node]
        if f in some:
            return expect(left if x[f] <= tree.cut[node] else right, some)
        return (tree.cover[left] * expect(left, some) + tree.cover[right] * expect(right, some)) / tree.cover[node]

    out = []
    for i in range(features):
        others = [j for j in range(features) if j != i]
        total = 0.0
        for r in range(features):
            for some in itertools.combinations(others, r):
                weight = math.factorial(r) * math.factorial(features - r - 1) / math.factorial(features)
                total += weight * (expect(0, {*some, i}) - expect(0, set(some)))
        out.append(total)
    return out


def test_contributions_equal_all_subsets_and_add_up(spark):
    df, rows = table(spark)
    model = boosting.boosted(df, ["a", "b", "c"], trees=4, leaves=9, rate=0.4, least=5)
    got = {r.id: r for r in boosting.explained(model, df, "id").collect()}
    raw = np.array([[math.nan if v is None else v for v in r[1:4]] for r in rows])
    x = model.bins(raw)
    assert any(len({p[0] for p in path}) < len(path) or len(path) >= 2 for t in model.trees for _, path in boosting.leaf_paths(t))
    for i in range(0, len(rows), 17):
        want = np.sum([np.array(brute_shapley(t, model, x[i], 3)) * 0.4 for t in model.trees], axis=0)
        assert np.allclose(got[i].contributions, want, atol=1e-9)
    for r in got.values():
        assert math.isclose(r.expected + sum(r.contributions), r.margin, abs_tol=1e-9)
    ranks = boosting.attribution(model, df, "id").collect()
    assert [r["rank"] for r in ranks] == [1, 2, 3] and ranks[0].mean_abs >= ranks[1].mean_abs


@pytest.mark.parametrize("case", ["empty", "one class", "constant", "null labels"])
def test_odd_tables(spark, case):
    df, _ = table(spark, 80)
    df = {"empty": df.where("id < 0"), "one class": df.selectExpr("id", "a", "b", "c", "1 AS label"), "constant": df.selectExpr("id", "1.0D AS a", "CAST(NULL AS DOUBLE) AS b", "c * 0 AS c", "label"), "null labels": df.selectExpr("id", "a", "b", "c", "CASE WHEN id < 40 THEN label END AS label")}[case]
    model = boosting.boosted(df, ["a", "b", "c"], trees=2, leaves=4, least=5)
    assert all(np.isfinite(t.value).all() for t in model.trees)
    assert boosting.explained(model, df, "id").count() == df.count()
