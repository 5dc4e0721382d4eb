"""Boosted trees grown leaf by leaf on histograms, and the shares that features have in their margins.

Values become bins once (one row of quantiles reaches the driver).  A tree grows
best first: the leaf whose split gains most is split next, until ``leaves`` are
reached.  Gains come from sums of first and second derivatives for each (leaf, feature, bin),
made in Arrow blocks and merged by partial aggregation; what the driver
holds is ``leaves x features x 256`` sums whatever the rows.  A pass over the
rows serves all leaves that best-first growth could ask for next, so a tree takes about
as many passes as it has levels.  Sums are integers (2**-24), so a model does not depend on partitions.

Contributions are Shapley values over the features where a feature that is left out
follows both branches by their share of training rows.  Along a leaf's path
only the pattern of passed conditions matters, so each pattern is worked out once and rows look it up.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import written

BINS = 255  # of values; bin 0 is for missing ones
CELLS = BINS + 1
ONE = 1 << 24
MODEL_BYTES = 32 << 20  # of trees that go to every task


@dataclass
class Tree:
    """Node i sends bins up to ``cut[i]`` of ``feature[i]`` to ``left[i]``; a leaf has feature -1."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for column, v in zip((self.feature, self.cut, self.left, self.right, self.value, self.cover), (-1, 0, -1, -1, value, cover)):
            column.append(v)
        return len(self.value) - 1

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, cut, left, right = (np.array(c) for c in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            at[inner] = np.where(x[inner, feature[node]] <= cut[node], left[node], right[node])


@dataclass
class Boosted:
    features: list[str]
    edges: list[np.ndarray]
    base: float
    rate: float
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)  # of the judging rows, before each tree

    def bins(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(values.shape, dtype=np.uint8)
        for j, edges in enumerate(self.edges):
            known = ~np.isnan(values[:, j])
            out[known, j] = 1 + np.searchsorted(edges, values[known, j], side="left")
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for tree in self.trees:
            total += self.rate * np.array(tree.value)[tree.leaf(x)]
        return total


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of the bins but the last: distinct quantiles; a value equal to an end lies below it."""
    shares = F.lit([k / bins for k in range(1, bins)])
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    row = df.agg(*[F.percentile_approx(value(c), shares, 20_000).alias(f"q{j}") for j, c in enumerate(features)]).first()
    return [np.unique(np.array(row[f"q{j}"] or [], dtype=float)) for j in range(len(features))]


def _matrix(batch: pa.RecordBatch, columns: list[int]) -> np.ndarray:
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in columns], axis=1) if columns else np.zeros((batch.num_rows, 0))


def _binned(model: Boosted):
    n = len(model.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.bins(_matrix(batch, list(range(n))))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), *batch.columns[n:], pa.array(np.full(len(x), model.base))], names=["x", "y", "w", "judges", "margin"])

    return run


def _block(batch: pa.RecordBatch, n: int, trees: list[Tree], rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, n)
    y, w, margin = (batch.column(i).to_numpy() for i in (1, 2, 4))
    margin = margin.copy()
    for tree in trees:
        margin += rate * np.array(tree.value)[tree.leaf(x)]
    return x, y, w, batch.column(3).to_numpy(zero_copy_only=False), margin


def _histograms(n: int, trees: list[Tree], rate: float, growing: Tree, wanted: list[int]):
    """Sums (cell, g, h, n) of the wanted leaves of the growing tree; cell -1 has the loss of the judging rows."""
    slot = np.full(len(growing.value), -1)
    slot[wanted] = np.arange(len(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, len(wanted), n, CELLS))
        loss, judged = 0, 0
        for batch in batches:
            x, y, w, judges, margin = _block(batch, n, trees, rate)
            one = np.where(y > 0, margin, -margin)
            loss += int(np.rint(w[judges] * np.logaddexp(0, -one[judges]) * ONE).sum())
            judged += int(judges.sum())
            p = 1 / (1 + np.exp(-margin))
            at = slot[growing.leaf(x)]
            keep = (at >= 0) & ~judges
            at, x = at[keep], x[keep]
            g, h = np.rint(((p - y) * w)[keep] * ONE), np.rint((p * (1 - p) * w)[keep] * ONE)
            for j in range(n):
                cell = at * CELLS + x[:, j]
                for k, weight in enumerate((g, h, None)):
                    sums[k, :, j] += np.bincount(cell, weight, len(wanted) * CELLS).reshape(-1, CELLS)
        flat = sums.reshape(3, -1)
        some = np.flatnonzero(flat[2])
        columns = [np.append(some, -1), *[np.append(flat[k][some], v) for k, v in enumerate((loss, 0, judged))]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["cell", "g", "h", "n"])

    return run


def best_split(sums: np.ndarray, l2: float, least: int) -> tuple[float, int, int] | None:
    """(gain, feature, cut) of a leaf with sums[g, h, n][feature, bin]; ties to the lower feature and cut."""
    below = sums.cumsum(axis=2)
    whole = below[:, :, -1:]
    (gl, hl, nl), (gr, hr, nr) = below, whole - below
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl ** 2 / (hl + l2) + gr ** 2 / (hr + l2) - whole[0] ** 2 / (whole[1] + l2)
    gain = np.where((nl >= least) & (nr >= least), np.round(gain, 9), 0.0)
    j, cut = divmod(int(gain.argmax()), sums.shape[2])
    return (float(gain[j, cut]), j, cut) if gain[j, cut] > 1e-9 else None


def _grown(rows: DataFrame, model: Boosted, recent: list[Tree], leaves: int, l2: float, least: int) -> tuple[Tree, float | None]:
    """One tree, grown best first, and the judging rows' mean loss before it."""
    n = len(model.features)
    tree = Tree()
    tree.add(0.0, 0.0)
    known: dict[int, tuple[float, int, int] | None] = {}
    children: dict[int, tuple[int, int]] = {}
    loss = None
    wanted = [0]
    while wanted:
        found = rows.mapInArrow(_histograms(n, recent, model.rate, tree, wanted), "cell bigint, g bigint, h bigint, n bigint")
        found = found.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")]).toArrow()
        cell, g, h, count = (found[c].to_numpy() for c in ("cell", "g", "h", "n"))
        last = cell == -1
        if loss is None and count[last].sum():
            loss = float(g[last].sum() / ONE / count[last].sum())
        sums = np.zeros((3, len(wanted) * n * CELLS))
        for k, v in enumerate((g / ONE, h / ONE, count)):
            sums[k][cell[~last]] = v[~last]
        sums = sums.reshape(3, len(wanted), n, CELLS)
        for i, node in enumerate(wanted):
            g0, h0, n0 = sums[:, i, 0].sum(axis=1)
            tree.value[node], tree.cover[node] = float(-g0 / (h0 + l2)) if h0 + l2 > 0 else 0.0, float(n0)
            known[node] = best_split(sums[:, i], l2, least)
        # best first over what is known; a split whose children are new makes them wanted
        wanted, size, heap = [], 1, []
        if known[0]:
            heapq.heappush(heap, (-known[0][0], 0))
        while heap and size < leaves:
            _, node = heapq.heappop(heap)
            size += 1
            if node not in children:
                gain, tree.feature[node], tree.cut[node] = known[node]
                children[node] = tree.left[node], tree.right[node] = tree.add(0.0, 0.0), tree.add(0.0, 0.0)
                wanted += children[node]
            for child in children[node]:
                if known.get(child):
                    heapq.heappush(heap, (-known[child][0], child))
    return _pruned(tree, known, children, leaves), loss


def _pruned(tree: Tree, known: dict, children: dict, leaves: int) -> Tree:
    """The tree that best-first growth gives; nodes that were looked at ahead of it go."""
    kept, size, heap = set(), 1, [(-known[0][0], 0)] if known[0] else []
    while heap and size < leaves:
        _, node = heapq.heappop(heap)
        kept.add(node)
        size += 1
        for child in children[node]:
            if known.get(child):
                heapq.heappush(heap, (-known[child][0], child))
    out = Tree()

    def copy(node: int) -> int:
        at = out.add(tree.value[node], tree.cover[node])
        if node in kept:
            out.feature[at], out.cut[at] = tree.feature[node], tree.cut[node]
            out.left[at] = copy(tree.left[node])
            out.right[at] = copy(tree.right[node])
        return at

    copy(0)
    return out


def boosted(df: DataFrame, features: list[str], label: str = "label", weight: str | None = None, group: str | None = None, trees: int = 100, leaves: int = 63, rate: float = 0.1, l2: float = 1.0, least: int = 20, patience: int = 10, refresh: int = 10) -> Boosted:
    """Leaf-wise boosting of the log-odds of ``label`` (0 or 1; null labels are left out).

    With ``group`` about a tenth of the groups, by hash, only judges; growth stops when
    their loss has not fallen for ``patience`` trees, and the trees after the best go.
    Null and NaN values are missing and lie below all others.  Margins are
    written every ``refresh`` trees, so a pass adds up that many at most.
    """
    rows = df.where(F.col(label).isNotNull())
    judges = F.coalesce(F.pmod(F.xxhash64(group), F.lit(10)) == 0, F.lit(False)) if group else F.lit(False)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = rows.select(*[F.col(c).cast("double").alias(f"f{j}") for j, c in enumerate(features)], F.col(label).cast("double").alias("y"), w.alias("w"), judges.alias("judges"))
    names = [f"f{j}" for j in range(len(features))]
    share = rows.where("NOT judges").agg(F.sum(F.col("y") * F.col("w")), F.sum("w")).first()
    p = min(max((share[0] or 0.0) / (share[1] or 1.0), 1e-6), 1 - 1e-6)
    model = Boosted(list(features), bin_edges(rows.where("NOT judges"), names), float(np.log(p / (1 - p))), rate)
    table = "x binary, y double, w double, judges boolean, margin double"
    rows = written(rows.mapInArrow(_binned(model), table), "binned")
    recent: list[Tree] = []
    for _ in range(trees):
        tree, loss = _grown(rows, model, recent, leaves, l2, least)
        if loss is not None:
            model.losses.append(loss)
            if len(model.losses) - 1 - int(np.argmin(model.losses)) >= patience:
                break
        if tree.feature[0] < 0:
            break
        model.trees.append(tree)
        recent.append(tree)
        if len(recent) == refresh:
            rows = written(rows.mapInArrow(_moved(len(features), recent, rate), table), "margins")
            recent = []
    if model.losses:
        del model.trees[int(np.argmin(model.losses)):]
    return model


def _moved(n: int, trees: list[Tree], rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = _block(batch, n, trees, rate)[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(margin)], names=["x", "y", "w", "judges", "margin"])

    return run


# -- files --------------------------------------------------------------------

_TREES = "place int, feature array<int>, cut array<int>, left array<int>, right array<int>, value array<double>, cover array<double>"
_HEAD = "features array<string>, edges array<array<double>>, base double, rate double, losses array<double>"


def save(model: Boosted, folder: str, spark: SparkSession) -> None:
    """Writes the model below ``folder``: one row for each tree, and one for the rest."""
    rows = [(k, t.feature, t.cut, t.left, t.right, t.value, t.cover) for k, t in enumerate(model.trees)]
    spark.createDataFrame(rows, _TREES).write.mode("overwrite").parquet(f"{folder}/trees")
    head = [(model.features, [e.tolist() for e in model.edges], model.base, model.rate, model.losses)]
    spark.createDataFrame(head, _HEAD).write.mode("overwrite").parquet(f"{folder}/model")


def load(folder: str, spark: SparkSession) -> Boosted:
    head = spark.read.schema(_HEAD).parquet(f"{folder}/model").first()
    trees = spark.read.schema(_TREES).parquet(f"{folder}/trees").orderBy("place").collect()  # the model's own size
    return Boosted(head.features, [np.array(e, dtype=float) for e in head.edges], head.base, head.rate, [Tree(*map(list, t[1:])) for t in trees], head.losses)


# -- contributions ------------------------------------------------------------


def leaf_paths(tree: Tree) -> list[tuple[float, list[tuple[int, int, int, float]]]]:
    """(value, [(feature, first bin, last bin, share of rows that pass)]) of every leaf; a feature stands once."""
    out = []

    def walk(node: int, path: dict[int, tuple[int, int, float]]) -> None:
        if tree.feature[node] < 0:
            out.append((tree.value[node], [(f, *v) for f, v in path.items()]))
            return
        f, cut = tree.feature[node], tree.cut[node]
        low, high, share = path.get(f, (0, CELLS - 1, 1.0))
        for child, span in ((tree.left[node], (low, min(high, cut))), (tree.right[node], (max(low, cut + 1), high))):
            walk(child, path | {f: (*span, share * tree.cover[child] / tree.cover[node])})

    walk(0, {})
    return out


def _shares(passed: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Shapley values of the conditions of a path, for patterns of passed ones (rows); the leaf has value 1."""
    n, m = passed.shape
    out = np.zeros((n, m))
    for i in range(m):
        by_size = np.zeros((n, m))
        by_size[:, 0] = 1.0
        for k, j in enumerate(j for j in range(m) if j != i):
            grown = by_size[:, : k + 1] * passed[:, j: j + 1]
            by_size[:, : k + 1] *= z[j]
            by_size[:, 1: k + 2] += grown
        weight = np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)])
        out[:, i] = (passed[:, i] - z[i]) * (by_size @ weight)
    return out


def contributions(model: Boosted, x: np.ndarray, paths: list | None = None) -> tuple[float, np.ndarray]:
    """(expected margin, values[row, feature]) for rows of bins; with the expectation they add up to the margin."""
    paths = [leaf_paths(t) for t in model.trees] if paths is None else paths
    expected, out = model.base, np.zeros((len(x), len(model.features)))
    for leaves in paths:
        for value, path in leaves:
            z = np.array([p[3] for p in path])
            expected += model.rate * value * float(z.prod()) if path else model.rate * value
            if not path:
                continue
            mask = np.zeros(len(x), dtype=np.int64)
            for k, (f, low, high, _) in enumerate(path):
                mask |= ((x[:, f] >= low) & (x[:, f] <= high)).astype(np.int64) << k
            seen, at = np.unique(mask, return_inverse=True)
            share = _shares(((seen[:, None] >> np.arange(len(path))) & 1).astype(float), z)
            for k, (f, *_) in enumerate(path):
                out[:, f] += model.rate * value * share[at, k]
    return expected, out


def explained(model: Boosted, df: DataFrame, key: str) -> DataFrame:
    """(key, margin, expected, contributions[feature]) of every row.

    The trees go to the tasks if they are small (``MODEL_BYTES``); a larger model raises.
    """
    size = sum(40 * len(t.value) for t in model.trees)
    if size > MODEL_BYTES:
        raise ValueError(f"{size} bytes of trees, {MODEL_BYTES} may go to every task")
    n = len(model.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = [leaf_paths(t) for t in model.trees]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = model.bins(_matrix(part, list(range(1, n + 1))))
                expected, values = contributions(model, x, paths)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * n, pa.int32()), pa.array(values.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.margin(x)), pa.array(np.full(len(x), expected)), lists], names=["key", "margin", "expected", "contributions"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(f"f{j}") for j, c in enumerate(model.features)])
    return rows.mapInArrow(run, f"key {kind}, margin double, expected double, contributions array<double>").withColumnRenamed("key", key)


def attribution(model: Boosted, df: DataFrame, key: str, top: int = 15) -> DataFrame:
    """(feature, mean_abs, rank): mean size of the contributions, largest first."""
    rows = explained(model, df, key)
    means = rows.agg(*[F.avg(F.abs(F.col("contributions")[j])).alias(f"m{j}") for j in range(len(model.features))])
    named = means.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{j}").alias("mean_abs")) for j, c in enumerate(model.features)])))
    best = sorted(named.collect(), key=lambda r: (-(r.mean_abs or 0.0), r.feature))[:top]  # a row for each feature
    return df.sparkSession.createDataFrame([(r.feature, r.mean_abs, k + 1) for k, r in enumerate(best)], "feature string, mean_abs double, rank int")
