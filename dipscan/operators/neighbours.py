"""Exact nearest neighbours of every row, without all pairs.

A bounded sample of distinct rows is split into boxes, at its median along the widest side,
so that a box holds about ``BOX`` rows whatever the table has.  Rows meet their own
box first, which bounds how far their k-th neighbour can be; only to the other boxes within that
distance do they go as well.  A box's rows are compared with the queries in blocks.  Equal
rows stand together once with their ids' number, so groups of copies are not compared pair by pair.
In many dimensions most boxes lie within reach, and the work grows towards all pairs; memory does not.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import spread, written

BOX = 500  # distinct rows of a box, as long as there are not more boxes than BOXES
BOXES, SAMPLED = 8_192, 16  # at most; rows of the sample for each box, which reach the driver
BLOCK = 250_000  # distances that a task holds at once
SLACK = 1e-9


def _points(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def boxes(points: np.ndarray, least: int) -> tuple[list[tuple[int, float, int, int]], np.ndarray, np.ndarray]:
    """(splits, low, high): a tree of splits (side, cut, below, from), negative numbers -1 - box, and the bounds of each box.

    A part of ``2 * least`` points and more is cut along its widest side; rows on the cut lie above.
    """
    splits, low, high = [], [], []
    dims = points.shape[1]

    def part(some: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> int:
        if len(some) >= 2 * least:
            for side in np.argsort(-np.ptp(some, axis=0), kind="stable"):
                x = np.sort(some[:, side])
                cut = x[len(x) // 2]
                if cut == x[0]:  # half are the smallest
                    above = x[x > cut]
                    if not len(above):
                        continue
                    cut = above[0]
                at = len(splits)
                splits.append(None)
                under, over = hi.copy(), lo.copy()
                under[side] = over[side] = cut
                far = some[:, side] >= cut
                splits[at] = (int(side), float(cut), part(some[~far], lo, under), part(some[far], over, hi))
                return at
        low.append(lo)
        high.append(hi)
        return -len(low)

    part(points, np.full(dims, -np.inf), np.full(dims, np.inf))
    return splits, np.array(low), np.array(high)


def _box_of(splits: list[tuple[int, float, int, int]], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), dtype=np.int32)
    todo = [(0, np.arange(len(x)))] if splits else []
    while todo:
        at, rows = todo.pop()
        side, cut, under, over = splits[at]
        far = x[rows, side] >= cut
        for to, some in ((under, rows[~far]), (over, rows[far])):
            if to < 0:
                out[some] = -1 - to
            elif len(some):
                todo.append((to, some))
    return out


def _within(splits: list[tuple[int, float, int, int]], low: np.ndarray, high: np.ndarray, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, boxes): every box that has a place within ``reach`` of the row."""
    rows, found = [], []
    todo = [(0 if splits else -1, np.arange(len(x)))]
    while todo:
        at, some = todo.pop()
        if at < 0:
            gap = np.maximum(0, np.maximum(low[-1 - at] - x[some], x[some] - high[-1 - at]))
            some = some[np.sqrt((gap * gap).sum(axis=1)) <= reach[some]]
            rows.append(some)
            found.append(np.full(len(some), -1 - at, dtype=np.int32))
            continue
        side, cut, under, over = splits[at]
        for to, part in ((under, some[x[some, side] - reach[some] <= cut]), (over, some[x[some, side] + reach[some] >= cut])):
            if len(part):
                todo.append((to, part))
    return np.concatenate(rows), np.concatenate(found)


def nearest(df: DataFrame, features: Sequence[str], k: int, id_col: str = "id", pivots: int = SAMPLED, block: int = BOX, seed: int = 42) -> DataFrame:
    """(id, place, neighbour, distance): the k nearest other rows by Euclidean distance, in order.

    Ties go to the smaller id.  Null, NaN or infinite features leave a row out; a table with fewer
    than k other rows gives what there is.  Ids are unique.  A box holds about ``block`` distinct rows and ``pivots`` of the sample.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    rows = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    kind = df.schema[id_col].dataType.simpleString()
    points = written(_folded(rows, k), "points")
    n = points.count()
    if not n:
        return spark.createDataFrame([], f"id {kind}, place int, neighbour {kind}, distance double")
    least = max(pivots, 2 * (k + 1))
    wanted = min(BOXES, -(-n // block)) * least
    draw = F.xxhash64(F.lit(seed), "x")
    some = points if n <= wanted else points.where(F.pmod(draw, F.lit(1 << 30)) < int((1 << 30) * min(1.0, wanted / n)))
    some = some.select("x").limit(2 * BOXES * least).toArrow()["x"].combine_chunks()
    tree = boxes(_points(some), least if n > wanted else max(least, block // 2)) if len(some) else ([], np.full((1, len(features)), -np.inf), np.full((1, len(features)), np.inf))
    shared = spark.sparkContext.broadcast(tree)
    lists = f"array<struct<distance:double,neighbour:{kind}>>"
    placed = spread(points.mapInArrow(_placed(shared), f"x array<double>, ids array<{kind}>, box int"), "box")
    stored = written(placed.sortWithinPartitions("box").mapInArrow(_own(k, kind), f"x array<double>, ids array<{kind}>, box int, near {lists}"), "boxes")
    stand = stored.select("box", F.lit(0).alias("side"), "x", "ids", F.lit(None).cast("double").alias("reach"))
    asked = stored.select("x", "box", F.when(F.size("near") > k, F.element_at("near", -1)["distance"]).otherwise(float("inf")).alias("reach"))
    asked = asked.mapInArrow(_asked(shared), "box int, side int, x array<double>, reach double").select("box", "side", "x", F.lit(None).cast(f"array<{kind}>").alias("ids"), "reach")
    met = spread(stand.join(asked.select("box").distinct(), "box", "left_semi").unionByName(asked), "box").sortWithinPartitions("box", "side")
    more = met.mapInArrow(_met(k, kind), f"x array<double>, near {lists}")
    best = stored.select("x", "near").unionByName(more).groupBy("x").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    found = rows.join(best, "x").select("id", F.filter("near", lambda v: v.neighbour != F.col("id")).alias("near"))
    found = found.select("id", F.posexplode(F.slice("near", 1, k)).alias("place", "v"))
    return found.select("id", (F.col("place") + 1).alias("place"), F.col("v.neighbour").alias("neighbour"), F.col("v.distance").alias("distance"))


def _folded(rows: DataFrame, k: int) -> DataFrame:
    """(x, n, ids): distinct rows, their number and their k + 1 smallest ids; ranks are cut in the tasks before rows move."""
    place = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    few = rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return rows.groupBy("x").agg(F.count("*").alias("n")).join(few, "x").select("x", "n", "ids")


def _placed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            yield pa.RecordBatch.from_arrays([x, batch.column("ids"), pa.array(_box_of(shared.value[0], _points(x)))], names=["x", "ids", "box"])

    return run


def _asked(shared):
    """Rows once for every other box within reach of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                reach = part.column("reach").to_numpy()
                row, box = _within(*shared.value, _points(part.column("x")), reach * (1 + SLACK) + SLACK)
                other = box != part.column("box").to_numpy()[row]
                row, box = row[other], box[other]
                yield pa.RecordBatch.from_arrays([pa.array(box), pa.array(np.ones(len(row), np.int32)), part.column("x").take(pa.array(row)), pa.array(reach[row])], names=["box", "side", "x", "reach"])

    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Slices of one box and side (0 without that column); both come sorted."""
    for batch in batches:
        box = batch.column("box").to_numpy()
        side = batch.column("side").to_numpy() if "side" in batch.schema.names else np.zeros_like(box)
        edge = np.append(np.flatnonzero(np.append(True, (box[1:] != box[:-1]) | (side[1:] != side[:-1]))), len(box)) if len(box) else []
        for lo, hi in zip(edge[:-1], edge[1:]):
            yield (int(box[lo]), int(side[lo])), batch.slice(lo, hi - lo)


def _lists(asked: np.ndarray, stand: np.ndarray, ids: list[list], k: int, reach: np.ndarray | None = None) -> Iterator[list[dict]]:
    """Of each asked row the ``k + 1`` nearest ids among ``stand``, within ``reach``; as (distance, id)."""
    block = max(1, BLOCK // max(1, len(stand)))
    for lo in range(0, len(asked), block):
        x = asked[lo: lo + block]
        d = np.zeros((len(x), len(stand)))
        for j in range(stand.shape[1]):
            gap = x[:, j, None] - stand[None, :, j]
            d += gap * gap
        d = np.sqrt(d)
        last = np.partition(d, k, axis=1)[:, k] if d.shape[1] > k + 1 else np.full(len(x), np.inf)
        if reach is not None:
            last = np.minimum(last, reach[lo: lo + block])
        row, at = np.nonzero(d <= last[:, None])
        near: list[list] = [[] for _ in x]
        for q, j, far in zip(row.tolist(), at.tolist(), d[row, at].tolist()):
            near[q] += [(far, i) for i in ids[j]]
        for found in near:
            yield [{"distance": far, "neighbour": i} for far, i in sorted(found)[: k + 1]]


def _near_type_of(kind: str) -> pa.DataType:
    return pa.list_(pa.struct([("distance", pa.float64()), ("neighbour", pa.type_for_alias({"bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8"}.get(kind, kind)))]))


def _own(k: int, kind: str):
    """Rows with their nearest ids inside their own box, themselves among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near_type = _near_type_of(kind)
        for _, parts in itertools.groupby(_parts(batches), key=lambda p: p[0][0]):
            whole = pa.Table.from_batches([p for _, p in parts]).combine_chunks()
            x, ids = _points(whole["x"].combine_chunks()), whole["ids"].to_pylist()
            lists = _lists(x, x, ids, k)
            for lo in range(0, len(x), 1_000):
                part = whole.slice(lo, 1_000).to_batches()[0]
                yield pa.RecordBatch.from_arrays([part.column("x"), part.column("ids"), part.column("box"), pa.array(list(itertools.islice(lists, part.num_rows)), near_type)], names=["x", "ids", "box", "near"])

    return run


def _met(k: int, kind: str):
    """Boxes, their rows before those that ask, to the asking rows' nearest ids in the box."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near_type, at, held, x, ids = _near_type_of(kind), -1, [], None, []
        for (box, side), part in _parts(batches):
            if box != at:
                at, held, x = box, [], None
            if not side:
                held.append(part)
                continue
            if x is None:
                if not held:
                    continue
                whole = pa.Table.from_batches(held).combine_chunks()
                x, ids = _points(whole["x"].combine_chunks()), whole["ids"].to_pylist()
            lists = list(_lists(_points(part.column("x")), x, ids, k, part.column("reach").to_numpy() * (1 + SLACK) + SLACK))
            yield pa.RecordBatch.from_arrays([part.column("x"), pa.array(lists, near_type)], names=["x", "near"])

    return run


# -- cells around pivots, which boxes have replaced; kept for the test that holds them


def _from_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x[:, None, :] - pivots[None]) ** 2).sum(axis=2), 0))


def _candidates(centres: np.ndarray, radius: np.ndarray, reach: np.ndarray, blocks: np.ndarray):
    """Each row once for every block of every cell that it can matter to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1_000):
                part = batch.slice(lo, 1_000)
                d = _from_pivots(_points(part.column(0)), centres)
                limit = (radius + reach) * (1 + SLACK) + SLACK
                row, cell = np.nonzero((d <= limit) & (blocks > 0))
                n = blocks[cell]
                row, cell = np.repeat(row, n), np.repeat(cell, n)
                block = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                for at in range(0, len(row), 5_000):
                    some = slice(at, at + 5_000)
                    rows = part.take(pa.array(row[some]))
                    yield pa.RecordBatch.from_arrays([pa.array(cell[some].astype(np.int32)), pa.array(block[some].astype(np.int32)), pa.array(np.ones(len(row[some]), np.int32)), *rows.columns[:3]], names=["cell", "block", "side", "x", "n", "ids"])

    return run
