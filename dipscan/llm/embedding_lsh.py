"""Operator 7: near-duplicate vectors by Euclidean p-stable hashing.

Vectors are normalised, so cosine ``c`` is a distance of ``sqrt(2 - 2c)``.  A
table's bucket is a row of quantised projections ``floor((a.x + b) / w)`` with
Gaussian ``a``; every vector is in one bucket of every table.  The number of
projections grows with the logarithm of the number of vectors, so a bucket holds
about ``MATES`` unrelated ones at any size, and the number of tables is what
``RECALL`` at the threshold then needs.

1.  *Buckets.*  Each vector goes to its buckets as a sketch of four bits a component with
    the length of what the sketch leaves out.  By the triangle inequality that
    bounds every cosine from above; vectors without a possible partner end here.
2.  *Comparison.*  The others meet again as whole vectors and are compared exactly, in
    double precision.  A pair that meets in several tables counts in the first of
    them, which the vectors themselves tell.  A task returns each vector's number of
    links and the smallest vector it reaches in the bucket, never the pairs.

Equal vectors are one class.  A bucket with more than ``BLOCK`` members is cut
into blocks, and each pair of blocks is a task group of its own, so no group is
larger than ``2 * BLOCK`` and no pair is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .shared import connected_components, width, written

WIDTH, SEED = 2.0, 7
MATES, RECALL = 10, 0.94
BLOCK, SMALL = 1024, 64
LISTED_CROWDS = 100_000  # buckets above BLOCK whose sizes are broadcast; more are joined
STEP = 0.335  # of a sketch, in root mean squares of a unit vector's components


def collision(distance: float) -> float:
    """Chance that one quantised projection of two vectors at this distance is the same."""
    r = WIDTH / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float) -> tuple[int, int]:
    """(tables, projections) for n vectors; recall by the formula at the threshold is RECALL at least."""
    near, far = collision(math.sqrt(max(1e-9, 2 - 2 * cosine))), collision(math.sqrt(2))
    projections = max(6, round(math.log(max(1, n / MATES)) / -math.log(far)))
    return max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - near ** projections))), projections


def hash_rows(unit: np.ndarray, tables: int, projections: int) -> np.ndarray:
    """int64[n, tables]: the bucket of every vector in every table; a bucket's number tells its table."""
    rng = np.random.default_rng(SEED)
    a = rng.standard_normal((unit.shape[1], tables * projections))
    b = rng.uniform(0, WIDTH, tables * projections)
    cell = np.floor((unit @ a + b) / WIDTH).astype(np.int64).reshape(len(unit), tables, projections)
    out = np.broadcast_to(np.arange(tables, dtype=np.uint64) * np.uint64(0x10001) + np.uint64(unit.shape[1] << 32), cell.shape[:2]).copy()
    for j in range(projections):
        out = tb.mix(out * np.uint64(0x9E3779B97F4A7C15) + (cell[:, :, j] + 1024).astype(np.uint64))
    return out.view(np.int64)


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, float64 vectors as rows) of a list column, one length after the other."""
    size = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.append(0, np.cumsum(size))[:-1]
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield rows, values[start[rows][:, None] + np.arange(dim)]


def normalised(x: np.ndarray) -> np.ndarray:
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def sketches(unit: np.ndarray) -> list[bytes]:
    """Length of the residual (float32, rounded up), then four bits a component."""
    n, dim = unit.shape
    step = STEP / math.sqrt(dim)
    q = np.clip(np.rint(unit / step), -7, 7)
    left = np.nextafter(np.linalg.norm(unit - q * step, axis=1).astype("<f4"), np.float32(np.inf))
    code = np.zeros((n, dim + dim % 2), dtype=np.uint8)
    code[:, :dim] = q + 8
    packed = code[:, ::2] << 4 | code[:, 1::2]
    return [a.tobytes() + b.tobytes() for a, b in zip(left, packed)]


def _unsketched(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(approximate vectors, their lengths, lengths of the residuals); all have one length."""
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    left = data[:, :4].copy().view("<f4").reshape(-1)
    code = np.empty((len(data), 2 * (data.shape[1] - 4)), dtype=np.uint8)
    code[:, ::2], code[:, 1::2] = data[:, 4:] >> 4, data[:, 4:] & 15
    dim = code.shape[1] - int((code[:, -1] == 0).all())  # 0 only pads
    q = (code[:, :dim].astype(np.float32) - 8) * np.float32(STEP / math.sqrt(dim))
    return q, np.linalg.norm(q, axis=1), left


def _hashed(tables: int, projections: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrices(batch.column(1)):
                for at in range(0, len(rows), 2_000):
                    unit = normalised(x[at: at + 2_000])
                    h = hash_rows(unit, tables, projections)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1) * tables, pa.int32()), pa.array(h.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[at: at + 2_000])), lists, pa.array(sketches(unit), pa.binary())], names=["rep", "h", "sketch"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, start of each group and the end) of whole groups; batches come sorted by (key, part)."""
    def cuts(t: pa.Table) -> np.ndarray:
        key, part = (t[c].to_numpy() for c in ("key", "part"))
        return np.append(0, np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1)

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        at = cuts(held)
        if len(at) > 1:
            yield held.slice(0, at[-1]).combine_chunks(), at
            held = held.slice(at[-1])
    if held is not None:
        yield held.combine_chunks(), np.append(cuts(held), held.num_rows)


def _screened(cosine: float):
    """Members of buckets to those that may have a partner in their group."""
    least = np.float32(cosine - 1e-5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in _groups(batches):
            size = np.diff(at)
            found = np.zeros(table.num_rows, dtype=bool)
            side = table["side"].to_numpy()
            split = table["part"].to_numpy()[at[:-1]] % (1 << 32) != table["part"].to_numpy()[at[:-1]] >> 32
            sketch = table["sketch"].chunk(0)
            length = pa.compute.binary_length(sketch).to_numpy()
            small = np.flatnonzero((size > 1) & (size <= SMALL) & ~split)
            for dim in np.unique(length[at[small]]):
                # all pairs of many small groups at once
                some = small[length[at[small]] == dim]
                for lo in range(0, len(some), 2_000):
                    part = some[lo: lo + 2_000]
                    rows = np.concatenate([np.arange(a, a + n) for a, n in zip(at[part], size[part])])
                    q, norm, left = _unsketched(sketch.take(pa.array(rows)))
                    i, j = _pairs(np.append(0, np.cumsum(size[part]))[:-1], size[part])
                    for p in range(0, len(i), 200_000):
                        x, y = i[p: p + 200_000], j[p: p + 200_000]
                        top = np.einsum("ij,ij->i", q[x], q[y]) + left[x] * norm[y] + left[y] * norm[x] + left[x] * left[y]
                        hit = top >= least
                        found[rows[x[hit]]] = True
                        found[rows[y[hit]]] = True
            for g in np.flatnonzero((size > SMALL) | (split & (size > 1))):
                rows = np.arange(at[g], at[g + 1])
                q, norm, left = _unsketched(sketch.slice(at[g], size[g]))
                for lo in range(0, len(rows), 512):
                    x = slice(lo, lo + 512)
                    top = q[x] @ q.T + left[x, None] * norm + norm[x, None] * left + left[x, None] * left
                    if split[g]:
                        top[side[rows[x]][:, None] == side[rows]] = -2
                    else:
                        top[np.arange(len(top)), np.arange(lo, lo + len(top))] = -2
                    found[rows[x]] |= (top >= least).any(axis=1)
            keep = pa.array(np.flatnonzero(found))
            yield from table.select(["key", "part", "side", "rep"]).take(keep).to_batches()

    return run


def _pairs(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j), i < j, of rows in the same group; groups lie one after the other."""
    rows = int(size.sum())
    ahead = np.repeat(start + size, size) - np.arange(rows) - 1
    i = np.repeat(np.arange(rows), ahead)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(ahead) - ahead, ahead)


def _compared(cosine: float, tables: int, projections: int):
    """Groups of whole vectors to (rep, a rep that stands for those it reaches here, links that no earlier table has)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in _groups(batches):
            size = np.diff(at)
            part = table["part"].to_numpy()[at[:-1]]
            split = part % (1 << 32) != part >> 32
            small = (size > 1) & (size <= SMALL) & ~split
            out = [one(table.slice(at[g], size[g])) for g in np.flatnonzero((size > 1) & ~small)]
            few = np.flatnonzero(small)
            for lo in range(0, len(few), 500):
                g = few[lo: lo + 500]
                rows = np.concatenate([np.arange(a, a + n) for a, n in zip(at[g], size[g])])
                out.append(many(table.take(pa.array(rows)), size[g]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["rep", "root", "links"])

    def many(rows: pa.Table, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rep, size, key = (rows[c].to_numpy() for c in ("rep", "size", "key"))
        links = np.zeros(len(rep), dtype=np.int64)
        h = np.zeros((len(rep), tables), dtype=np.int64)
        i, j = _pairs(np.append(0, np.cumsum(sizes))[:-1], sizes)
        near = np.zeros(len(i), dtype=bool)
        for at, x in _matrices(rows["v"].combine_chunks()):
            unit = np.zeros((len(rep), x.shape[1]))
            unit[at] = normalised(x)
            h[at] = hash_rows(unit[at], tables, projections)
            # a group holds vectors of one length
            for p in range(0, len(i), 50_000):
                some = slice(p, p + 50_000)
                near[some] |= np.einsum("ij,ij->i", unit[i[some]], unit[j[some]]) >= cosine
        i, j = i[near], j[near]
        root = np.arange(len(rep))
        while True:
            low = root.copy()
            np.minimum.at(low, i, root[j])
            np.minimum.at(low, j, root[i])
            low = low[low]
            if (low == root).all():
                break
            root = low
        for p in range(0, len(i), 50_000):
            x, y = i[p: p + 50_000], j[p: p + 50_000]
            same = h[x] == h[y]
            new = h[x, same.argmax(axis=1)] == key[x]
            np.add.at(links, x[new], size[y[new]])
            np.add.at(links, y[new], size[x[new]])
        some = np.unique(np.concatenate([i, j]))
        return rep[some], rep[root[some]], links[some]

    def one(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rep, size, side = (group[c].to_numpy() for c in ("rep", "size", "side"))
        part = group["part"][0].as_py()
        (_, x), = _matrices(group["v"].combine_chunks())
        unit = normalised(x)
        near = unit @ unit.T >= cosine
        np.fill_diagonal(near, False)
        if part >> 32 != part % (1 << 32):
            near &= side[:, None] != side
        some = np.flatnonzero(near.any(axis=1))
        if not len(some):
            return rep[:0], rep[:0], rep[:0]
        near, rep, size, unit = near[np.ix_(some, some)], rep[some], size[some], unit[some]
        root = np.arange(len(rep))
        while True:
            low = np.minimum(root, np.where(near, root, len(rep)).min(axis=1))
            low = low[low]
            if (low == root).all():
                break
            root = low
        h = hash_rows(unit, tables, projections)
        for t in range(int(np.flatnonzero(h[0] == group["key"][0].as_py())[0])):
            near &= h[:, t][:, None] != h[:, t]
        return rep, rep[root], (near * size).sum(axis=1)

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) for every row with an id.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing; vectors of different lengths do not link.  Rows with the
    same vector link with one another; rows that repeat an id count as one
    vector if their vectors are equal, and each of them gives a row; an id with
    several vectors gives a row for each.  Rows with a null id are left out.
    """
    spark = vectors.sparkSession
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).where("id is not null")
    sound = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(sound, F.lit(False))).withColumn("sig", F.sha2(F.array_join(F.col("v").cast("array<string>"), ","), 256))
    good = rows.where("ok")
    # classes have numbers of their own, as a repeated id may be the smallest of several
    classes = good.groupBy("sig").agg(F.min("id").alias("first"), F.count_distinct("id").alias("size"), F.first("v").alias("v"))
    classes = written(classes.withColumn("rep", F.xxhash64("sig")), "classes")
    tables, projections = plan(classes.count(), cosine)
    hashed = written(classes.select("rep", "v").mapInArrow(_hashed(tables, projections), "rep bigint, h array<bigint>, sketch binary"), "hashed")

    cells = hashed.select("rep", F.explode("h").alias("key"), "sketch")
    crowds = written(hashed.select(F.explode("h").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block), "crowds")
    crowds = crowds.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    few = crowds.limit(LISTED_CROWDS + 1).count() <= LISTED_CROWDS
    placed = cells.join(F.broadcast(crowds) if few else crowds, "key", "left")
    own = F.pmod(F.xxhash64("rep", "key"), F.coalesce("blocks", F.lit(1)))
    dealt = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    part = F.shiftleft(F.least("own", "other").cast("bigint"), 32) + F.greatest("own", "other")
    dealt = dealt.select("key", part.alias("part"), F.col("own").cast("int").alias("side"), "rep", "sketch")
    dealt = dealt.repartition(width(spark), "key", "part").sortWithinPartitions("key", "part")
    close = written(dealt.mapInArrow(_screened(cosine), "key bigint, part bigint, side int, rep bigint"), "close")

    whole = close.join(classes.select("rep", "size", "v"), "rep").select("key", "part", "side", "rep", "size", "v")
    whole = whole.repartition(width(spark), "key", "part").sortWithinPartitions("key", "part")
    links = written(whole.mapInArrow(_compared(cosine, tables, projections), "rep bigint, root bigint, links bigint"), "links")

    comps = connected_components(links.select(F.col("root").alias("a"), F.col("rep").alias("b")))
    counts = links.groupBy("rep").agg(F.sum("links").alias("others"))
    known = classes.select("sig", "rep", "first", "size").join(counts, "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("sig", "first", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("comp", "rep").alias("comp"))
    known = known.join(known.groupBy("comp").agg(F.min("first").alias("component_id")), "comp").select("sig", "n_links", "component_id")
    out = good.select("id", "sig").join(known, "sig").select("id", "n_links", "component_id")
    bad = rows.where("NOT ok").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(bad).withColumn("kept", F.col("id") == F.col("component_id"))
