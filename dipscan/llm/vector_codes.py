"""Operator 11: compression of vectors to short codes by Elkan's form of Lloyd's rounds.

Vectors become integers ``floor(SCALE * x)`` and are cut into ``PARTS`` consecutive
parts; each part position has a codebook of ``ENTRIES`` entries, at first that part
of the vectors with the smallest ids.  A round gives every part its nearest entry
(ties to the lower index) and makes each entry the floored mean of its parts.

*Bounds.*  A row keeps, for each part, its entry, an upper bound of the distance to
it and a lower bound for every entry; they are written to the shared folder with
the codes after each round, so a lost executor costs tasks only.  When entries
move, the upper bound grows by the movement of the part's entry and each lower
bound shrinks by that of its own.  An entry is passed over only if the upper bound is
*strictly* below its lower bound, or below half the distance of the two entries:
then it is farther, not as far.  All others are compared by integer distances, which settle ties
exactly.  Bounds are float32 rounded outwards.

Sums of a round are Python integers: one row for each task and entry is shuffled,
and one for each entry reaches the driver, whatever the number of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import width, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
ROOM = 1 << 28  # integers below this have squared distances that fit 64 bits
BLOCK = 4096  # vectors that a task looks at together
_SLACK = 2.0 ** -50


@dataclass
class Codes:
    """``rows``: id, label, code (bytes), errors (a squared distance for each part); ``codebooks[part][entry]``."""

    rows: DataFrame
    codebooks: list[np.ndarray]
    compared: list[int]  # exact distances computed in each round


def integers(vectors: list) -> np.ndarray:
    """floor(SCALE * x) as int64, or as Python integers where squares may not fit."""
    x = np.asarray(vectors, dtype=np.float64)
    if not x.size or np.abs(x).max() < ROOM / SCALE:
        return np.floor(SCALE * x).astype(np.int64)
    out = np.empty(x.shape, dtype=object)
    for at, v in np.ndenumerate(x):
        out[at] = int(v) * SCALE if abs(v) >= 1 << 52 else int(np.floor(SCALE * v))
    return out


def cuts(dim: int) -> list[slice]:
    return [slice(p * dim // PARTS, (p + 1) * dim // PARTS) for p in range(PARTS)]


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact."""
    diff = x - c
    return (diff * diff).sum(axis=1) if diff.dtype != object else np.array([sum(v * v for v in row) for row in diff], dtype=object)


def _up(d: np.ndarray) -> np.ndarray:
    """Lengths that are not below the roots of squared ones."""
    root = np.sqrt(d.astype(np.float64)) * (1 + _SLACK)
    low = root.astype(np.float32)
    return np.where(low < root, np.nextafter(low, np.float32(np.inf)), low)


def _down(d: np.ndarray) -> np.ndarray:
    root = np.sqrt(d.astype(np.float64)) * (1 - _SLACK)
    low = root.astype(np.float32)
    return np.where(low > root, np.nextafter(low, np.float32(0)), low)


@dataclass
class Bounds:
    """Of one part position: entry, upper bound, and a lower bound for each entry, for every row."""

    entry: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def assign(x: np.ndarray, book: np.ndarray, held: Bounds | None, moved: np.ndarray | None) -> tuple[Bounds, int]:
    """The nearest entry of each row with new bounds, and the number of distances computed.

    ``held`` are the bounds from before the entries moved, by ``moved`` at most.
    """
    n, k = len(x), len(book)
    wide = x.dtype == object or book.dtype == object
    if held is None or wide:  # Python integers: no bounds, every distance
        d = np.stack([_distances(x, c) for c in book], axis=1) if n else np.zeros((0, k), np.int64)
        entry = np.array([min(range(k), key=lambda c, row=row: (row[c], c)) for row in d], dtype=np.uint8) if wide else d.argmin(axis=1).astype(np.uint8)
        if wide:
            return Bounds(entry, np.full(n, np.inf, np.float32), np.zeros((n, k), np.float32)), n * k
        return Bounds(entry, _up(d[np.arange(n), entry]), _down(d)), n * k
    far = moved.astype(np.float32)
    entry = held.entry.copy()
    upper = np.nextafter(held.upper + far[entry], np.float32(np.inf))
    lower = np.maximum(np.nextafter(held.lower - far, np.float32(-np.inf)), np.float32(0))
    half = np.stack([_down(_distances(book, c)) for c in book]) * np.float32(0.5)
    seen = np.arange(k)
    todo = (upper[:, None] >= lower) & (upper[:, None] >= half[entry]) & (seen != entry[:, None])
    rows = np.flatnonzero(todo.any(axis=1))
    best = np.zeros(n, dtype=np.int64)
    best[rows] = _distances(x[rows], book[entry[rows]])
    upper[rows] = _up(best[rows])
    lower[rows, entry[rows]] = _down(best[rows])
    compared = len(rows)
    for c in range(k):
        some = rows[todo[rows, c] & (entry[rows] != c)]
        some = some[(upper[some] >= lower[some, c]) & (upper[some] >= half[entry[some], c])]
        d = _distances(x[some], book[c])
        compared += len(some)
        lower[some, c] = _down(d)
        nearer = (d < best[some]) | ((d == best[some]) & (c < entry[some]))
        won = some[nearer]
        entry[won], best[won], upper[won] = c, d[nearer], _up(d[nearer])
    return Bounds(entry, upper, lower), compared


def _packed(x: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in x.astype("<i8")] if x.dtype != object else [",".join(map(str, row)).encode() for row in x]


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Whole batches are of one kind if none is text; a text has commas or another length, which ``wide`` tells."""
    values = column.to_pylist()
    if all(v[:1] == b"i" for v in values):
        return np.frombuffer(b"".join(v[1:] for v in values), "<i8").reshape(len(values), dim)
    rows = [list(map(int, np.frombuffer(v[1:], "<i8"))) if v[:1] == b"i" else [int(s) for s in v[1:].split(b",") if s] for v in values]
    out = np.empty((len(rows), dim), dtype=object)
    for i, row in enumerate(rows):
        out[i] = row
    return out


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            x = integers(part.column(2).to_pylist())
            mark = b"i" if x.dtype != object else b"t"
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([mark + v for v in _packed(x)], pa.binary())], names=["id", "label", "v"])


def _assigned(books: list[np.ndarray], moved: list[np.ndarray] | None, dim: int):
    k = len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                n = part.num_rows
                x = _vectors(part.column(2), dim)
                code = np.zeros((n, PARTS), dtype=np.uint8)
                upper = np.zeros((n, PARTS), dtype=np.float32)
                lower = np.zeros((n, PARTS, k), dtype=np.float32)
                if moved is not None:
                    was, high, low = (np.frombuffer(b"".join(part.column(i).to_pylist()), t) for i, t in ((3, np.uint8), (4, "<f4"), (5, "<f4")))
                    was, high, low = was.reshape(n, PARTS), high.reshape(n, PARTS), low.reshape(n, PARTS, k)
                compared = 0
                for p, cut in enumerate(cuts(dim)):
                    held = Bounds(was[:, p], high[:, p], low[:, p]) if moved is not None else None
                    now, tried = assign(x[:, cut], books[p], held, moved[p] if moved is not None else None)
                    code[:, p], upper[:, p], lower[:, p] = now.entry, now.upper, now.lower
                    compared += tried
                tried = np.zeros(n, dtype=np.int64)
                tried[:1] = compared  # of the block, at its first row
                binary = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (code, upper, lower)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *binary, pa.array(tried)], names=["id", "label", "v", "code", "upper", "lower", "compared"])

    return run


def _sums(dim: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((PARTS, k), dtype=np.int64)
        total = np.zeros((k, dim), dtype=object)  # of each component, by the entry of its part
        compared = 0
        for batch in batches:
            compared += sum(batch.column(2).to_pylist())
            for at in range(0, batch.num_rows, BLOCK):
                x = _vectors(batch.column(0).slice(at, BLOCK), dim)
                code = np.frombuffer(b"".join(batch.column(1).slice(at, BLOCK).to_pylist()), np.uint8).reshape(-1, PARTS)
                for p, cut in enumerate(cuts(dim)):
                    for c in range(k):
                        mine = code[:, p] == c
                        n[p, c] += int(mine.sum())
                        total[c, cut] += x[mine, cut].sum(axis=0).astype(object)
        rows = [(p * k + c, int(n[p, c]), compared if p + c == 0 else 0, [str(v) for v in total[c, cut]]) for p, cut in enumerate(cuts(dim)) for c in range(k)]
        yield _sum_rows(rows)

    return run


def _sum_rows(rows: list[tuple[int, int, int, list[str]]]) -> pa.RecordBatch:
    cell, n, compared, total = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(n, pa.int64()), pa.array(compared, pa.int64()), pa.array(total, pa.list_(pa.string()))], names=["cell", "n", "compared", "total"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for batch in batches:
        for cell, n, compared, total in zip(*[c.to_pylist() for c in batch.columns]):
            held = found.setdefault(cell, [0, 0, [0] * len(total)])
            held[0] += n
            held[1] += compared
            held[2] = [a + int(b) for a, b in zip(held[2], total)]
    if found:
        yield _sum_rows([(cell, n, compared, [str(v) for v in total]) for cell, (n, compared, total) in found.items()])


def _tight(rows: list[list[int]]) -> np.ndarray:
    big = any(abs(v) >= ROOM for r in rows for v in r)
    out = np.empty((len(rows), len(rows[0])), dtype=object if big else np.int64)
    for i, r in enumerate(rows):
        out[i] = r
    return out


def _measured(books: list[np.ndarray], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _vectors(part.column(2), dim)
                code = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(-1, PARTS)
                d = np.stack([_distances(x[:, cut], books[p][code[:, p]]) for p, cut in enumerate(cuts(dim))], axis=1)
                totals = [sum(map(int, row)) for row in d]
                errors = [v if v < 1 << 63 else None for v in totals]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], part.column(3), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])

    return run


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codes of all sound vectors and the final codebooks.

    Vectors that are null, or hold null or non-finite components, are left out;
    so are vectors whose length differs from that of the smallest id's.  A length
    that ``PARTS`` does not divide gives parts that differ by one.  With fewer
    vectors than entries every vector starts an entry.  Rows that repeat an id
    are rows of their own; null ids come last when the first entries are chosen,
    equal ids in order of their vectors.  Errors beyond 64 bits are null.  An
    empty table gives no rows and no codebooks.
    """
    spark = vectors.sparkSession
    sound = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where(F.coalesce(sound, F.lit(False)))
    first = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    fields = [rows.schema["id"], rows.schema["label"]]
    if not first:
        kind = T.StructType([*fields, T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
        return Codes(spark.createDataFrame([], kind), [], [])
    dim = len(first[0].v)
    if any(len(r.v) != dim for r in first):
        first = rows.where(F.size("v") == dim).select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    start = integers([list(r.v) for r in first])
    books = [_tight([list(map(int, r)) for r in start[:, cut]]) for cut in cuts(dim)]
    k = len(first)
    binary = lambda *names: [T.StructField(n, T.BinaryType()) for n in names]
    state = written(rows.where(F.size("v") == dim).mapInArrow(_quantised, T.StructType([*fields, *binary("v")])), "integers")
    kind = T.StructType([*fields, *binary("v", "code", "upper", "lower"), T.StructField("compared", T.LongType())])
    moved, compared = None, []
    for turn in range(rounds + 1):
        state = written(state.mapInArrow(_assigned(books, moved, dim), kind), "assigned")
        sums = state.select("v", "code", "compared").mapInArrow(_sums(dim, k), "cell int, n bigint, compared bigint, total array<string>")
        sums = sums.repartition(min(PARTS * k, width(spark)), "cell").mapInArrow(_added, "cell int, n bigint, compared bigint, total array<string>").collect()
        compared.append(sum(r.compared for r in sums))
        if turn == rounds:
            break
        new = [[list(map(int, e)) for e in book] for book in books]
        for r in sums:
            if r.n:
                new[r.cell // k][r.cell % k] = [int(v) // r.n for v in r.total]
        old, books = books, [_tight(book) for book in new]
        moved = [np.full(k, np.inf, np.float32) if a.dtype == object or b.dtype == object else _up(_distances(a, b)) for a, b in zip(old, books)]
    measured = T.StructType([*fields, *binary("code"), T.StructField("error", T.LongType())])
    return Codes(written(state.select("id", "label", "v", "code").mapInArrow(_measured(books, dim), measured), "codes"), books, compared)


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for book in books for entry in book for v in entry).encode()).hexdigest()


def coded(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) for every sound vector; see ``compress``."""
    found = compress(vectors, id_col, vector_col, label_col)
    by_label = found.rows.groupBy(F.col("label").alias("kind")).agg(F.try_sum("error").alias("label_error"))
    rows = found.rows.join(by_label, found.rows["label"].eqNullSafe(by_label["kind"]))
    # an entry's index as two hexadecimal digits
    return rows.select(F.col("id").alias(id_col), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks_digest(found.codebooks)).alias("codebooks_sha256"))
