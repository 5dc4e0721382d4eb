"""Operator 8: exact Jaccard join of word-shingle sets by set-relation skipping.

Sets are built once per text in Arrow blocks and travel as packed byte strings
(a few rows per block and bucket, not a row per shingle).  The steps:

1.  *Frequencies.*  Shingles are dealt by hash, and one bucket after the other keeps
    the shingles that at least two different sets have.  Equal sets share one
    64-bit signature, so any number of copies counts as one set.  Shingles and sets
    that a sample shows to be frequent do not meet: a frequent shingle is shared
    anyway, and of a frequent set one row sends its shingles.  The sample steers
    where rows meet and the order of shingles, never the result.
2.  *Index.*  Shared shingles return to their set, rarest first.  A set whose
    prefix (``n - ceil(0.75 n) + 1`` shingles) has no shared one has no partner.
3.  *Index-level skipping.*  A posting at position ``i`` of a set of size ``n``
    can only be the first match of a pair with ``m <= (4n - 7i) / 3``; lists are
    blocked by size, and blocks out of that range are skipped by position.
    Parity bitmaps bound the number of differing shingles from below and skip
    pairs before their sets are read.
4.  *Answer-level skipping.*  Some rounds compare every set with one or two
    leaders of its lists.  Sets that reach one another need no further answers
    about each other, and a set's distance from others follows from the computed
    answer of a similar set: ``|x'&y| <= |x&y| + |x'| - |x'&x|``.  The last round
    checks every pair of different components that these bounds leave open.

Result: one row per document with its component; no pair list inside a group of
copies is ever made, and no link between different texts is lost.  Shingles count
as equal if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .shared import connected_components, width, written

STAR_ROUNDS = 3
BUCKET_BYTES = 8 << 20  # of text for one bucket of shingles
SAMPLE_ROWS, SAMPLE_SEED, CROWD = 8_192, 11, 16
FREQUENT = 1 << 15  # frequencies from here on are those of the sample's frequent shingles

_PACKED = "kind int, bucket int, keys binary, sizes binary, counts binary, toks binary, dfs binary, ids binary"
_FIELDS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("keys", "sizes", "counts", "toks", "dfs", "ids"))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows starts in sorted columns."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _counts(start: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(start, n))


@dataclass
class Crowd:
    """What a sample shows to be frequent; it steers where rows meet, never what is found."""

    sets: dict[int, int]  # signature of a frequent set: id of the one row that sends its shingles
    toks: np.ndarray  # frequent shingles, sorted
    dfs: np.ndarray


_NOBODY = Crowd({}, np.zeros(0, np.uint64), np.zeros(0, np.uint16))


def _set_rows(kind: int, tok: np.ndarray, key: np.ndarray, size: np.ndarray, df: np.ndarray, buckets: int) -> list[tuple]:
    """Shingles with their frequencies as packed rows, dealt by set."""
    order = np.lexsort((tok, key, key % np.uint64(buckets)))
    tok, key, size, df = (x[order] for x in (tok, key, size, df))
    at = (key % np.uint64(buckets)).astype(np.int64)
    cut = np.append(_starts(at), len(at)) if len(at) else np.zeros(1, np.int64)
    rows = []
    for lo, hi in zip(cut.tolist(), cut[1:].tolist()):
        part = slice(lo, hi)
        head = _starts(key[part])
        rows.append((kind, int(at[lo]), key[part][head].tobytes(), size[part][head].astype("<u4").tobytes(), _counts(head, hi - lo).astype("<u4").tobytes(), tok[part].tobytes(), df[part].astype("<u2").tobytes(), None))
    return rows


def _shingled(k: int, buckets: int, crowd: Broadcast | None = None):
    """Blocks of (id, text) to packed rows.

    Kind 0 names sets, kind 1 holds shingles of a bucket, kind 2 frequent shingles
    of the sets of a bucket, which need not meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = crowd.value if crowd else _NOBODY
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for row0, texts in tb.blocks(batch.column(1)):
                sigs, sizes, held, seen = [], [], [], set()
                for row, s in tb.shingle_sets(texts, k):
                    sig = (int(tb.mix(s).sum(dtype=np.uint64)) + len(s) * 0x9E3779B97F4A7C15) & (1 << 64) - 1 if len(s) else 0
                    sigs.append(sig)
                    sizes.append(len(s))
                    if len(s) and sig not in seen and known.sets.get(sig, ids[row0 + row]) == ids[row0 + row]:
                        seen.add(sig)
                        held.append((sig, s))
                own = ids[row0: row0 + len(texts)]
                rows = [(0, int(own[0] % buckets), np.array(sigs, "<u8").tobytes(), np.array(sizes, "<u4").tobytes(), None, None, None, own.tobytes())]
                if held:
                    h = np.concatenate([s for _, s in held])
                    size = np.array([len(s) for _, s in held], dtype=np.int64)
                    doc = np.repeat(np.arange(len(held)), size)
                    key = np.array([g for g, _ in held], "<u8")
                    if len(known.toks):
                        spot = np.minimum(np.searchsorted(known.toks, h), len(known.toks) - 1)
                        often = known.toks[spot] == h
                        rows += _set_rows(2, h[often], key[doc[often]], size[doc[often]], known.dfs[spot[often]], buckets)
                        h, doc = h[~often], doc[~often]
                    at = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
                    order = np.argsort(at.astype(np.uint16) if buckets <= 1 << 16 else at, kind="stable")
                    cut = np.append(_starts(at[order]), len(at)).tolist() if len(at) else [0]
                    for lo, hi in zip(cut, cut[1:]):
                        pick = order[lo:hi]
                        head = _starts(doc[pick])
                        who = doc[pick][head]
                        rows.append((1, int(at[pick[0]]), key[who].tobytes(), size[who].astype("<u4").tobytes(), _counts(head, len(pick)).astype("<u4").tobytes(), h[pick].tobytes(), None, None))
                yield _batch(rows)

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of one bucket after the other; batches come sorted by bucket."""
    now, rows = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = tuple(c[i].as_py() for c in batch.columns)
            if row[1] != now:
                if rows:
                    yield rows
                now, rows = row[1], []
            rows.append(row)
    if rows:
        yield rows


def _postings(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, signature, size of the set) of packed rows."""
    count = [np.frombuffer(r[4], "<u4") for r in rows]
    tok = np.concatenate([np.frombuffer(r[5], "<u8") for r in rows])
    key = np.concatenate([np.repeat(np.frombuffer(r[2], "<u8"), c) for r, c in zip(rows, count)])
    return tok, key, np.concatenate([np.repeat(np.frombuffer(r[3], "<u4"), c) for r, c in zip(rows, count)])


def _several(tok: np.ndarray, key: np.ndarray, size: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(shingle, signature, size, number of sets), each once, of shingles that ``least`` different sets have."""
    order = np.argsort(tok)
    n = _counts(_starts(tok[order]), len(tok)) if len(tok) else np.zeros(0, np.int64)
    order = order[np.repeat(n >= least, n)]
    order = order[np.lexsort((key[order], tok[order]))]
    tok, key, size = tok[order], key[order], size[order]
    if not len(tok):
        return tok, key, size, np.zeros(0, np.int64)
    one = _starts(tok, key)
    tok, key, size = tok[one], key[one], size[one]
    n = _counts(_starts(tok), len(tok))
    df = np.repeat(n, n)
    return tuple(x[df >= least] for x in (tok, key, size, df))


def _shared_shingles(buckets: int):
    """Bucket after bucket to the shingles that two different sets have, dealt by set; other kinds pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches):
            for r in rows:
                if r[0] != 1:
                    yield _batch([r])
            rows = [r for r in rows if r[0] == 1]
            if not rows:
                continue
            tok, key, size, df = _several(*_postings(rows), 2)
            rows = []
            for r in _set_rows(1, tok, key, size, np.minimum(df, FREQUENT - 1), buckets):
                yield _batch([r])

    return run


def _crowded(least: int):
    """Buckets of a sample to (shingle, number of sets) where ``least`` sets have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches):
            tok, _, _, df = _several(*_postings(rows), least)
            if len(tok):
                head = _starts(tok)
                yield pa.RecordBatch.from_arrays([pa.array(tok[head].view(np.int64)), pa.array(df[head].astype(np.int64))], names=["tok", "df"])

    return run


def _crowd_of(source: DataFrame, k: int, total: int, parts: int) -> Crowd:
    """Sets and shingles that ``CROWD`` of about ``SAMPLE_ROWS`` rows have: at most SAMPLE_ROWS / CROWD sets, and a shingle for CROWD words of the sample."""
    sample = source.where(F.rand(SAMPLE_SEED) < SAMPLE_ROWS / max(1, total)) if total > SAMPLE_ROWS else source
    packed = written(sample.mapInArrow(_shingled(k, parts), _PACKED), "sample")
    sets = packed.where("kind = 0").mapInArrow(_named, "id bigint, n bigint, sig bigint").where("n > 0")
    sets = sets.groupBy("sig").agg(F.count("*").alias("c"), F.min("id").alias("id")).where(F.col("c") >= CROWD).collect()
    toks = packed.where("kind = 1").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_crowded(CROWD), "tok bigint, df bigint").toArrow()
    tok, df = toks["tok"].to_numpy().view(np.uint64), toks["df"].to_numpy()
    order = np.argsort(tok)
    return Crowd({r.sig & (1 << 64) - 1: r.id for r in sets}, tok[order], (FREQUENT + np.minimum(df[order], FREQUENT - 1)).astype(np.uint16))


_INDEX = "sig bigint, n int, k int, need int, toks array<bigint>, parity array<bigint>"
PARITY_WORDS = 8


def _indexed(num: int, den: int):
    """All shared shingles of the sets of a bucket to one index row per set that may have a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches):
            yield from index(rows)

    def index(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        tok, key, size = _postings(rows)
        df = np.concatenate([np.frombuffer(r[6], "<u2") for r in rows])
        order = np.lexsort((tok, df, key))
        order = order[_starts(key[order], tok[order])]
        key, size, tok = key[order], size[order].astype(np.int64), tok[order]
        head = _starts(key)
        k = np.diff(np.append(head, len(key)))
        n = size[head]
        need = n - (num * n + den - 1) // den + 1 - (n - k)
        keep = need > 0
        rows = np.repeat(keep, k)
        offsets = np.append(0, np.cumsum(k[keep])).astype(np.int32)
        toks = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tok[rows].view(np.int64)))
        # each shared shingle flips one bit, so sets differ in at least as many shingles as these differ in bits
        spot = tb.mix(tok)
        flip = np.uint64(1) << (spot & np.uint64(63))
        word = ((spot >> np.uint64(6)) % np.uint64(PARITY_WORDS)).astype(np.int64)
        own = np.repeat(np.arange(len(n)), k)
        parity = np.zeros((len(n), PARITY_WORDS), dtype=np.uint64)
        np.bitwise_xor.at(parity, (own, word), flip)
        bits = pa.ListArray.from_arrays(pa.array(np.arange(keep.sum() + 1) * PARITY_WORDS, pa.int32()), pa.array(parity[keep].reshape(-1).view(np.int64)))
        out = pa.RecordBatch.from_arrays([pa.array(key[head][keep].view(np.int64)), pa.array(n[keep], pa.int32()), pa.array(k[keep], pa.int32()), pa.array(need[keep], pa.int32()), toks, bits], names=["sig", "n", "k", "need", "toks", "parity"])
        for at in range(0, out.num_rows, 500):
            yield out.slice(at, 500)

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, n, ids in zip(*(batch.column(i).to_pylist() for i in (2, 3, 7))):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, "<i8")), pa.array(np.frombuffer(n, "<u4").astype(np.int64)), pa.array(np.frombuffer(k, "<i8"))], names=["id", "n", "sig"])


def _verified(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """Exact intersection sizes of (a, b) pairs; both sides hold all shared shingles."""
    left = index.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
    right = index.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return both.select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("both"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id): documents linked at ``den*|x&y| >= num*|x|y||``.

    Null and empty texts, and texts without words, have an empty set and link
    with nothing.  Rows with a null id cannot be named and are left out.  Rows
    that repeat an id are sets of that id each.  Other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    size, total = source.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    parts = width(spark)
    buckets = max(parts, (size or 0) // BUCKET_BYTES + 1)
    crowd = spark.sparkContext.broadcast(_crowd_of(source, k, total, parts))
    packed = source.mapInArrow(_shingled(k, buckets, crowd), _PACKED).repartition("bucket").sortWithinPartitions("bucket")
    shared = written(packed.mapInArrow(_shared_shingles(buckets), _PACKED), "shingles")
    named = shared.where("kind = 0").mapInArrow(_named, "id bigint, n bigint, sig bigint")
    index = written(shared.where("kind > 0").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_indexed(num, den), _INDEX), "index")

    # |x & y| >= num (n + m) / (num + den) is the same as Jaccard >= num / den
    enough = f"{num + den} * both >= {num} * (na + nb)"
    fits = f"{den} * least(na, nb) >= {num} * greatest(na, nb) AND {num + den} * least(na - pa, nb - pb) >= {num} * (na + nb)"

    # |x ^ y| <= (den - num) / (num + den) * (n + m): shingles of one set only, and unequal bits, count at least
    apart = " + ".join(f"bit_count(qa[{i}] ^ qb[{i}])" for i in range(PARITY_WORDS))
    like = f"{num + den} * (na - ka + nb - kb + {apart}) <= {den - num} * (na + nb)"

    comps = None
    answers = None
    for turn in range(STAR_ROUNDS + 1):
        sets = index if comps is None else index.join(comps, index.sig == comps.id, "left")
        sets = sets.withColumn("comp", F.col("sig") if comps is None else F.coalesce("comp", "sig"))
        posts = sets.select("sig", "n", "k", "parity", "comp", F.posexplode(F.slice("toks", F.lit(1), F.col("need"))).alias("i", "tok"))
        posts = posts.withColumn("pos", F.col("n") - F.col("k") + F.col("i")).drop("i")
        if turn < STAR_ROUNDS:
            pairs = _stars(posts.drop("parity", "k"), index, fits, like, turn)
        else:
            pairs = _open_pairs(posts, f"{fits} AND {like}", num, den, answers)
        if answers is not None:
            pairs = pairs.join(answers, ["a", "b"], "left_anti")
        found = written(_verified(pairs, index), "answers")
        answers = found if answers is None else answers.unionByName(found)
        comps = written(_joined(comps, found.where(enough)), "comps")

    empty = named.where("n = 0").select(F.col("id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    full = named.where("n > 0")
    least = full.groupBy("sig").agg(F.min("id").alias("first")).join(comps.withColumnRenamed("id", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    least = written(least, "least")
    roots = least.groupBy("comp").agg(F.min("first").alias("component_id"))
    whole = full.join(least.join(roots, "comp").select("sig", "component_id"), "sig").select("id", F.col("n").alias("n_shingles"), "component_id")
    return whole.unionByName(empty)


def _joined(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (id, comp) after new links (a, b); only components that links join are walked."""
    if comps is None:
        return connected_components(links)
    of = lambda side: comps.select(F.col("id").alias(side), F.col("comp").alias(f"c{side}"))
    ends = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a != b")
    merged = written(connected_components(ends), "merged")
    known = comps.join(merged.toDF("comp", "to"), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    return known.unionByName(merged.join(comps, "id", "left_anti"))


def _lists(posts: DataFrame, turn: int) -> DataFrame:
    """Lists that hold several components: the largest one, and one of its members as leader."""
    member = F.struct(F.xxhash64("sig", "tok", F.lit(turn)).alias("h"), "sig", "n", "pos")
    parts = posts.groupBy("tok", "comp").agg(F.count("*").alias("c"), F.min(member).alias("lead"))
    main = F.max(F.struct("c", F.xxhash64("comp", F.lit(turn)).alias("h"), "comp", "lead"))
    return parts.groupBy("tok").agg(main.alias("main"), F.count("*").alias("comps")).where("comps > 1").select("tok", F.col("main.comp").alias("main"), F.col("main.lead").alias("lead"))


def _stars(posts: DataFrame, index: DataFrame, fits: str, like: str, turn: int) -> DataFrame:
    """Up to two pairs for each set outside its lists' largest components: with their leaders.

    The first turn takes any two; later ones the two with the most equal bitmaps.
    """
    near = posts.join(_lists(posts, turn), "tok").where("comp != main")
    near = near.select(F.col("sig").alias("x"), F.col("lead.sig").alias("y"), F.col("n").alias("na"), F.col("lead.n").alias("nb"), F.col("pos").alias("pa"), F.col("lead.pos").alias("pb")).where(fits)
    if turn:
        bits = index.select("sig", "k", "parity")
        near = near.select("x", "y", "na", "nb").distinct()
        near = near.join(bits.toDF("x", "ka", "qa"), "x").join(bits.toDF("y", "kb", "qb"), "y").where(like)
        apart = F.expr(" + ".join(f"bit_count(qa[{i}] ^ qb[{i}])" for i in range(PARITY_WORDS)) + " + nb - kb")
        order = F.struct(apart.alias("d"), F.xxhash64("x", "y").alias("h"), "y")
        best = near.groupBy("x").agg(F.min(order).alias("p"), F.min(F.struct(F.xxhash64("x", "y").alias("h"), "y")).alias("q"))
    else:
        order = F.struct(F.xxhash64("x", "y").alias("h"), "y")
        best = near.groupBy("x").agg(F.min(order).alias("p"), F.max(order).alias("q"))
    best = best.select("x", F.explode(F.array("p.y", "q.y")).alias("y"))
    return best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _open_pairs(posts: DataFrame, fits: str, num: int, den: int, answers: DataFrame) -> DataFrame:
    """Every pair of different components that shares a prefix shingle and that no bound rules out."""
    live = written(posts.join(_lists(posts, STAR_ROUNDS).drop("lead"), "tok"), "lists")
    band = lambda size: F.floor(F.log(F.greatest(size.cast("double"), F.lit(1.0))) / float(np.log(den / num)))
    n, pos = F.col("n"), F.col("pos")
    reach = F.least(n * den / num, (n * den - pos * (num + den)) / num)
    probe = live.where("comp != main").withColumn("lo", band(n * num / den)).withColumn("hi", band(reach)).where("hi >= lo")
    probe = probe.select("tok", F.col("sig").alias("x"), F.col("n").alias("na"), F.col("k").alias("ka"), F.col("parity").alias("qa"), F.col("pos").alias("pa"), F.col("comp").alias("ca"), F.explode(F.sequence("lo", "hi")).alias("band"))
    block = live.select("tok", F.col("sig").alias("y"), F.col("n").alias("nb"), F.col("k").alias("kb"), F.col("parity").alias("qb"), F.col("pos").alias("pb"), F.col("comp").alias("cb"), band(n).alias("band"))
    pairs = probe.join(block, ["tok", "band"]).where("ca != cb").where(fits)
    pairs = pairs.select("x", "y", "na", "nb").distinct()
    # |x'&y| <= |x&y| + |x'| - |x'&x|, with x the set most like x' among its links
    sides = answers.select(F.col("a").alias("x"), F.col("b").alias("z"), "both", F.col("na").alias("nx"), F.col("nb").alias("nz"))
    sides = sides.unionByName(answers.select(F.col("b").alias("x"), F.col("a").alias("z"), "both", F.col("nb").alias("nx"), F.col("na").alias("nz")))
    like = sides.where(f"{num + den} * both >= {num} * (nx + nz)").groupBy("x").agg(F.max(F.struct("both", "z")).alias("m")).select("x", F.col("m.z").alias("z"), F.col("m.both").alias("xz"))
    known = sides.select(F.col("x").alias("z"), F.col("z").alias("y"), F.col("both").alias("zy"))
    bound = pairs.join(like, "x", "left").join(known, ["z", "y"], "left")
    bound = bound.where(f"zy is null OR xz is null OR {num + den} * (zy + na - xz) >= {num} * (na + nb)")
    return bound.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
