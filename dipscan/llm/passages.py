"""Operator 2: fuzzy repeated passages by collinear chaining of shared seeds.

1.  *Seeds.*  Hashes of all runs of ``K`` words, packed by hash bucket: a few rows for each
    chunk of texts.  Of a seed that more than ``CHUNK_TEXTS`` texts of a chunk have, only the first
    ones travel; the others are matched inside the chunk, so the list of a seed that a
    third of all texts share grows with the number of chunks, not of texts.
2.  *Matches.*  Seeds meet by hash, one bucket after the other.  Every occurrence is
    matched with occurrences in the first document that has it and in the one just
    before its own (smallest id, then position), never with all others.
3.  *Chains.*  Matches of a pair of documents that follow one another on a diagonal are
    one run of equal words.  Runs in the same order on both sides are chained by a
    Fenwick tree over positions: a run adds its words, and words that it skips on
    either side cost ``GAP`` each.
4.  *Alignment.*  A chain whose runs alone make a passage that is long and alike is accepted
    as it is.  For the others the words of both passages, with a margin, are aligned
    locally in a band (vectorised over many chains); what is left on both sides is
    aligned again, and a stretch that is long but not alike is taken apart.
5.  *Choice.*  Of a document's passages those go whose words passages with smaller
    ids of the source cover already.

The first occurrence stays; the result names what repeats it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .shared import width, written

K = 5
GAP = 0.1  # cost of a skipped word
MIN_SCORE = 10.0  # of a chain, in words: two seeds that do not overlap, or one run of ten
MIN_WORDS = 45  # of an aligned passage
MIN_SIMILARITY = 0.75
MARGIN, BAND = 48, 16
BUCKET_BYTES = 8 << 20  # of text for one bucket of seeds
CHUNK_SEEDS, CHUNK_TEXTS = 750_000, 8
SEED_BYTES, WORD_BYTES = 5, 3  # of hashes that only propose matches, or are compared on one diagonal
SPANS = 256  # that share one copy of a text
_MATCH, _MISS, _SKIP = 2, -2, -3
_LOW = 28  # bits of a cell that hold where its alignment began

_U = np.uint64
_PACKED = "bucket int, kind int, ids binary, counts binary, toks binary, at binary"
_FIELDS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("ids", "counts", "toks", "at"))])


def _planes(x: np.ndarray, size: int) -> bytes:
    """The lowest ``size`` bytes of every number, all first bytes first: small numbers compress well."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _numbers(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), dtype=np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(size, -1).T
    return out.view("<u8").reshape(-1)


def _signed(z: np.ndarray) -> np.ndarray:
    """The reverse of ``_zigzag``; all 64 bits count, so differences may wrap."""
    return (z >> _U(1)).astype(np.int64) ^ -(z & _U(1)).astype(np.int64)


def _zigzag(x: np.ndarray) -> np.ndarray:
    """Small numbers of either sign as small numbers without one."""
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def _steps(x: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Differences inside groups whose first rows ``head`` names; those keep their value."""
    out = np.diff(x, prepend=x[:1] * 0)
    out[head] = x[head]
    return out


def _summed(steps: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The reverse of ``_steps``, for groups of ``count`` rows."""
    total = np.cumsum(steps)
    head = np.append(0, np.cumsum(count)[:-1])
    return total - np.repeat(total[head] - steps[head], count)


def _row(bucket: int, kind: int, *parts: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((bucket, kind, *parts), _FIELDS)], schema=_FIELDS)


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns differs from the one before."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _sizes(new: np.ndarray) -> np.ndarray:
    return np.diff(np.append(np.flatnonzero(new), len(new)))


def _matches(tok: np.ndarray, own: np.ndarray, pos: np.ndarray, skip: int = 0) -> np.ndarray:
    """Rows (id, position, earlier id, its position) for lists sorted by (tok, own, pos).

    Every occurrence outside the list's first document meets that document and the
    one just before its own; with ``skip``, only those beyond the first ``skip``
    documents of their list do.
    """
    if not len(tok):
        return np.zeros((0, 4), np.int64)
    new = _heads(tok)
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    run = _heads(tok, own)
    begins = np.flatnonzero(run)
    nth_doc = np.cumsum(run) - 1
    first, after = begins[nth_doc], np.append(begins[1:], len(tok))[nth_doc]
    later = np.flatnonzero(nth_doc - nth_doc[head] >= max(1, skip))
    last = first[later] - 1  # last occurrence in the document just before
    origin = head[later]
    second = np.minimum(origin + 1, after[origin] - 1)  # next in the first document
    # the n-th of a document meets the n-th there as well, so repeats within both keep their order
    nth = np.minimum(origin + later - first[later], after[origin] - 1)
    nth_last = np.minimum(first[last] + later - first[later], last)
    there = np.stack([origin, second, nth, last, nth_last], axis=1)
    there.sort(axis=1)
    fresh = np.ones(there.shape, dtype=bool)
    fresh[:, 1:] = there[:, 1:] != there[:, :-1]
    here, there = np.repeat(later, fresh.sum(axis=1)), there[fresh]
    return np.stack([own[here], pos[here], own[there], pos[there]], axis=1)


def _dealt(rows: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Matches as packed rows, dealt by the id of the later document."""
    at = (tb.mix(rows[:, 0].astype(_U)) % _U(buckets)).astype(np.int64)
    order = np.lexsort((rows[:, 1], rows[:, 2], rows[:, 0], at))
    at, rows = at[order], rows[order]
    for lo, hi in _cuts(at):
        x = rows[lo:hi]
        new = _heads(x[:, 0], x[:, 2])
        head = np.flatnonzero(new)
        shift = _steps(x[:, 3] - x[:, 1], head)
        yield _row(int(at[lo]), 1, np.ascontiguousarray(x[head][:, [0, 2]]).astype("<i8").tobytes(), _planes(_sizes(new), 4), _planes(_zigzag(shift), 5), _planes(_steps(x[:, 1], head), 4))


def _cuts(sorted_key: np.ndarray) -> list[tuple[int, int]]:
    at = np.append(np.flatnonzero(_heads(sorted_key)), len(sorted_key)).tolist() if len(sorted_key) else []
    return list(zip(at, at[1:]))


def _seeded(buckets: int):
    """(id, text) to packed rows: kind 0 holds seeds of a bucket, kind 1 matches inside the chunk."""

    def packed(own: np.ndarray, pos: np.ndarray, tok: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(tok)
        new = _heads(tok[order])
        crowd = order[np.repeat(_sizes(new) > CHUNK_TEXTS, _sizes(new))]
        if len(crowd):
            crowd = crowd[np.lexsort((pos[crowd], own[crowd], tok[crowd]))]
            t, o = tok[crowd], own[crowd]
            doc = np.cumsum(_heads(t, o))
            head = _heads(t)
            beyond = doc - doc[np.flatnonzero(head)[np.cumsum(head) - 1]] >= CHUNK_TEXTS
            yield from _dealt(_matches(t, o, pos[crowd], CHUNK_TEXTS), buckets)
            stay = np.ones(len(tok), dtype=bool)
            stay[crowd[beyond]] = False
            own, pos, tok = own[stay], pos[stay], tok[stay]
        bucket = ((tok >> _U(40)) % _U(buckets)).astype(np.int32)
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        for lo, hi in _cuts(bucket[order]):
            x = order[lo:hi]
            new = _heads(own[x])
            head = np.flatnonzero(new)
            ids = own[x][head]
            steps = np.diff(ids, prepend=0)
            yield _row(int(bucket[x[0]]), 0, _planes(_zigzag(steps), 8), _planes(_sizes(new), 4), _planes(tok[x], SEED_BYTES), _planes(_steps(pos[x], head), 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for row, texts in tb.blocks(batch.column(1)):
                w = tb.words(texts)
                at, value = tb.grams(w, K)
                doc = w.doc[at]
                held.append((ids[row + doc], at - w.first[doc], value))
                n += len(at)
                if n >= CHUNK_SEEDS:
                    yield from packed(*(np.concatenate(x) for x in zip(*held)))
                    held, n = [], 0
        if n:
            yield from packed(*(np.concatenate(x) for x in zip(*held)))

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(bucket, its rows) from batches sorted by bucket, which is the first column."""
    now, rows = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = tuple(c[i].as_py() for c in batch.columns)
            if row[0] != now:
                if rows:
                    yield now, rows
                now, rows = row[0], []
            rows.append(row[1:])
    if rows:
        yield now, rows


def _matched(buckets: int):
    """Seeds, one bucket after the other, to matches dealt by id; matches pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _runs(batches):
            parts = []
            for kind, ids, counts, toks, at in rows:
                if kind:
                    yield _row(bucket, kind, ids, counts, toks, at)
                    continue
                count = _numbers(counts, 4).astype(np.int64)
                own = np.cumsum(_signed(_numbers(ids, 8)))
                parts.append((_numbers(toks, SEED_BYTES), np.repeat(own, count), _summed(_numbers(at, 4).astype(np.int64), count).astype(np.uint32)))
            if not parts:
                continue
            tok, own, pos = (np.concatenate(x) for x in zip(*parts))
            del parts, rows
            order = np.argsort(tok)
            size = _sizes(_heads(tok[order]))
            order = order[np.repeat(size > 1, size)]
            tok, own, pos = tok[order], own[order], pos[order].astype(np.int64)
            order = np.lexsort((pos, own, tok))
            yield from _dealt(_matches(tok[order], own[order], pos[order]), buckets)

    return run


def segments(runs: list[tuple[int, int, int]]) -> list[tuple[float, list[tuple[int, int, int]], int]]:
    """(score, runs in order, diagonal) of the best chains of runs (position, position there, words).

    A chain's score is the words of its runs, less where one overlaps the one before, minus
    GAP for every word skipped on either side.  The Fenwick tree keeps, over ranks of
    positions there, the best ``score + GAP * (end + end there)`` so far.  Chains share no
    run.  A chain is broken where its diagonals no longer fit in one band; only runs
    near its path are retired with it, so others in its rectangle make their own.
    """
    live = sorted(runs)
    out = []
    while sum(r[2] for r in live) >= MIN_SCORE:
        rank = {t: i + 1 for i, t in enumerate(sorted({r[1] for r in live}))}
        size = len(rank)
        tree: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)
        score, back = [float(r[2]) for r in live], [-1] * len(live)
        i = 0
        while i < len(live):
            stop = i
            while stop < len(live) and live[stop][0] == live[i][0]:
                stop += 1
            for x in range(i, stop):
                a, t, n = live[x]
                best, r = (-1e18, -1), rank[t] - 1
                while r > 0:
                    if tree[r] > best:
                        best = tree[r]
                    r -= r & -r
                if best[1] >= 0:
                    p, q, m = live[best[1]]
                    da, dt = a - p - m, t - q - m
                    linked = score[best[1]] + n + min(0, da, dt) - GAP * (max(0, da) + max(0, dt))
                    if linked > n and n + min(0, da, dt) > 0:
                        score[x], back[x] = linked, best[1]
            for x in range(i, stop):
                a, t, n = live[x]
                entry, r = (score[x] + GAP * (a + t + 2 * n), x), rank[t]
                while r <= size:
                    if entry > tree[r]:
                        tree[r] = entry
                    r += r & -r
            i = stop
        # all chains of this pass, best first; one that runs into another keeps what is its own
        gone = [False] * len(live)
        before = len(out)
        for end in sorted(range(len(live)), key=lambda x: -score[x]):
            if score[end] < MIN_SCORE:
                break
            if gone[end]:
                continue
            path, x = [], end
            while x >= 0 and not gone[x]:
                path.append(x)
                x = back[x]
            own = score[end] - (score[path[-1]] - live[path[-1]][2])
            if own < MIN_SCORE:
                continue
            path.reverse()
            part: list[int] = []
            lo = hi = 0
            for k, x in enumerate([*path, -1]):
                d = live[x][1] - live[x][0]
                if x >= 0:
                    gone[x] = True
                    if part and max(hi, d) - min(lo, d) <= BAND:
                        lo, hi = min(lo, d), max(hi, d)
                        part.append(x)
                        continue
                if part:
                    mid = (lo + hi) // 2
                    out.append((own, [live[y] for y in part], mid))
                    # what lies inside the passage and strays by little belongs to it
                    (a0, t0, _), (a1, t1, n1) = live[part[0]], live[part[-1]]
                    for y, (a, t, n) in enumerate(live):
                        if a0 <= a and a + n <= a1 + n1 and t0 <= t and t + n <= t1 + n1 and abs(t - a - mid) <= BAND:
                            gone[y] = True
                part, lo, hi = [x], d, d
        live = [r for r, g in zip(live, gone) if not g]
        if len(out) == before:
            break
    return out


def equal_runs(at: np.ndarray, to: np.ndarray) -> list[tuple[int, int, int]]:
    """(position, position there, words) of the runs that matches on one diagonal cover without a hole."""
    at, to = np.asarray(at, dtype=np.int64), np.asarray(to, dtype=np.int64)
    order = np.lexsort((at, to - at))
    a, d = at[order], (to - at)[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (a[1:] > a[:-1] + K)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(a)) - 1
    return list(zip(a[head].tolist(), (a + d)[head].tolist(), (a[last] + K - a[head]).tolist()))


def chains(at: np.ndarray, to: np.ndarray) -> list[tuple[float, int, int, int, int]]:
    """(score, first, last position, first, last position there) of the best chains of matches."""
    return [(s, r[0][0], r[-1][0] + r[-1][2] - K, r[0][1], r[-1][1] + r[-1][2] - K) for s, r, _ in segments(equal_runs(at, to))]


def joined(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(first, end, first there, end there, diagonal) of regions: neighbours on about one diagonal are one."""
    out: list[list[int]] = []
    for a, b, c, d, mid in sorted(found):
        for o in reversed(out[-8:]):
            if abs(o[4] - mid) <= BAND // 2 and a <= o[1] + 2 * MARGIN and c <= o[3] + 2 * MARGIN and d >= o[2] - 2 * MARGIN:
                o[1], o[2], o[3] = max(o[1], b), min(o[2], c), max(o[3], d)
                break
        else:
            out.append([a, b, c, d, mid])
    return [tuple(o) for o in out]


def decided(runs: list[tuple[int, int, int]]) -> tuple[int, int, int, int, float] | None:
    """(start, end, start there, end there, similarity) if the runs alone make a passage, else None.

    Words between runs count as changed, so the similarity is a lower bound.
    """
    (a, c, _), (b, d, n) = runs[0], runs[-1]
    b, d = b + n, d + n
    longest = max(b - a, d - c)
    same, x, y = 0, a, c
    for p, q, n in runs:
        same += max(0, n - max(0, x - p, y - q))
        x, y = max(x, p + n), max(y, q + n)
    if longest >= MIN_WORDS and same >= MIN_SIMILARITY * longest:
        return a, b, c, d, round(same / longest, 6)
    return None


_CHAINS = "id bigint, start_word int, end_word int, src_id bigint, src_start int, src_end int, similarity double, spans array<struct<chain:string,side:int,start:int,stop:int>>"
_SPAN = pa.list_(pa.struct([("chain", pa.string()), ("side", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}


def _of(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    names, types = zip(*(x.split(" ", 1) for x in ddl.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW.get(t, _SPAN)) for c, t in zip(zip(*rows), types)], names=names)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches, one bucket of ids after the other, to passages and to spans that must be aligned."""
    for _, held in _runs(batches):
        ids, at, to = [], [], []
        for _, i, c, shift, a in held:
            count = _numbers(c, 4).astype(np.int64)
            ids.append(np.repeat(np.frombuffer(i, "<i8").reshape(-1, 2), count, axis=0))
            at.append(_summed(_numbers(a, 4).astype(np.int64), count))
            to.append(_summed(_signed(_numbers(shift, 5)), count))
        pair, at, d = np.concatenate(ids), np.concatenate(at), np.concatenate(to)
        del ids, to, held
        order = np.lexsort((at, d, pair[:, 1], pair[:, 0]))
        own, src, at, d = pair[order, 0], pair[order, 1], at[order], d[order]
        new = _heads(own, src, d)
        new[1:] |= at[1:] > at[:-1] + K
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(at)) - 1
        own, src, words, at, to = own[head], src[head], at[last] + K - at[head], at[head], (at + d)[head]
        start = np.flatnonzero(_heads(own, src))
        keep = np.add.reduceat(words, start) >= MIN_SCORE
        rows: list[tuple] = []
        spans: dict[int, list[tuple]] = {}
        for lo, hi in zip(start[keep].tolist(), np.append(start[1:], len(own))[keep].tolist()):
            o, s = int(own[lo]), int(src[lo])
            parts = list(zip(at[lo:hi].tolist(), to[lo:hi].tolist(), words[lo:hi].tolist()))
            open_: list[tuple[int, int, int, int, int]] = []
            found = segments(parts) if hi - lo > 1 else [(0.0, parts, parts[0][1] - parts[0][0])]
            for _, chain, mid in found:
                passage = decided(chain)
                if passage:
                    rows.append((o, *passage[:2], s, *passage[2:], None))
                else:
                    (a, c, _), (b, e, n) = chain[0], chain[-1]
                    open_.append((a, b + n, c, e + n, mid))
            for a, b, c, e, mid in joined(open_):
                name = f"{o}:{s}:{a}:{c}:{mid}"
                for i, side, x, y in ((o, 0, a, b), (s, 1, c, e)):
                    of = spans.setdefault(i, [])
                    of.append((name, side, max(0, x - MARGIN), y + MARGIN))
                    if len(of) == SPANS:
                        rows.append((i, *[None] * 6, spans.pop(i)))
            if len(rows) >= 5_000:
                yield _of(rows, _CHAINS)
                rows = []
        rows += [(i, *[None] * 6, of) for i, of in spans.items()]
        for at_ in range(0, len(rows), 5_000):
            yield _of(rows[at_: at_ + 5_000], _CHAINS)


_WORDS = "id bigint, words binary"


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as word hashes of ``WORD_BYTES`` each."""
    for batch in batches:
        for row, texts in tb.blocks(batch.column(1)):
            w = tb.words(texts)
            data = w.hash.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES].tobytes()
            at = w.first * WORD_BYTES
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), pa.array([data[a:b] for a, b in zip(at, at[1:])], pa.binary())], names=["id", "words"])


def _hashes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // WORD_BYTES, 4), dtype=np.uint8)
    out[:, :WORD_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, WORD_BYTES)
    return out.view("<u4").reshape(-1).astype(np.uint64) + _U(2)  # 0 and 1 mark what is outside a text


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(spans, words of a text) to (chain, side, start, words of the span)."""
    for batch in batches:
        for spans, words in zip(batch.column(0), batch.column(1)):
            data = words.as_buffer()
            rows = [(s["chain"], s["side"], s["start"], data[s["start"] * WORD_BYTES: s["stop"] * WORD_BYTES].to_pybytes()) for s in spans.as_py()]
            yield _of(rows, "chain string, side int, start int, words binary")


def align(lefts: list[np.ndarray], rights: list[np.ndarray], shifts: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(score, start, stop, start there, stop there) of the best banded local alignments.

    All pairs go through the rows together.  A cell holds its score and, in the
    low bits, the row and band column where its alignment began.
    """
    n = len(lefts)
    rows = max(map(len, lefts))
    wide = 2 * BAND + 1
    cols = np.arange(wide)
    a = np.zeros((n, rows), dtype=np.uint64)
    long = max(map(len, rights))
    base = np.array(shifts) - BAND  # column of the right side at row 0, band 0
    pad = wide + rows
    b = np.full((n, pad + long + rows + 2 * wide), 1, dtype=np.uint64)
    for i, (x, y) in enumerate(zip(lefts, rights)):
        a[i, : len(x)] = x
        b[i, pad: pad + len(y)] = y
    one = np.int64(1) << _LOW
    cell = np.zeros((n, wide), dtype=np.int64) | cols
    best = np.zeros(n, dtype=np.int64)
    best_at = np.zeros((n, 2), dtype=np.int64)
    slope = -_SKIP * cols * one
    who = np.arange(n)[:, None]
    for r in range(rows):
        there = np.clip(pad + base[:, None] + r + cols, 0, b.shape[1] - 1)
        same = (b[who, there] == a[:, r: r + 1]) & (a[:, r: r + 1] != 0)
        diag = cell + np.where(same, _MATCH, _MISS) * one
        down = np.full_like(cell, -one)
        down[:, :-1] = cell[:, 1:] + _SKIP * one
        fresh = (np.int64(r + 1) << 6) | cols
        now = np.maximum(np.maximum(diag, down), fresh)
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        cell = np.where(now < one, np.broadcast_to(fresh, now.shape), now)
        top = cell.argmax(axis=1)
        value = cell[np.arange(n), top]
        better = (value >> _LOW) > (best >> _LOW)
        best = np.where(better, value, best)
        best_at[better] = np.stack([np.full(n, r + 1), top], axis=1)[better]
    out = []
    for i in range(n):
        score, code = int(best[i] >> _LOW), int(best[i] & (one - 1))
        r0, c0, (r1, c1) = code >> 6, code & 63, best_at[i].tolist()
        out.append((score, r0, r1, r0 + c0 + int(base[i]), r1 + c1 + int(base[i])))
    return out


_PASSAGES = "id bigint, start_word int, end_word int, src_id bigint, src_start int, src_end int, similarity double"


def _path(x: np.ndarray, y: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """Columns (left position, right position, value) of the best banded local alignment."""
    wide = 2 * BAND + 1
    cols = np.arange(wide)
    score = np.zeros((len(x) + 1, wide), dtype=np.int64)
    right = np.full(len(y) + len(x) + 4 * wide + 2 * abs(shift), 1, dtype=np.uint64)
    pad = len(x) + 2 * wide + abs(shift)
    right[pad: pad + len(y)] = y[: len(right) - pad]
    for r in range(len(x)):
        j = shift - BAND + r + cols
        same = (j >= 0) & (j < len(y)) & (right[np.clip(pad + j, 0, len(right) - 1)] == x[r])
        now = np.maximum(score[r] + np.where(same, _MATCH, _MISS), 0)
        now[:-1] = np.maximum(now[:-1], score[r, 1:] + _SKIP)
        score[r + 1] = np.maximum.accumulate(now - _SKIP * cols) + _SKIP * cols
    r, c = (int(v) for v in np.unravel_index(score.argmax(), score.shape))
    out = []
    while r > 0 and score[r, c] > 0:
        j = shift - BAND + (r - 1) + c
        value = _MATCH if 0 <= j < len(y) and y[j] == x[r - 1] else _MISS
        if score[r, c] == max(0, score[r - 1, c] + value):
            out.append((r - 1, j, value))
            r -= 1
        elif c + 1 < wide and score[r, c] == score[r - 1, c + 1] + _SKIP:
            out.append((r - 1, -1, _SKIP))
            r, c = r - 1, c + 1
        else:
            out.append((-1, j, _SKIP))
            c -= 1
    return out[::-1]


def _pieces(path: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(score, start, stop, start there, stop there) of the longest parts of a path that are alike."""
    out, todo = [], [path]
    while todo:
        part = todo.pop()
        n = len(part)
        if n < MIN_WORDS:
            continue
        value = np.array([v for _, _, v in part])
        need = 4 * (MIN_SIMILARITY - 0.5)
        sums = [np.concatenate([[0], np.cumsum(value - need * np.array([p[s] >= 0 for p in part]))]) for s in (0, 1)]
        for size in range(n, MIN_WORDS - 1, -1):
            fits = np.flatnonzero((sums[0][size:] - sums[0][:-size] >= 0) & (sums[1][size:] - sums[1][:-size] >= 0))
            if len(fits):
                break
        else:
            continue
        lo = int(fits[0])
        hi = lo + size
        total = np.concatenate([[0], np.cumsum(value[lo:hi])])
        e = int(total.argmax())  # ends that cost more than they bring go
        f = int(total[: e + 1].argmin())
        if e - f >= MIN_WORDS:
            lo, hi = lo + f, lo + e
        piece = part[lo:hi]
        left, right = [p[0] for p in piece if p[0] >= 0], [p[1] for p in piece if p[1] >= 0]
        if left and right:
            out.append((int(value[lo:hi].sum()), left[0], left[-1] + 1, right[0], right[-1] + 1))
        todo += [part[:lo], part[hi:]]
    return out


def _hopeful(pairs: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Whether an alignment that counts is possible: no left word can score more than by a match in the band."""
    out = np.zeros(len(pairs), dtype=bool)
    order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][0]))
    for lo in range(0, len(order), 1_000):
        part = order[lo: lo + 1_000]
        rows = len(pairs[part[-1]][0])
        a = np.zeros((len(part), rows), dtype=np.uint64)
        b = np.ones((len(part), rows + 2 * BAND), dtype=np.uint64)
        for k, i in enumerate(part):
            x, y, shift = pairs[i]
            a[k, : len(x)] = x
            first = shift - BAND  # word of the right side in column 0
            y = y[max(0, first): first + rows + 2 * BAND] if first + rows + 2 * BAND > 0 else y[:0]
            b[k, max(0, -first): max(0, -first) + len(y)] = y
        near = np.zeros(a.shape, dtype=bool)
        for d in range(2 * BAND + 1):
            near |= b[:, d: d + rows] == a
        total = np.concatenate([np.zeros((len(part), 1), np.int64), np.cumsum(np.where(near, _MATCH, _MISS), axis=1)], axis=1)
        out[part] = (total - np.minimum.accumulate(total, axis=1)).max(axis=1) >= MIN_WORDS * 4 * (MIN_SIMILARITY - 0.5)
    return out


def stretches(pairs: list[tuple[np.ndarray, np.ndarray, int]]) -> list[list[tuple[int, int, int, int, int]]]:
    """All (score, start, stop, start there, stop there) that are long and alike, for each (left, right, shift).

    What lies before and after a stretch is aligned again until it cannot hold
    another; a stretch that is long but not alike is taken apart along its path.
    """
    found: list[list[tuple[int, int, int, int, int]]] = [[] for _ in pairs]
    least = MIN_WORDS * 4 * (MIN_SIMILARITY - 0.5)  # score of any stretch that counts
    todo = [(i, 0, x, 0, y, s) for i, (x, y, s) in enumerate(pairs)]
    while todo:
        todo = [h for h in todo if max(len(h[2]), len(h[4])) >= MIN_WORDS and 2 * min(len(h[2]), len(h[4])) >= least]
        todo = [h for h, yes in zip(todo, _hopeful([(h[2], h[4], h[5]) for h in todo])) if yes]
        todo.sort(key=lambda h: len(h[2]))
        held, todo, at = todo, [], 0
        while at < len(held):
            n = max(1, min(256, 100_000 // (len(held[min(at + 255, len(held) - 1)][2]) + len(held[min(at + 255, len(held) - 1)][4]))))
            part = held[at: at + n]
            at += n
            for (i, p, x, q, y, s), (score, a, b, c, d) in zip(part, align([h[2] for h in part], [h[4] for h in part], [h[5] for h in part])):
                longest = max(b - a, d - c)
                if score < least:
                    continue
                if longest >= MIN_WORDS:
                    if 0.5 + score / (2 * _MATCH * longest) >= MIN_SIMILARITY:
                        found[i].append((score, p + a, p + b, q + c, q + d))
                    else:
                        lo, hi = max(0, c), min(len(y), d)
                        found[i] += [(v, p + a + e, p + a + f, q + lo + g, q + lo + h) for v, e, f, g, h in _pieces(_path(x[a:b], y[lo:hi], s + a - lo))]
                todo.append((i, p, x[:a], q, y[: max(0, c)], s))
                todo.append((i, p + b, x[b:], q + d, y[d:], s + b - d))
    return found


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chain, left words, right words, starts) to passages that are long and alike."""
    for batch in batches:
        held, pairs = [], []
        for chain, s0, s1, w0, w1 in zip(*(batch.column(i).to_pylist() for i in range(5))):
            own, src, _, _, mid = chain.split(":")
            x, y = _hashes(w0), _hashes(w1)
            if len(x) and len(y):
                held.append((int(own), s0, int(src), s1))
                pairs.append((x, y, int(mid) + s0 - s1))
        rows = []
        for (own, s0, src, s1), found in zip(held, stretches(pairs)):
            for score, a, b, c, d in found:
                rows.append((own, s0 + a, s0 + b, src, s1 + c, s1 + d, round(0.5 + score / (2 * _MATCH * max(b - a, d - c)), 6)))
        if rows:
            yield _of(rows, _PASSAGES)


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages sorted by document and source, without those that earlier sources cover."""
    out: list[tuple] = []
    own = src = before = None
    covered: list[tuple[int, int]] = []
    held: list[tuple[int, int]] = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if r == before:
                continue
            before = r
            if r[0] != own:
                own, src, covered, held = r[0], None, [], []
            if r[3] != src:
                src = r[3]
                covered, held = _union(covered + held), []
            if not any(lo <= r[1] and r[2] <= hi for lo, hi in covered):
                out.append(r)
                held.append((r[1], r[2]))
                if len(out) == 5_000:
                    yield _of(out, _PASSAGES)
                    out = []
    if out:
        yield _of(out, _PASSAGES)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages (id, start_word, end_word, src_id, src_start, src_end, similarity).

    Word ranges are half-open and count lower-cased runs between white space.
    ``src`` is the occurrence in the document with the smaller id, which stays.
    A passage has ``MIN_WORDS`` aligned words and ``MIN_SIMILARITY``; the similarity given
    is a lower bound where shared runs of words decide (words between them count
    as changed).  A passage without any five equal words in a row is not found, nor is
    one that only one document repeats.  Null, empty and short texts have no
    passages.  Rows with a null id are left out; ids are taken to be unique (rows
    that repeat one count as one document for what repeats, and each takes part).
    Other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(width(docs.sparkSession), size // BUCKET_BYTES + 1)
    seeds = source.mapInArrow(_seeded(buckets), _PACKED).repartition("bucket").sortWithinPartitions("bucket")
    matches = seeds.mapInArrow(_matched(buckets), _PACKED).repartition("bucket").sortWithinPartitions("bucket")
    chained = written(matches.mapInArrow(_chained, _CHAINS), "chains")
    passages = chained.where("spans is null").drop("spans")
    # the merge join keeps the two Python steps in stages of their own, so a task holds one worker
    wanted = chained.where("spans is not null").select("id", "spans").join(source.mapInArrow(_worded, _WORDS).hint("merge"), "id").select("spans", "words")
    parts = wanted.mapInArrow(_sliced, "chain string, side int, start int, words binary")
    pairs = parts.groupBy("chain").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c[0]}{s}") for c in ("start", "words") for s in (0, 1)])
    aligned = pairs.select("chain", "s0", "s1", "w0", "w1").mapInArrow(_aligned, _PASSAGES)
    order = [x.split(" ")[0] for x in _PASSAGES.split(", ")]
    order = [order[0], order[3], *order[1:3], *order[4:]]
    return passages.unionByName(aligned).repartition("id").sortWithinPartitions(*order).mapInArrow(_chosen, _PASSAGES)


def _cut(text: int, spans: int, names: list[str], keep_empty: bool):
    """Cuts word ranges out of the text column; all other columns pass through."""

    def without(data: bytes, starts: np.ndarray, ends: np.ndarray, ranges: list[dict]) -> str:
        keep, done = [], 0
        for s in sorted(ranges, key=lambda x: (x["start_word"], x["end_word"])):
            lo, hi = max(done, min(s["start_word"], len(starts))), min(s["end_word"], len(starts))
            if lo < hi:
                keep.append(data[0 if not done else ends[done - 1]: starts[lo]])
                done = hi
        keep.append(data[0 if not done else ends[done - 1]:])
        return b" ".join(x.strip() for x in keep if x.strip()).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = batch.column(spans).to_pylist()
            out: list[str | None] = batch.column(text).to_pylist()
            rows = []
            for i, r in enumerate(ranges):
                if r and out[i]:
                    w = tb.words(pa.array([out[i]], pa.large_string()))
                    out[i] = without(out[i].encode(), w.start, w.end, r)
                    if not keep_empty and not len(tb.words(pa.array([out[i]], pa.large_string())).hash):
                        continue
                rows.append(i)
            columns = [pa.array(out, pa.string()) if c == text else batch.column(c) for c in range(batch.num_columns) if c != spans]
            yield pa.RecordBatch.from_arrays(columns, names=names).take(pa.array(rows, pa.int64()))

    return run


def without_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_empty: bool = True) -> DataFrame:
    """All documents and columns, with the passages cut out of their texts.

    What is left on both sides of a cut is joined by a space; a text that was
    wholly a passage becomes empty, or its row goes with ``keep_empty=False``.  Texts
    without passages, null and empty ones among them, and rows with a null id
    stay as they are; every row of a repeated id is cut.
    """
    spans = next(n for n in (f"spans{'_' * i}" for i in range(1_000)) if n not in docs.columns)
    found = passages.groupBy(F.col("id").alias(id_col)).agg(F.collect_set(F.struct("start_word", "end_word")).alias(spans))
    joined = docs.join(found, id_col, "left").select(*docs.columns, spans)
    return joined.mapInArrow(_cut(docs.columns.index(text_col), len(docs.columns), docs.columns, keep_empty), docs.schema)
