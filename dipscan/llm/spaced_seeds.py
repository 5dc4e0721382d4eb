"""Operator 9: benchmark decontamination by spaced-seed hashing.

Each mask keeps some positions of a window of words and ignores the others, so
a changed word leaves some masks' hashes as they were.  An item with fewer than
``MIN_WORDS`` words gives the hash of all its words as well, so one that stands whole in
a text is always found.

1.  Hashes of all items are a table.  A Bloom filter over them, of bounded size, tells
    each text which of its windows may be in it; all others end there.
2.  The windows that are left are joined with the items' hashes: text, item and diagonal.
3.  On each diagonal text and item are compared word by word, and the best stretch
    (+1 for equal words, -2 for others) must be long and similar enough.

Neither texts nor items pass through the driver, only the filter's bits do.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textblocks as tb
from .shared import written

#: 1: the word counts, 0: any word.
MASKS = ("111011", "1101011", "11001101")
MIN_WORDS = 12  # of a stretch; an item with fewer words must match whole
MIN_SHARE = 0.75  # of equal words in a stretch
FILTER_BITS = (1 << 22, 1 << 28)  # at least and at most; a fuller filter lets more windows through to the join
BITS_PER_SEED = 64
SHIFTS = (0, 18, 36)  # of a hash, for its bits in the filter
SPANS = 256  # that share one copy of a text

_U = np.uint64


def _seeds_of(w: tb.Words, mask: int) -> tuple[np.ndarray, np.ndarray]:
    pattern = MASKS[mask]
    n = len(w.hash) - len(pattern) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = np.full(n, mask + 1, dtype=np.uint64)
    for j, kept in enumerate(pattern):
        if kept == "1":
            value *= _U(0x9E3779B97F4A7C15)
            value += w.hash[j: j + n]
    at = np.flatnonzero(w.doc[:n] == w.doc[len(pattern) - 1:])
    return at, tb.mix(value[at])


def _windows(w: tb.Words, whole: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of all masked windows, and of all windows of the lengths in ``whole``."""
    found = [_seeds_of(w, m) for m in range(len(MASKS))]
    for n in whole:
        at, value = tb.grams(w, n)
        found.append((at, tb.mix(value ^ _U(n))))
    return np.concatenate([a for a, _ in found]), np.concatenate([s for _, s in found])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, block in tb.blocks(batch.column(1)):
            w = tb.words(block)
            first = w.first
            size = np.diff(first)
            at, seed = _windows(w, range(1, MIN_WORDS))
            masked = sum(len(_seeds_of(w, m)[0]) for m in range(len(MASKS)))
            # of the unmasked windows those count that are a whole item
            length = np.repeat(np.arange(1, MIN_WORDS), [len(tb.grams(w, n)[0]) for n in range(1, MIN_WORDS)])
            keep = np.append(np.ones(masked, dtype=bool), size[w.doc[at[masked:]]] == length)
            at, seed = at[keep], seed[keep]
            doc = w.doc[at]
            yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), batch.column(0).slice(row, len(block)).take(pa.array(doc)), pa.array((at - first[doc]).astype(np.int32))], names=["seed", "item", "at"])


def _as_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the texts' word hashes, 8 bytes each, in place of the texts."""
    for batch in batches:
        for row, block in tb.blocks(batch.column(batch.num_columns - 1)):
            w = tb.words(block)
            data, at = w.hash.astype("<u8").tobytes(), w.first * 8
            own = [batch.column(i).slice(row, len(block)) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array([data[a:b] for a, b in zip(at, at[1:])], pa.binary())], names=[*batch.schema.names[:-1], "words"])


_HITS = "text bigint, id bigint, words binary, hits array<struct<pos:int,seed:bigint>>"


def _hits(filters: Broadcast, whole: Sequence[int]):
    """Texts with a window that may be in the benchmark, and these windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filters.value
        mask = _U(8 * len(bits) - 1)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0)
            for row, block in tb.blocks(batch.column(1)):
                w = tb.words(block)
                at, seed = _windows(w, whole)
                for shift in SHIFTS:
                    spot = (seed >> _U(shift)) & mask
                    keep = (bits[(spot >> _U(3)).astype(np.int64)] >> (spot & _U(7)).astype(np.uint8)) & 1 > 0
                    at, seed = at[keep], seed[keep]
                order = np.argsort(at, kind="stable")
                at, seed = at[order], seed[order]
                doc = w.doc[at]
                own, count = np.unique(doc, return_counts=True)
                pos = pa.array((at - w.first[doc]).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.StructArray.from_arrays([pos, pa.array(seed.view(np.int64))], names=["pos", "seed"]))
                data = w.hash.astype("<u8")
                words = [data[w.first[d]: w.first[d + 1]].tobytes() for d in own]
                yield pa.RecordBatch.from_arrays([pa.array(number + own), ids.take(pa.array(row + own)), pa.array(words, pa.binary()), lists], names=["text", "id", "words", "hits"])
                number += len(block)

    return run


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, id, its words, spans of item, shift and words) to the words of each span."""
    for batch in batches:
        for text, i, words, spans in zip(*batch.columns):
            data = words.as_buffer().to_pybytes()
            rows = [(text.as_py(), i.as_py(), s["item"], s["shift"], data[8 * max(0, s["shift"]): 8 * max(0, s["shift"] + s["n"])]) for s in spans.as_py()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["text", "id", "item", "shift", "part"])


def _stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, end, equal words) of the best stretch at +1 and -2."""
    total = np.append(0, np.cumsum(np.where(equal, 1, -2)))
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total[1:] - low[:-1])) + 1
    start = int(np.argmin(total[:end]))
    return start, end, int(equal[start:end].sum())


_STRETCH = "text bigint, id bigint, item bigint, item_id bigint, start_word int, end_word int, item_start int, equal_words int"
_TYPES = [pa.int64()] * 4 + [pa.int32()] * 4


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, i, item, shift, part, item_id, words in zip(*(c.to_pylist() for c in batch.columns)):
            here, there = np.frombuffer(part, "<u8"), np.frombuffer(words, "<u8")
            skip = max(0, -shift)
            n = min(len(here), len(there) - skip)
            if n <= 0:
                continue
            a, b, same = _stretch(here[:n] == there[skip: skip + n])
            if b - a >= min(MIN_WORDS, len(there)) and same >= MIN_SHARE * (b - a):
                lo = max(0, shift)
                rows.append((text, i, item, item_id, lo + a, lo + b, skip + a, same))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=[x.split(" ")[0] for x in _STRETCH.split(", ")])


def _filter(seeds: DataFrame) -> np.ndarray:
    """A Bloom filter of the seeds as bytes; its size is bounded whatever their number."""
    size = FILTER_BITS[0]
    n = seeds.count()
    while size < min(FILTER_BITS[1], BITS_PER_SEED * n):
        size *= 2
    spots = F.array(*[F.shiftrightunsigned("seed", s).bitwiseAND(F.lit(size - 1)) for s in SHIFTS])
    one = F.expr("shiftleft(1L, CAST(spot & 63 AS INT))")
    found = seeds.select(F.explode(spots).alias("spot")).groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(one).alias("value")).toArrow()
    words = np.zeros(size // 64, dtype="<i8")
    words[found["word"].to_numpy()] = found["value"].to_numpy()
    return words.view(np.uint8)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each text and item that overlap: the longest such stretch.

    Words are lower-cased runs between white space.  A stretch has ``MIN_WORDS`` words, or
    all of a shorter item, and ``MIN_SHARE`` of them are equal.  Items that stand
    whole and unchanged in a text are always found; with changed words one window
    of some mask must be left.  Null and empty texts and items overlap with
    nothing.  Rows with a null id on either side are left out; a repeated id
    gives one row for each of its rows.  An empty benchmark or table gives no
    rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.monotonically_increasing_id().alias("item"), F.col(item_col).cast("bigint").alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    items = written(items, "items")
    words = written(items.select("item", "item_id", "text").mapInArrow(_as_words, "item bigint, item_id bigint, words binary").where("length(words) > 0"), "item-words")
    seeds = written(items.select("item", "text").mapInArrow(_item_seeds, "seed bigint, item bigint, at int"), "seeds")
    size = F.floor(F.length("words") / 8).cast("int")
    whole = [r.n for r in words.select(size.alias("n")).where(F.col("n") < MIN_WORDS).distinct().collect()]
    filters = spark.sparkContext.broadcast(_filter(seeds))
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    texts = written(source.mapInArrow(_hits(filters, sorted(whole)), _HITS), "hits")

    met = texts.select("text", F.explode("hits").alias("h")).select("text", "h.pos", "h.seed").join(seeds, "seed")
    met = met.select("text", "item", (F.col("pos") - F.col("at")).alias("shift")).distinct().join(words.select("item", size.alias("n")), "item")
    place = F.row_number().over(Window.partitionBy("text").orderBy("item", "shift"))
    spans = met.withColumn("block", F.floor((place - 1) / SPANS)).groupBy("text", "block").agg(F.collect_list(F.struct("item", "shift", "n")).alias("spans"))
    parts = spans.join(texts.select("text", "id", "words"), "text").select("text", "id", "words", "spans").mapInArrow(_sliced, "text bigint, id bigint, item bigint, shift int, part binary")
    # the merge join keeps the two Python steps in stages of their own, so a task holds one worker
    found = parts.join(words.hint("merge"), "item").select("text", "id", "item", "shift", "part", "item_id", "words").mapInArrow(_compared, _STRETCH)
    best = F.max(F.struct("equal_words", (-F.col("start_word")).alias("early"), "start_word", "end_word", "item_start")).alias("b")
    found = found.groupBy("text", "item", "id", "item_id").agg(best)
    return found.select("id", "item_id", "b.start_word", "b.end_word", "b.item_start", "b.equal_words")
