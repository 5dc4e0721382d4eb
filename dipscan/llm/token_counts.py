"""Operator 3: token counts of whole texts by a map-side two-tier lookup.

A byte-level BPE encodes every pre-token on its own, so a text's token count is
the sum of its pre-tokens' counts.  Tier one is a broadcast table of the most
frequent pre-tokens and their counts; tier two is a bounded cache in each Python
worker, filled by the library for misses.  No pre-token of the corpus is ever
shuffled: the frequent ones are found in about ``SAMPLE_ROWS`` rows, from one
bounded summary per task.

Only speed depends on the tables, not any count.  Texts that hold a special token's string, or
characters for which two regular-expression engines might disagree, are encoded
whole by the library.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb

# The split pattern of the byte-level pre-tokenizer.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters whose classes are the same in every engine and Unicode version.
PLAIN = r"[\t\n\r\x20-\x7e¡-ɏ‐-‧]*"

SAMPLE_ROWS, SAMPLE_SEED = 20_000, 5  # rows, drawn at random, that tier one is fitted on
TABLE_ROWS = 32_768  # tier one: at most this many pre-tokens are broadcast
SUMMARY_ROWS = 8_192  # rows of a task's summary
SUMMARY_ROOM = 200_000  # pre-tokens that a summary holds while it is made
CACHE_ROOM = 300_000  # tier two: entries in a worker

_worker: dict = {}


def _library(path: str):
    """The tokenizer and its special strings, loaded once in a worker."""
    if _worker.get("path") != path:
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        _worker.update(path=path, tokenizer=tokenizer, cache={}, split=regex.compile(PRE_TOKEN), plain=regex.compile(PLAIN), special=special)
    return _worker


def _lengths(tokenizer, texts: list[str]) -> list[int]:
    return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def _summaries(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _library(path)["split"]
        seen: Counter = Counter()
        for batch in batches:
            for _, texts in tb.blocks(batch.column(0)):
                for text in texts.to_pylist():
                    seen.update(split.findall(text))
                if len(seen) > SUMMARY_ROOM:
                    seen = Counter(dict(seen.most_common(SUMMARY_ROOM // 2)))
        top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:SUMMARY_ROWS]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["token", "n"])

    return run


def frequent_lengths(texts: DataFrame, path: str, rows: int = TABLE_ROWS) -> dict[str, int]:
    """Token counts of pre-tokens that a sample shows to be frequent; ``rows`` bounds what reaches the driver."""
    n = texts.count()
    texts = texts.where(F.rand(SAMPLE_SEED) < SAMPLE_ROWS / n) if n > SAMPLE_ROWS else texts
    found = texts.mapInArrow(_summaries(path), "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    top = [r.token for r in found.orderBy(F.desc("n"), "token").limit(rows).collect()]
    return dict(zip(top, _lengths(_library(path)["tokenizer"], top)))


def _counted(path: str, table: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = _library(path)
        first, cache, split, plain, tokenizer, special = table.value, lib["cache"], lib["split"].findall, lib["plain"].fullmatch, lib["tokenizer"], lib["special"]
        for batch in batches:
            counts: list[int] = []
            for _, block in tb.blocks(batch.column(1)):
                texts = block.to_pylist()
                whole = [not plain(t) or any(s in t for s in special) for t in texts]
                parts = [[] if w else split(t) for t, w in zip(texts, whole)]
                misses = list({p for ps in parts for p in ps if p not in first and p not in cache})
                if len(cache) + len(misses) > CACHE_ROOM:
                    cache.clear()
                    misses = list({p for ps in parts for p in ps if p not in first})
                cache.update(zip(misses, _lengths(tokenizer, misses)))
                rest = iter(_lengths(tokenizer, [t for t, w in zip(texts, whole) if w]))
                for ps, w in zip(parts, whole):
                    if w:
                        counts.append(next(rest))
                    else:
                        counts.append(sum([first[p] if p in first else cache[p] for p in ps]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row, in no order.

    A null text counts as empty (0 bytes, 0 tokens).  Null and repeated ids pass
    through, one result row for each input row.  Other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(source.select("text"), path))
    sized = source.withColumn("n_bytes", F.octet_length("text").cast("bigint"))

    inner = _counted(path, table)

    def with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in inner(iter([batch.select([0, 1])])):
                yield pa.RecordBatch.from_arrays([out.column(0), batch.column(2), out.column(1)], names=["id", "n_bytes", "n_tokens"])

    counted = sized.mapInArrow(with_bytes, "id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
