"""Operator 12: a Merkle manifest of a table, with its nodes in a level-partitioned Parquet store.

A leaf is the hash of a row's fields.  Leaves of one group stand in order; every
``FAN`` consecutive nodes (the last run may be shorter, even a single one) hash
to one node of the next level until one is left, the group's subroot.  Subroots
in order of their groups make the tree above in the same way.

*Store.*  Each level is one folder of Parquet, ``level=0`` the leaves.  A node's
coordinate is (tree, place in its level).  A level is made by reading the one
below it once, in order: parts hold whole chunks of ``FAN ** BAND`` places, sorted
by coordinate, and a task folds runs as they stream by, so it holds one run.
A group with most rows is many chunks.

*Proofs.*  Levels are merged in bands of ``BAND`` from the top down.  For each
chunk of a band a task reads the path of the chunk's apex, then its inner levels,
then its lowest nodes, each sorted by coordinate, and hands every lowest node its
path.  A task holds the ``FAN ** (BAND - 1) + ...`` inner nodes of one chunk; whole
paths exist for the nodes of every ``BAND``-th level only, never for all leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running
from .shared import shared_folder, width, written

FAN, BAND = 8, 4
DIGEST = 64  # characters of a hexadecimal SHA-256
NODE = "tree bigint, pos bigint, n bigint, hash string"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_hash(columns: Sequence[Column]) -> Column:
    """SHA-256 over the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    fields = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields]), 256)


@dataclass
class Manifest:
    """Levels of the groups' trees and of the tree above them; ``groups`` has (group, tree, n, subroot)."""

    leaves: DataFrame  # the rows given, with tree, pos and n
    levels: list[DataFrame]
    above: list[DataFrame]
    groups: DataFrame
    root: str | None  # None for an empty table


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes in order of their coordinates to the nodes of the next level."""
    at, run = None, []
    for batch in batches:
        out = []
        for tree, pos, n, digest in zip(*[c.to_pylist() for c in batch.columns]):
            if (tree, pos // FAN, n) != at:
                if run:
                    out.append((*at, _hash("".join(run))))
                at, run = (tree, pos // FAN, n), []
            run.append(digest)
        if out:
            yield _nodes(out)
    if run:
        yield _nodes([(*at, _hash("".join(run)))])


def _nodes(rows: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
    tree, pos, n, digest = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(tree, pa.int64()), pa.array(pos, pa.int64()), pa.array([-(-x // FAN) for x in n], pa.int64()), pa.array(digest)], names=["tree", "pos", "n", "hash"])


def _levels(nodes: DataFrame, largest: int, name: str) -> list[DataFrame]:
    """The node store of trees whose largest has so many lowest nodes; a level holds the trees that reach it."""
    spark = nodes.sparkSession
    folder = shared_folder(spark, name)

    def kept(level: DataFrame, k: int) -> DataFrame:
        level.write.parquet(f"{folder}/level={k}")
        return spark.read.schema(level.schema).parquet(f"{folder}/level={k}")

    found = [kept(nodes.select("tree", "pos", "n", "hash"), 0)]
    while largest > 1:
        dealt = found[-1].where("n > 1").repartition(width(spark), "tree", F.expr(f"pos div {FAN ** BAND}"))
        found.append(kept(dealt.sortWithinPartitions("tree", "pos").mapInArrow(_folded, NODE), len(found)))
        largest = -(-largest // FAN)
    return found


def _tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, top, hash) of every tree."""
    return reduce(DataFrame.unionByName, [x.where("n = 1").select("tree", F.lit(k).alias("top"), "hash") for k, x in enumerate(levels)])


def build(rows: DataFrame, group: str, order: Sequence[str], leaf: str = "leaf") -> Manifest:
    """The manifest of rows that have their leaf already.

    Groups are ordered by value, UTF-8 bytewise, null first; rows of a group by
    ``order``, null first, then by leaf, so rows that repeat change nothing.
    """
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col(leaf)]
    placed = written(running(rows, keys, {"place": F.lit(1).cast("bigint")}), "placed")
    groups = placed.groupBy(group).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    groups = written(running(groups, ["first"], {"tree": F.lit(1).cast("bigint")}).withColumn("tree", F.col("tree") - 1), "groups")
    largest, trees = groups.agg(F.max("n"), F.count("*")).first()
    kin = groups.select(F.col(group).alias("kin"), "tree", "n", "first")
    leaves = placed.join(kin, placed[group].eqNullSafe(kin["kin"])).withColumn("pos", F.col("place") - F.col("first")).drop("kin", "place", "first")
    leaves = written(leaves, "leaves")
    levels = _levels(leaves.withColumn("hash", F.col(leaf)), largest or 0, "store")
    tops = written(_tops(levels), "subroots")
    above = _levels(tops.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.lit(trees).cast("bigint").alias("n"), "hash"), trees, "store")
    root = above[-1].where("n = 1").first()
    groups = groups.join(tops, "tree").select(group, "tree", "n", "top", F.col("hash").alias("subroot"))
    return Manifest(leaves, levels, above, written(groups, "groups"), root["hash"] if root else None)


def siblings(path: str) -> Iterator[tuple[int, list[str]]]:
    """(own place in its run, the others in order) for each level of a path, from the leaf up."""
    at = 0
    while at < len(path):
        own, others = int(path[at]), int(path[at + 1])
        at += 2
        yield own, [path[at + DIGEST * i: at + DIGEST * (i + 1)] for i in range(others)]
        at += DIGEST * others


def fold(leaf: str, levels: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf has with these siblings."""
    for own, others in levels:
        leaf = _hash("".join([*others[:own], leaf, *others[own:]]))
    return leaf


def _merged(base: int, last: bool):
    """Chunks of a band, each as apex, inner levels, lowest nodes, to the lowest nodes with their paths.

    At the leaves the result is digests: of the siblings, and the root refolded from ``other``.
    """

    def step(own: int, run: list[str]) -> str:
        return f"{own}{len(run) - 1}{''.join(run[:own])}{''.join(run[own + 1:])}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, inner, tail, pending, out = None, {}, "", [], []

        def path(level: int, pos: int) -> str:
            """What follows a place's own run, from the level above it to the root."""
            up = inner.get((level + 1, pos // FAN // FAN))
            if up is None:
                return tail
            return step(pos // FAN % FAN, up) + path(level + 1, pos // FAN)

        def flush() -> None:
            hashes = [x[1] for x in pending]
            up = path(base, pending[0][0]) if pending else ""
            shared = list(siblings(up)) if last else []
            above = "".join(h for _, others in shared for h in others)
            for own, (pos, digest, key, other) in enumerate(pending):
                if not last:
                    out.append((chunk[0], pos, sub, step(own, hashes) + up))
                    continue
                rest = hashes[:own] + hashes[own + 1:]
                out.append((key, digest, sub, _hash("".join(rest) + above), fold(other, [(own, rest), *shared])))
            pending.clear()

        sub = ""
        for batch in batches:
            for tree, part, level, pos, digest, above, key, other in zip(*[c.to_pylist() for c in batch.columns]):
                if pending and ((tree, part) != chunk or level != base or pos // FAN != pending[0][0] // FAN):
                    flush()
                if (tree, part) != chunk:
                    chunk, inner = (tree, part), {}
                if level > base + BAND:  # the apex: its subroot and path
                    sub, tail, top = digest, above, level == base + BAND + 2
                    # a tree whose lowest node of this band is its top has no run below it
                    if top and pos == base:
                        if last:
                            shared = list(siblings(tail))
                            out.append((key, sub, sub, _hash("".join(h for _, o in shared for h in o)), fold(other, shared)))
                        else:
                            out.append((tree, 0, sub, tail))
                elif level > base:
                    inner.setdefault((level, pos // FAN), []).append(digest)
                else:
                    pending.append((pos, digest, key, other))
            if out:
                yield table(out)
                out.clear()
        if pending:
            flush()
        if out:
            yield table(out)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [("row", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())] if last else [("tree", pa.int64()), ("pos", pa.int64()), ("sub", pa.string()), ("path", pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])

    return run


def _paths(levels: list[DataFrame], tops: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """(tree, pos, sub, path) of the lowest nodes; with ``leaves`` (tree, pos, n, hash, key, other) their digests.

    ``tops`` has (tree, top, sub, path): each tree's topmost level, its root and that root's own path.
    """
    spark = levels[0].sparkSession
    nothing = F.lit(None).cast("string")
    found = None
    for base in reversed(range(0, len(levels), BAND)):
        last = leaves is not None and base == 0
        rows = []
        for k in range(base, min(base + BAND, len(levels))):
            own = last and k == 0
            level = (leaves if own else levels[k]).where("n > 1")
            rows.append(level.select("tree", F.expr(f"pos div {FAN ** (BAND - (k - base))}").alias("part"), F.lit(k).alias("level"), "pos", "hash", nothing.alias("path"), *([F.col("key"), F.col("other")] if own else [F.lit(None).cast("bigint").alias("key"), nothing.alias("other")])))
        ending = tops.where(F.col("top").between(base, base + BAND - 1))
        if last:
            # a tree of one leaf carries that leaf's key
            alone = leaves.where("n = 1").select(F.col("tree").alias("lone"), "key", "other")
            ending = ending.join(alone, ending["tree"] == alone["lone"], "left")
        else:
            ending = ending.withColumns({"key": F.lit(None).cast("bigint"), "other": nothing})
        zero = F.lit(0).cast("bigint")
        rows.append(ending.select("tree", zero.alias("part"), F.lit(base + BAND + 2).alias("level"), F.col("top").cast("bigint").alias("pos"), F.col("sub").alias("hash"), "path", "key", "other"))
        if found is not None:
            rows.append(found.select("tree", F.col("pos").alias("part"), F.lit(base + BAND + 1).alias("level"), "pos", F.col("sub").alias("hash"), "path", F.lit(None).cast("bigint").alias("key"), nothing.alias("other")))
        dealt = reduce(DataFrame.unionByName, rows).repartition(width(spark), "tree", "part").sortWithinPartitions("tree", "part", F.desc("level"), "pos")
        schema = "row bigint, leaf string, subroot string, proof_sha256 string, folded_root string" if last else "tree bigint, pos bigint, sub string, path string"
        found = dealt.mapInArrow(_merged(base, last), schema)
        if not last:
            found = written(found, "paths")
    return found


def group_paths(manifest: Manifest) -> DataFrame:
    """(tree, top, sub, path): the subroot of each group and its path to the root."""
    spark = manifest.groups.sparkSession
    end = spark.createDataFrame([(0, len(manifest.above) - 1, "", "")], "tree bigint, top int, sub string, path string")
    up = _paths(manifest.above, end).select(F.col("pos").alias("tree"), "path")
    return manifest.groups.select("tree", "top", F.col("subroot").alias("sub")).join(up, "tree")


def paths(manifest: Manifest) -> DataFrame:
    """(tree, pos, sub, path): every leaf's subroot and siblings, as ``siblings`` reads them."""
    return _paths(manifest.levels, group_paths(manifest))


def checked(manifest: Manifest, key: str, leaf: str, other: str) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``other`` is the leaf that is presented with the row's siblings; the proof holds where it is the leaf of the store.
    """
    leaves = manifest.leaves.select("tree", "pos", "n", F.col(leaf).alias("hash"), F.col(key).cast("bigint").alias("key"), F.col(other).alias("other"))
    found = _paths(manifest.levels, group_paths(manifest), leaves)
    root = F.lit(manifest.root).cast("string")
    return found.select(F.col("row").alias(key), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def documents_manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), a row for each document.

    Leaves hash doc_id, source, lang, n_chars and text; groups are languages.
    ``changed`` is the text that is presented at verification (the stored one if
    not given).  Null fields hash as ``-``; a null language is a group of its own
    and the first; rows with a null id come first in their group; rows that
    repeat are leaves of their own; other columns are not read.  An empty table
    gives no rows.
    """
    text = F.col("text")
    leaf = lambda t: leaf_hash([F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [t])
    rows = docs.select("doc_id", "lang", leaf(text).alias("leaf"), leaf(text if changed is None else changed).alias("other"))
    return checked(build(rows, "lang", ["doc_id"]), "doc_id", "leaf", "other")
