"""Operator 5: URL rules by a cascade of Bloom filters, in DataFrame functions only.

Every url has a small set of keys: each suffix of its host that has as many labels as
some rule's host, with each prefix of its path that has the length of some rule's path.
A rule fits a url just if the rule's key is among the url's keys, so judging a url is membership of
its keys in the list.  However long a host is, it has no more keys than the rules have shapes.

Level 1 encodes the listed keys.  Level 2 encodes the keys of the corpus that
pass level 1 without being listed, level 3 the listed keys that pass level 2, and
so on until nothing is wrong, however many levels that takes.  Over the key
universe that it was built on the cascade is exact, and judging takes no join:
each level is one binary literal.  Level 1 takes bits for each listed key by the logarithm of
the universe over the list, so that about one wrong key for ``RIGHT`` listed ones passes;
the literals together follow the list, which the caller holds, and that logarithm.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

RIGHT = 16
HASHES = 7  # at least; a half full filter has as many as its bits for each key times ln 2
BITS_PER_KEY = 32  # of level 1, at least; later levels hold few keys and take half of it
LATER_BITS_PER_KEY = 16

# The rules of the registered query, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, A-Z lower-cased, and path; both empty without one."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + F.lit(3), F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def url_keys(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """Keys (host suffix of so many labels, then path prefix of such a length) of a url, each once."""
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    suffixes = F.filter(F.array(*[F.when(dots + 1 >= n, F.substring_index(host, ".", -n)) for n in labels]), lambda s: s.isNotNull())
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.when(host != "", F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def _position(key: Column, bits: int, level: int, i: Column) -> Column:
    """The i-th bit position of a key; a hash of its own for each, as steps of one hash repeat in a small filter."""
    return F.pmod(F.xxhash64(F.lit(level), i, key), F.lit(bits))


class Level:
    """One Bloom filter: its bits as a binary literal."""

    def __init__(self, keys: DataFrame, level: int, per_key: int) -> None:
        self.level, self.hashes = level, max(HASHES, round(per_key * math.log(2)))
        self.n = keys.count()
        self.bits = 64 * max(16, math.ceil(self.n * per_key / 64))
        at = keys.select(F.explode(F.transform(self._each(), lambda i: _position(F.col("key"), self.bits, level, i))).alias("at"))
        one = F.expr("shiftleft(1L, CAST(pmod(at, 64) AS INT))")
        self.words = bytearray(self.bits // 8)
        for r in at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(one).alias("value")).collect():
            self.words[8 * r.word: 8 * r.word + 8] = r.value.to_bytes(8, "little", signed=True)

    def _each(self) -> Column:
        return F.array(*[F.lit(i) for i in range(self.hashes)])

    def holds(self, key: Column) -> Column:
        """Positions are looked at one after the other, up to the first that is not set."""
        words = F.lit(bytes(self.words))

        def hit(i: Column) -> Column:
            p = _position(key, self.bits, self.level, i)
            byte = words.substr((F.floor(p / 8) + 1).cast("int"), F.lit(1))
            return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(p, F.lit(8)).cast("int")) == 1

        return F.forall(self._each(), hit)


class Cascade:
    """Exact membership in ``listed`` for every key of ``universe``; level 1 has so many bits for each listed key."""

    def __init__(self, listed: DataFrame, universe: DataFrame, per_key: int | None = None) -> None:
        listed = listed.select("key").distinct()
        self.levels: list[Level] = []
        wanted, others = listed, universe.select("key")
        per_key = BITS_PER_KEY if per_key is None else per_key
        while True:
            level = Level(wanted, len(self.levels), per_key)
            if not level.n:
                break
            self.levels.append(level)
            passing = others.where(level.holds(F.col("key"))).distinct()
            if len(self.levels) == 1:
                passing = passing.join(listed, "key", "left_anti")
                per_key = min(per_key, LATER_BITS_PER_KEY)
            elif len(self.levels) > 2 and level.n >= self.levels[-3].n:
                per_key *= 2  # as many wrong keys as a round before
            wanted, others = written(passing, "cascade"), wanted

    def holds(self, key: Column) -> Column:
        """A key is listed if the number of levels that it passes in turn is odd."""
        found: Column = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            found = F.when(level.holds(key), found if i + 1 < len(self.levels) else F.lit(i % 2 == 0)).otherwise(F.lit(i % 2 == 1))
        return found


def bits_per_key(universe: int, listed: int) -> int:
    """Bits of level 1 for each listed key, so that about one key of the universe passes wrongly for ``RIGHT`` listed ones."""
    return max(BITS_PER_KEY, math.ceil(math.log2(max(1, RIGHT * universe / max(1, listed))) / math.log(2)))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict): the longest rule that fits, else ``allow``.

    Null urls and urls without ``://`` have an empty host and path and fit no
    rule.  Null and repeated ids pass through, one result row for each input
    row.  Of rules with the same host and path the last one counts.  A url that
    no rule fits has none of its keys in the cascades and is allowed.
    """
    spark = pages.sparkSession
    wins = {h + p: v for v, h, p in rules}
    lengths, labels = sorted({len(p) for _, _, p in rules}), sorted({h.count(".") + 1 for _, h, _ in rules})
    host, path = host_path(F.col(url_col))
    source = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    keyed = source.withColumn("keys", url_keys(F.col("host"), F.col("path"), labels, lengths))
    universe = keyed.select(F.explode("keys").alias("key"))
    size = keyed.agg(F.sum(F.size("keys"))).first()[0] or 0  # repeats count, so a bound
    found = {}
    for verdict in ("allow", "block"):
        own = [k for k, v in wins.items() if v == verdict]
        if own:
            mark = next(c for c in map(chr, range(0xE000, 0xF900)) if not any(c in k for k in own))
            values = F.split(F.lit(mark.join(own)), mark)
            found[verdict] = Cascade(spark.range(1).select(F.explode(values).alias("key")), universe, bits_per_key(size, len(own)))

    def matches(verdict: str, cascade: Cascade) -> Column:
        return F.transform(F.filter("keys", cascade.holds), lambda k: F.struct(F.length(k).alias("n"), k.alias("key"), F.lit(verdict).alias("verdict")))

    hits = [matches(v, c) for v, c in found.items()]
    best = F.array_max(F.concat(*hits)) if hits else F.lit(None).cast("struct<n:int,key:string,verdict:string>")
    judged = keyed.withColumn("best", best)
    return judged.select("id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
