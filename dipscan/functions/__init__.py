"""Scalar expressions: identifiers, labels, folding, safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Catalogue dispositions and their class numbers.
DISPOSITION_LABELS = {"PC": 0, "KP": 0, "CP": 0, "APC": 0, "EB": 1, "BEB": 2, "SB2": 1, "V": 3, "FA": 3, "FP": 3, "NEB": 3, "O": 3, "U": 3}
# Quality bits that make a cadence unusable.
BAD_QUALITY = 1 | 2 | 4 | 8 | 16 | 512
# Upper radius of each size class, in Earth radii; the name without a radius and beyond the last.
SIZE_CLASSES = ((1.25, "Earth-size"), (2.0, "Super-Earth"), (6.0, "Neptune-size"), (15.0, "Jupiter-size"))
SIZE_UNKNOWN, SIZE_BEYOND = "unknown", "too large for a planet (likely stellar companion)"


def norm_id(x: Column) -> Column:
    """``TIC 12``, ``TIC_12`` and ``12.0`` to ``12``; synthetic ids stay."""
    return F.regexp_replace(F.trim(x), r"^(TIC_|TIC )|\.0$", "")


def disposition_label(d: Column) -> Column:
    """Class of a disposition; null counts as ``U``, anything unknown as 3."""
    table = F.create_map(*[F.lit(v) for kv in DISPOSITION_LABELS.items() for v in kv])
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(F.coalesce(d, F.lit("U"))))), F.lit(3))


def finite(*xs: Column) -> Column:
    """True where every value is neither null, NaN nor infinite."""
    out = F.lit(True)
    for x in xs:
        out = out & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return out


def no_nan(x: Column) -> Column:
    """NaN and infinities as null, so that aggregates skip them."""
    return F.when(finite(x), x)


def phase(t: Column, period: Column, t0: Column) -> Column:
    """Phase in (-0.5, 0.5]; 0 is mid-dip."""
    raw = (t - t0) / period - F.floor((t - t0) / period)
    return F.when(raw > 0.5, raw - 1).otherwise(raw)


def hours_from_mid(t: Column, period: Column, t0: Column) -> Column:
    x = t - t0 + period / 2
    return (x - F.floor(x / period) * period - period / 2) * 24


def nearest_epoch(t: Column, period: Column, t0: Column) -> Column:
    """Number of the nearest epoch; halves go to the even one."""
    return F.rint((t - t0) / period).cast("bigint")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return a / F.nullif(b, F.lit(0.0))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def bin_index(x: Column, lo: float, hi: float, n: int) -> Column:
    """Bin 0..n-1, null outside [lo, hi): the upper edge falls out."""
    b = F.width_bucket(x, F.lit(lo), F.lit(hi), F.lit(n)).cast("int") - 1
    return F.when((b >= 0) & (b < n), b)


def size_class(radius: Column) -> Column:
    out = F.when(radius.isNull() | F.isnan(radius), SIZE_UNKNOWN)
    for top, name in SIZE_CLASSES:
        out = out.when(radius < top, name)
    return out.otherwise(SIZE_BEYOND)
