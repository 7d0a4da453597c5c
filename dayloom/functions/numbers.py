"""Numbers as they are shown. Results keep raw values; these are for presentation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x, places: int) -> Column:
    """Fixed decimals, rounding the exact binary value (1.45 gives 1.4). For values below 10**12."""
    size = F.abs(x)
    part = ((size - F.floor(size)) * float(1 << 60)).cast("long").cast("decimal(20,0)") / F.lit(1 << 60).cast("decimal(20,0)")
    exact = F.floor(size).cast("decimal(12,0)") + F.round(part, places).cast(f"decimal(20,{places})")
    return F.concat(F.when(x < 0, "-").otherwise(""), exact.cast(f"decimal(24,{places})").cast("string"))


def signed_amount(kind, amount) -> Column:
    return F.when(kind == "credit", amount).otherwise(-amount)


def mean_or_zero(total, n) -> Column:
    return F.when(n > 0, total / n).otherwise(0.0)


def bar_percent(scale) -> Column:
    return scale * 10


def clamp(x, lo, hi) -> Column:
    return F.greatest(F.least(x, hi), lo)
