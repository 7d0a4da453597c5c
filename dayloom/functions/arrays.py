"""Arrays as small sets and lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add_if_absent(arr, item) -> Column:
    """Appends the trimmed item unless it is blank or there already."""
    x = F.btrim(item)
    return F.when((x == "") | F.array_contains(arr, x), arr).otherwise(F.array_append(arr, x))


def add(arr, item) -> Column:
    return F.array_append(arr, item)


def without(arr, item) -> Column:
    return F.array_remove(arr, item)


def without_at(arr, position: int) -> Column:
    return F.filter(arr, lambda _, i: i != position)


def any_contains(arr, text: str) -> Column:
    """Whether an element holds the text, whatever the case."""
    return F.exists(arr, lambda x: F.contains(F.lower(x), F.lit(text.lower())))


def first_or(arr, default) -> Column:
    return F.coalesce(F.get(arr, F.lit(0)), default if isinstance(default, Column) else F.lit(default))


def lookup(codes: dict, code, default=None) -> Column:
    """The value of a code in a small fixed table."""
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code), F.lit(default))


def known_or_mapped(code, known, old: dict, default) -> Column:
    """A code that is known stays; an old one becomes what it maps to; any other the default."""
    return F.when(code.isin(*known), code).otherwise(lookup(old, code, default))


def entries(counts) -> Column:
    """A map's entries as an array of ``key`` and ``value``, by key."""
    return F.array_sort(F.map_entries(counts))


def random_pick(options, *seed) -> Column:
    """One of an array's elements (null for an empty one), chosen by an MD5 of the seed columns: reruns agree."""
    n = F.size(options)
    number = F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in seed])), 1, 8), 16, 10).cast("long")
    return F.when(n > 0, F.get(options, (number % n).cast("int")))
