"""Casts that do not fail, and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_or(value: Column, default: float = 0.0) -> Column:
    """As a double; the default where it is none."""
    return F.coalesce(value.try_cast("double"), F.lit(default))


def whole_or(value: Column, default: int = 0) -> Column:
    return F.coalesce(value.try_cast("bigint"), F.lit(default).cast("bigint"))


def truth_or(value: Column, default: bool = False) -> Column:
    return F.coalesce(value.try_cast("boolean"), F.lit(default))


def truncated(text: Column, limit: int = 1500) -> Column:
    """The first ``limit`` characters."""
    return F.substring(text, 1, limit)


def value_of(values: Column, key: str, default: object = None) -> Column:
    """The value of a key of a map; the default where the map is null or lacks it."""
    return F.coalesce(F.try_element_at(values, F.lit(key)), F.lit(default))


def merged(*maps: Column) -> Column:
    """One map of all keys; of a key in several the last map's value; null maps count as empty."""
    entries = F.flatten(F.array_compact(F.array(*(F.map_entries(m) for m in maps))))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)
