"""Parts of ordered lists, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_items(items: str | Column, n: int) -> Column:
    return F.slice(_col(items), 1, n)


def remaining_items(items: str | Column, n: int) -> Column:
    """Everything after the first ``n``; empty for a shorter list."""
    return F.slice(_col(items), F.lit(n + 1), F.greatest(F.size(_col(items)) - n, F.lit(0)))


def last_items(items: str | Column, n: int) -> Column:
    """The last ``n``, or the whole list when it is shorter."""
    return F.when(F.size(_col(items)) > n, F.slice(_col(items), -n, n)).otherwise(_col(items))


def append_item(items: str | Column, item: str | Column) -> Column:
    return F.concat(_col(items), F.array(_col(item)))


def lookup(mapping: str | Column, key: str | Column, default: str = "") -> Column:
    """Value of a small map column, with a default for a missing key."""
    return F.coalesce(F.try_element_at(_col(mapping), _col(key)), F.lit(default))
