"""Tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketry.functions.arrays import _col


def tokens(text: str | Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(_col(text)), r"[^\p{L}\p{N}]+"), "")
