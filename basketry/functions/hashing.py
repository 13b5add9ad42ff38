"""Hashes that any engine with md5 can recompute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_bucket(*cols: str | Column, buckets: int = 100) -> Column:
    """A bucket 0 .. buckets-1 from the md5 of the values, joined by colons."""
    digest = F.md5(F.concat_ws(":", *cols))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(buckets))
