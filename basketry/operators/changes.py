"""Changes of a source table from two of its snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANGE = ["id", "text", "version", "op"]


def snapshot_changes(old: DataFrame, new: DataFrame, version: int, key: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, text, version, op)``: what turns ``old`` into ``new``, under one version.

    Rows are matched by key and compared by a hash of their text, so that of the old snapshot only keys
    and hashes travel. A key in both with another text and a key in the new one alone are upserts,
    a key in the old one alone is a delete. Keys must be unique in each snapshot and not null.
    """
    digest = F.md5(F.coalesce(F.concat(F.lit("t"), F.col(text_col)), F.lit("")))  # null is no empty text
    before = old.select(F.col(key).alias("_old"), digest.alias("_before"))
    after = new.select(F.col(key).alias("_new"), F.col(text_col).alias("text"), digest.alias("_after"))
    both = before.join(after, F.col("_old") == F.col("_new"), "full")
    changed = both.filter(F.col("_old").isNull() | F.col("_new").isNull() | (F.col("_before") != F.col("_after")))
    return changed.select(
        F.coalesce("_new", "_old").alias("id"),
        "text",
        F.lit(version).cast("long").alias("version"),
        F.when(F.col("_new").isNull(), "delete").otherwise("upsert").alias("op"),
    )
