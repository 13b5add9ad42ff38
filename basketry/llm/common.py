"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import materialize, ship_code

__all__ = ["WHITE", "materialize", "set_aside", "ship_code", "table", "words"]

#: the white space of all word rules here: blank, tab, line feed, vertical tab, form feed, return
WHITE = " \t\n\x0b\f\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_code()
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """The runs of other characters than white space; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def set_aside(docs: DataFrame, *named: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but the named ones under names that no operator uses, and the columns
    that bring the old names back, in their order."""
    names = {c: f"aside{i}__" for i, c in enumerate(docs.columns) if c not in named}
    return docs.withColumnsRenamed(names), [F.col(names.get(c, c)).alias(c) for c in docs.columns]
