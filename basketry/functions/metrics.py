"""Ranking metrics: relevance, precision@k, average precision, MAP@k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.arrays import _col, first_items

LONG_CHUNK = 100_000  # ranks of a list that one task numbers


def binary_relevance(recommendations: str | Column, truth: str | Column, distinct: bool = False) -> Column:
    """1 where the recommendation is in the truth, else 0. A repeat counts again unless ``distinct``."""
    recs, truth = _col(recommendations), _col(truth)

    def hit(item, i):
        found = F.array_contains(truth, item)
        if distinct:
            found = found & (F.array_position(recs, item) == i + 1)
        return F.coalesce(found, F.lit(False)).cast("int")

    return F.transform(recs, hit)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda total, x: total + x)


def precision_at_k(relevance: str | Column, k: int) -> Column:
    """Hits among the first ``k``, divided by ``k`` even when the list is shorter."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return _sum(first_items(relevance, k)) / F.lit(k)


def average_precision(
    relevance: str | Column, normalize: str = "hits", relevant: str | Column | None = None
) -> Column:
    """Mean of precision at the positions of the hits, 0 without a hit.

    ``normalize="relevant"`` divides by ``relevant``, the number of true items, instead.
    """
    zero = F.struct(
        F.lit(0).cast("long").alias("seen"),
        F.lit(0).cast("long").alias("hits"),
        F.lit(0.0).alias("total"),
    )

    def step(acc, rel):
        seen, hits = acc["seen"] + 1, acc["hits"] + rel
        return F.struct(
            seen.alias("seen"), hits.alias("hits"), (acc["total"] + rel * hits / seen).alias("total")
        )

    acc = F.aggregate(_col(relevance), zero, step)
    divisor = acc["hits"] if normalize == "hits" else _col(relevant)
    return F.when(acc["hits"] > 0, acc["total"] / divisor).otherwise(F.lit(0.0))


def map_at_k(evaluated: DataFrame, k: int, relevance: str = "relevance") -> DataFrame:
    """One row ``(k, users, map_at_k)``; the mean over no rows is null."""
    ap = average_precision(first_items(relevance, k))
    return evaluated.agg(F.count(F.lit(1)).alias("users"), F.avg(ap).alias("map_at_k")).select(
        F.lit(k).alias("k"), "users", "map_at_k"
    )


def format_map(k: int, value: str | Column) -> Column:
    return F.format_string(f"MAP@{k}: %.2f", _col(value))


def long_relevance(recommended: DataFrame, truth: DataFrame, user: str = "user_id") -> DataFrame:
    """``(user, rank, rel)`` of rows ``(user, rank, item)`` against rows ``(user, item)``, for lists of any length."""
    known = truth.select(user, F.col("item"), F.lit(1).alias("rel")).distinct()
    found = recommended.select(user, "rank", "item").join(known, [user, "item"], "left")
    return found.select(user, "rank", F.coalesce("rel", F.lit(0)).alias("rel"))


def average_precision_long(relevance: DataFrame, user: str = "user_id", chunk: int = LONG_CHUNK) -> DataFrame:
    """``(user, ap, hits)`` of rows ``(user, rank, rel)``, ranks 1, 2, 3 ... in a list; 0 without a hit.

    The same as ``average_precision`` of the list as an array. A list is cut into chunks of ranks: hits are
    numbered inside a chunk and shifted by those of the chunks before, so that no task holds a long list.
    """
    rows = relevance.withColumn("_chunk", F.floor((F.col("rank") - 1) / chunk))
    totals = rows.groupBy(user, "_chunk").agg(F.sum("rel").alias("_hits"))
    before = Window.partitionBy(user).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(user, "_chunk", F.coalesce(F.sum("_hits").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(user, "_chunk").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumn("_seen", F.sum("rel").over(inside)).join(totals, [user, "_chunk"])
    precision = (F.col("_seen") + F.col("_before")) / F.col("rank")
    sums = numbered.groupBy(user).agg(
        F.sum("rel").alias("hits"), F.sum(F.when(F.col("rel") == 1, precision).otherwise(F.lit(0.0))).alias("_total")
    )
    return sums.select(user, F.when(F.col("hits") > 0, F.col("_total") / F.col("hits")).otherwise(F.lit(0.0)).alias("ap"), "hits")
