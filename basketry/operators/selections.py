"""Per-user ranked selections, product names, purchase history and held-out truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.arrays import first_items, remaining_items


def actual_selections(ratings: DataFrame, limit: int = 10, ties: str = "whole") -> DataFrame:
    """``(user_id, selections)``: the user's products from the best rating down.

    ``ties="whole"`` takes groups of equal ratings in whole and stops before the list passes
    ``limit``; a user whose first group is larger disappears. ``ties="strict"`` takes the first
    ``limit`` products, equal ratings in order of product id.

    Only the first ``limit + 1`` rows of a user can matter: a row whose tie group ends within
    ``limit`` is among them, and for any other row the shortened count is ``limit + 1`` too. Spark
    applies that bound before the shuffle, so the size of a user's ratings does not matter.
    """
    by_rating = Window.partitionBy("user_id").orderBy(F.desc("rating"), "product_id")
    head = ratings.select("user_id", "product_id", "rating").withColumn(
        "position", F.row_number().over(by_rating)
    )
    if ties == "whole":
        with_ties = Window.partitionBy("user_id").orderBy(F.desc("rating"))
        head = (
            head.filter(F.col("position") <= limit + 1)
            .withColumn("taken", F.count(F.lit(1)).over(with_ties))
            .filter(F.col("taken") <= limit)
        )
    elif ties == "strict":
        head = head.filter(F.col("position") <= limit)
    else:
        raise ValueError(f"ties must be 'whole' or 'strict', not {ties!r}")
    ordered = F.array_sort(F.collect_list(F.struct("position", "product_id")))
    return head.groupBy("user_id").agg(ordered.alias("s")).select(
        "user_id", F.col("s.product_id").alias("selections")
    )


def frequent_users(selections: DataFrame, min_size: int = 5) -> DataFrame:
    """Users with more than ``min_size`` selections."""
    return selections.filter(F.size("selections") > min_size)


def with_product_names(
    selections: DataFrame,
    products: DataFrame,
    ids: str = "selections",
    user: str = "user_id",
    name: str = "product_names",
) -> DataFrame:
    """Names of a list of product ids: same order, repeats kept, ``''`` for an unknown id.

    The planner broadcasts the products when they are small and joins by hash when they are not.
    """
    items = selections.select(user, F.posexplode_outer(ids).alias("pos", "product_id"))
    named = items.join(products.select("product_id", "product_name"), "product_id", "left")
    entry = F.when(
        F.col("pos").isNotNull(),
        F.struct("pos", "product_id", F.coalesce("product_name", F.lit("")).alias("product_name")),
    )
    return (
        named.groupBy(user)
        .agg(F.array_sort(F.collect_list(entry)).alias("s"))
        .select(user, F.col("s.product_id").alias(ids), F.col("s.product_name").alias(name))
    )


def history_and_truth(named: DataFrame, names: str = "product_names", n: int = 3) -> DataFrame:
    """Add ``previous_purchases`` (the first ``n`` names) and ``ground_truth`` (the others)."""
    return named.withColumn("previous_purchases", first_items(names, n)).withColumn(
        "ground_truth", remaining_items(names, n)
    )
