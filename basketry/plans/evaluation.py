"""Evaluation set and scores, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.arrays import first_items, remaining_items
from basketry.functions.metrics import binary_relevance, map_at_k
from basketry.operators.ratings import ratings
from basketry.operators.selections import (
    actual_selections,
    frequent_users,
    history_and_truth,
    with_product_names,
)
from basketry.operators.split import hash_split


def held_out_selections(
    orders: DataFrame,
    order_products: DataFrame,
    products: DataFrame | None = None,
    limit: int = 10,
    min_size: int = 5,
    ties: str = "whole",
) -> DataFrame:
    """Ratings -> held-out part -> ranked selections of users with enough of them."""
    _, held_out = hash_split(ratings(orders, order_products, products))
    return frequent_users(actual_selections(held_out, limit, ties), min_size)


def evaluation_table(orders: DataFrame, order_products: DataFrame, products: DataFrame, **options) -> DataFrame:
    """``(user_id, selections, product_names, previous_purchases, ground_truth)``."""
    chosen = held_out_selections(orders, order_products, products, **options)
    return history_and_truth(with_product_names(chosen, products))


def id_histories(selections: DataFrame, n: int = 3) -> DataFrame:
    """``(user_id, history, ground_truth)`` with product ids, which unlike names are unique."""
    return selections.select(
        "user_id",
        first_items("selections", n).alias("history"),
        remaining_items("selections", n).alias("ground_truth"),
    )


def evaluation_frame(
    truth: DataFrame, recommended: DataFrame, user: str = "user_id", distinct: bool = False
) -> DataFrame:
    """Truth and recommendations side by side, with the relevance of each recommendation.

    Every user of the truth stays; one without recommendations has an empty list, which scores 0.
    """
    kind = recommended.schema["recommendations"].dataType
    listed = F.coalesce("recommendations", F.array().cast(kind))
    return truth.join(recommended, user, "left").withColumn("recommendations", listed).withColumn(
        "relevance", binary_relevance("recommendations", "ground_truth", distinct)
    )


def score(truth: DataFrame, recommended: DataFrame, k: int = 5, user: str = "user_id") -> DataFrame:
    """One row ``(k, users, map_at_k)``."""
    return map_at_k(evaluation_frame(truth.select(user, "ground_truth"), recommended, user), k)

