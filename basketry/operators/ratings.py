"""Implicit ratings: the share of a user's orders that hold a product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.keys import hash_id
from basketry.operators.skew import splittable


def purchase_events(orders: DataFrame, unique_orders: bool = False) -> DataFrame:
    """Distinct orders per user, including orders without lines.

    ``unique_orders`` promises that ``order_id`` does not repeat, which saves a shuffle of the orders.
    """
    count = F.count("order_id") if unique_orders else F.countDistinct("order_id")
    return orders.groupBy("user_id").agg(count.alias("purchase_events"))


def product_purchases(
    orders: DataFrame, order_products: DataFrame, products: DataFrame | None = None
) -> DataFrame:
    """How often each user bought each product."""
    counts = (
        order_products.select("order_id", "product_id")
        .join(orders.select("order_id", "user_id"), "order_id")
        .groupBy("user_id", "product_id")
        .agg(F.count(F.lit(1)).alias("product_purchases"))
    )
    return _known_products(counts, products)


def ratings(
    orders: DataFrame,
    order_products: DataFrame,
    products: DataFrame | None = None,
    unique_orders: bool = False,
) -> DataFrame:
    """``(user_id, product_id, rating)``.

    The number of purchase events is joined to the orders, which are few, before the order lines come
    in; it then travels through the count by user and product. No join by user has to move the
    ratings, and both sides of each join come from a shuffle and go to one on another key, so that
    Spark can split a hot user or a hot order by itself.
    """
    events = splittable(purchase_events(orders, unique_orders), "user_id", "purchase_events")
    with_events = orders.select("order_id", "user_id").join(events, "user_id")
    counts = (
        order_products.select("order_id", "product_id")
        .join(with_events, "order_id")
        .groupBy("user_id", "product_id")
        .agg(
            F.count(F.lit(1)).alias("product_purchases"),
            F.max("purchase_events").alias("purchase_events"),
        )
    )
    return _known_products(counts, products).select(
        "user_id", "product_id", (F.col("product_purchases") / F.col("purchase_events")).alias("rating")
    )


def colocated_ratings(orders: DataFrame, order_products: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """``(user_id, product_id, rating)`` from tables that are bucketed alike by ``order_id``.

    Lines and orders are joined as they lie, without an exchange; counts by user and product are the
    first rows to move. For orders that are few beside their lines, else ``ratings`` carries less.
    """
    lines = order_products.select("order_id", "product_id").hint("merge")
    counts = (
        lines.join(orders.select("order_id", "user_id"), "order_id")
        .groupBy("user_id", "product_id")
        .agg(F.count(F.lit(1)).alias("product_purchases"))
    )
    events = splittable(purchase_events(orders), "user_id", "purchase_events")
    rated = _known_products(counts, products).join(events, "user_id")
    return rated.select("user_id", "product_id", (F.col("product_purchases") / F.col("purchase_events")).alias("rating"))


def user_product_purchases(
    orders: DataFrame, order_products: DataFrame, products: DataFrame | None = None
) -> DataFrame:
    """Ratings with a row id that does not change between reads."""
    rated = hash_id(ratings(orders, order_products, products), "user_id", "product_id")
    return rated.select("row_id", "user_id", "product_id", "rating")


def _known_products(counts: DataFrame, products: DataFrame | None) -> DataFrame:
    # only filters, so a semi join; after the count, where rows are fewest
    if products is None:
        return counts
    return counts.join(products.select("product_id"), "product_id", "left_semi")
