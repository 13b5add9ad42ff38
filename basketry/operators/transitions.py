"""What is bought next: counts of consecutive purchases and of purchases close together in a cart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators.skew import OrderedGroups, splittable

PAIR_BLOCK = 128  # products of an order that meet as many others in one group of order_neighbours
CHUNK = 4096  # cart positions per task group in cart_neighbours


def next_purchases(
    purchases: DataFrame,
    order: Sequence[str],
    buckets: Sequence[Column],
    user: str = "user_id",
    hot_rows: int | None = None,
    probe: DataFrame | None = None,
    probe_fraction: float | None = None,
) -> DataFrame:
    """``(product_id, next_product)`` for each purchase that a user followed with another."""
    groups = OrderedGroups(
        purchases.select(user, "product_id", *[c for c in order if c != "product_id"]),
        [user], order, buckets, hot_rows, probe, probe_fraction,
    )
    sequence = groups.neighbour("product_id", "next_product", 1).result()
    return sequence.filter(F.col("next_product").isNotNull()).select("product_id", "next_product")


def transition_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("product_id", "next_product").agg(F.count(F.lit(1)).alias("n"))


def top_transitions(counts: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent next products of each product, ties by product id."""
    best_first = Window.partitionBy("product_id").orderBy(F.desc("n"), "next_product")
    return counts.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)


def most_bought_next(counts: DataFrame) -> DataFrame:
    """One row: the product bought next most often, for products without a successor."""
    totals = counts.groupBy("next_product").agg(F.sum("n").alias("n"))
    return totals.orderBy(F.desc("n"), "next_product").limit(1).select(F.col("next_product").alias("fallback"))


def cart_neighbours(order_products: DataFrame, window: int = 10, chunk: int = CHUNK) -> DataFrame:
    """Counts ``(product_id, neighbour, n)`` of two products within ``window`` cart positions.

    ``add_to_cart_order`` is the position, 1, 2, 3 ... inside an order. The work is rows x window, also
    in an order of any length: an order is cut into chunks of cart positions, and the first ``window``
    positions of a chunk are given to the chunk before as well, to be seen but not to see. In an order
    of up to ``window + 1`` lines these are all its pairs. Each pair counts in both directions.
    """
    if window > chunk:
        raise ValueError("window must not be larger than a chunk")
    position = F.col("add_to_cart_order").cast("long") - 1
    home = F.floor(position / chunk)
    own = F.struct(home.alias("chunk"), F.lit(True).alias("own"))
    borrowed = F.struct((home - 1).alias("chunk"), F.lit(False).alias("own"))
    at_border = (home > 0) & (position % chunk < window)
    placed = order_products.select(
        "order_id",
        "product_id",
        position.alias("position"),
        F.explode(F.when(at_border, F.array(own, borrowed)).otherwise(F.array(own))).alias("place"),
    ).select("order_id", "product_id", "position", "place.*")
    following = Window.partitionBy("order_id", "chunk").orderBy("position").rangeBetween(1, window)
    pairs = (
        placed.withColumn("neighbour", F.collect_list("product_id").over(following))
        .filter("own")
        .select("product_id", F.explode("neighbour").alias("neighbour"))
        .filter(F.col("product_id") != F.col("neighbour"))
    )
    return _both_ways(pairs.select(
        F.least("product_id", "neighbour").alias("a"), F.greatest("product_id", "neighbour").alias("b")
    ))


def order_neighbours(order_products: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """Counts ``(product_id, neighbour, n)``: the distinct orders that hold both products.

    All pairs of an order count, once however often it holds a product. The products of an order are
    dealt to blocks, and pairs are made per order and pair of blocks, so that no task gathers a long
    order; equal pairs are added up before they are shuffled.
    """
    lines = order_products.select("order_id", "product_id").distinct()
    sizes = lines.groupBy("order_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    placed = splittable(lines, "order_id", "product_id").join(sizes, "order_id")
    own = F.pmod(F.xxhash64("product_id"), F.col("parts")).cast("int")
    placed = placed.select(
        "order_id", "product_id", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    )
    met = placed.groupBy("order_id", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"))
    met = met.agg(F.collect_list(F.struct("product_id", "own")).alias("items"))
    left = met.select("first", "second", "items", F.explode("items").alias("x"))
    right = F.filter("items", lambda y: (y["product_id"] > F.col("x.product_id")) & (
        (F.col("first") == F.col("second")) | (y["own"] != F.col("x.own"))))
    pairs = left.select(F.col("x.product_id").alias("a"), F.explode(right).alias("y"))
    return _both_ways(pairs.select("a", F.col("y.product_id").alias("b")))


def _both_ways(ordered: DataFrame) -> DataFrame:
    """Count each unordered pair ``(a, b)`` once, then mirror the counts instead of the pairs."""
    counts = ordered.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    both = F.explode(F.array(F.struct(F.col("a").alias("product_id"), F.col("b").alias("neighbour")),
                             F.struct(F.col("b").alias("product_id"), F.col("a").alias("neighbour"))))
    return counts.select(both.alias("p"), "n").select("p.product_id", "p.neighbour", "n")


def top_neighbours(counts: DataFrame, k: int = 5) -> DataFrame:
    best_first = Window.partitionBy("product_id").orderBy(F.desc("n"), "neighbour")
    return counts.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
