"""The order-table shapes of this library, derived from TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.keys import dense_id
from basketry.operators.skew import OrderedGroups, splittable

# the order of the lines inside an order; together with the order key it identifies a line, or
# leaves only lines that agree in every column used here
LINE_ORDER = ["line_number", "product_id", "supplier_id", "price", "ship_date"]


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def plain_orders(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("order_date"),
    )


def plain_lines(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_shipdate").alias("ship_date"),
    )


def _order_range():
    return F.struct("order_date", F.floor(F.col("order_id") / 4096).alias("range"))


def orders(spark: SparkSession, base: str) -> DataFrame:
    """Orders with their number and distance in days inside the user's history."""
    groups = OrderedGroups(
        plain_orders(spark, base),
        keys=["user_id"],
        order=["order_date", "order_id"],
        buckets=[_order_range(), F.to_date("order_date")],
    )
    placed = (
        groups.row_number("order_number")
        .neighbour("order_date", "prior_date", -1)
        .neighbour("order_id", "next_order", 1)
        .result()
    )
    last = F.when(F.col("user_id") % 3 == 0, "test").otherwise("train")
    return placed.select(
        "order_id",
        "user_id",
        F.when(F.col("next_order").isNull(), last).otherwise("prior").alias("eval_set"),
        F.col("order_number").cast("int").alias("order_number"),
        (F.dayofweek("order_date") - 1).alias("order_dow"),
        F.hour("order_date").alias("order_hour_of_day"),
        F.datediff("order_date", "prior_date").cast("float").alias("days_since_prior_order"),
    )


def cart_positions(spark: SparkSession, base: str) -> DataFrame:
    """``(order_id, product_id, add_to_cart_order)``, positions 1, 2, 3 ... inside an order."""
    groups = OrderedGroups(
        plain_lines(spark, base),
        keys=["order_id"],
        order=LINE_ORDER,
        buckets=[F.struct("line_number", F.floor(F.col("product_id") / 4096).alias("range"))],
    )
    placed = groups.row_number("add_to_cart_order").result()
    return placed.select("order_id", "product_id", F.col("add_to_cart_order").cast("int"))


def order_products(spark: SparkSession, base: str) -> DataFrame:
    """Order lines with cart position and whether an earlier order of the user holds the product."""
    when = F.struct("order_date", "order_id")
    lines = cart_positions(spark, base).join(plain_orders(spark, base), "order_id")
    bought = (
        plain_lines(spark, base).select("order_id", "product_id").join(plain_orders(spark, base), "order_id")
    )
    # a count by user and product may be long, so no window: the minimum combines before the shuffle
    first = bought.groupBy("user_id", "product_id").agg(F.min(when).alias("first_bought"))
    first = splittable(first, "user_id", "product_id", "first_bought")
    return lines.join(first, ["user_id", "product_id"]).select(
        "order_id",
        "product_id",
        "add_to_cart_order",
        (when > F.col("first_bought")).cast("int").alias("reordered"),
    )


def line_pairs(spark: SparkSession, base: str) -> DataFrame:
    """``(order_id, product_id)`` only, for what needs no cart position."""
    return plain_lines(spark, base).select("order_id", "product_id")


def purchases(spark: SparkSession, base: str, sample: float | None = None) -> DataFrame:
    """All lines with their user and date, enough to put a user's purchases in order.

    ``sample`` takes a share of the lines, to probe for hot users.
    """
    lines = plain_lines(spark, base)
    if sample is not None:
        lines = lines.sample(sample, 17)
    return lines.join(plain_orders(spark, base), "order_id")


PURCHASE_ORDER = ["order_date", "order_id", *LINE_ORDER]


def purchase_buckets(product: str = "product_id") -> list:
    """Chunks of a hot user's purchases: parts of an order, which may be long itself; then order
    ranges of a day; then days. ``product`` is the column of the numeric product id."""
    return [
        F.struct("order_date", "order_id", "line_number", F.floor(F.col(product) / 4096).alias("range")),
        _order_range(),
        F.to_date("order_date"),
    ]


def _dimension(values: DataFrame, source: str, id_col: str, name_col: str) -> DataFrame:
    distinct = values.select(F.col(source).alias(name_col)).filter(F.col(name_col).isNotNull()).distinct()
    numbered = dense_id(distinct, name_col, id_col)
    return numbered.select((F.col(id_col) + 1).cast("int").alias(id_col), name_col)


def departments(spark: SparkSession, base: str) -> DataFrame:
    return _dimension(table(spark, base, "part"), "p_type", "department_id", "department")


def aisles(spark: SparkSession, base: str) -> DataFrame:
    return _dimension(table(spark, base, "part"), "p_brand", "aisle_id", "aisle")


def plain_products(spark: SparkSession, base: str) -> DataFrame:
    """``(product_id, product_name)``; the key makes the name unique."""
    return table(spark, base, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")).alias("product_name"),
    )


def products(spark: SparkSession, base: str) -> DataFrame:
    part = table(spark, base, "part")
    return (
        part.join(aisles(spark, base), part.p_brand == F.col("aisle"), "left")
        .join(departments(spark, base), part.p_type == F.col("department"), "left")
        .select(
            F.col("p_partkey").alias("product_id"),
            F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")).alias("product_name"),
            "aisle_id",
            "department_id",
        )
    )


def catalogue_changes(spark: SparkSession, base: str, lines: DataFrame | None = None) -> DataFrame:
    """A change log ``(id, text, version, op)``: each shipped line renews its product's entry with
    the supplier as seller, each returned line takes the product off the list."""
    lines = table(spark, base, "lineitem") if lines is None else lines
    part = table(spark, base, "part").select("p_partkey", "p_name")
    returned = F.col("l_returnflag") == "R"
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("id"),
        F.when(~returned, F.concat("p_name", F.lit(" by seller "), F.col("l_suppkey").cast("string"))).alias(
            "text"
        ),
        F.datediff("l_shipdate", F.lit("1970-01-01").cast("date")).cast("long").alias("version"),
        F.when(returned, "delete").otherwise("upsert").alias("op"),
    )
