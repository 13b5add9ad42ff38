"""Declared schemas of the order tables. Nothing in this library infers a schema."""

from pyspark.sql.types import (
    ArrayType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

ORDERS = StructType(
    [
        StructField("order_id", IntegerType()),
        StructField("user_id", IntegerType()),
        StructField("eval_set", StringType()),
        StructField("order_number", IntegerType()),
        StructField("order_dow", IntegerType()),
        StructField("order_hour_of_day", IntegerType()),
        StructField("days_since_prior_order", FloatType()),
    ]
)

PRODUCTS = StructType(
    [
        StructField("product_id", IntegerType()),
        StructField("product_name", StringType()),
        StructField("aisle_id", IntegerType()),
        StructField("department_id", IntegerType()),
    ]
)

ORDER_PRODUCTS = StructType(
    [
        StructField("order_id", IntegerType()),
        StructField("product_id", IntegerType()),
        StructField("add_to_cart_order", IntegerType()),
        StructField("reordered", IntegerType()),
    ]
)

DEPARTMENTS = StructType(
    [StructField("department_id", IntegerType()), StructField("department", StringType())]
)

AISLES = StructType([StructField("aisle_id", IntegerType()), StructField("aisle", StringType())])

PRODUCT_DESCRIPTIONS = StructType([StructField("id", LongType()), StructField("text", StringType())])

HISTORIES = StructType(
    [StructField("user", StringType()), StructField("history", ArrayType(StringType()))]
)

CATALOGUE_CHANGES = StructType(
    [
        StructField("id", LongType()),
        StructField("text", StringType()),
        StructField("version", LongType()),
        StructField("op", StringType()),
    ]
)
