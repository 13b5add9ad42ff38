"""Scans: files with a declared schema, tables by name, literal rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from basketry.session import materialize
from basketry.sources import schemas


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType) -> DataFrame:
    """CSV with a header line under a declared schema.

    ``enforceSchema=False`` compares the header with the schema, so a file with an additional or
    renamed column fails instead of having its columns shifted.
    """
    paths = [path] if isinstance(path, str) else list(path)
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(paths)
    )


def read_csv_routed(spark: SparkSession, path: str | Sequence[str], schema: StructType) -> tuple[DataFrame, DataFrame]:
    """The rows of CSV files that fit the schema, and ``(file, text)`` of those that do not.

    A row is bad if a value does not parse or its number of values is wrong; nothing is dropped or turned
    to null. The header is still compared with the schema. Both results come from one read.
    """
    bad = "_malformed"
    rows = (
        spark.read.schema(StructType([*schema.fields, StructField(bad, StringType())]))
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", bad)
        .csv([path] if isinstance(path, str) else list(path))
    )
    rows = materialize(rows.withColumn("_file", F.input_file_name()), "parsed")
    good = rows.filter(F.col(bad).isNull()).select(*schema.fieldNames())
    return good, rows.filter(F.col(bad).isNotNull()).select(F.col("_file").alias("file"), F.col(bad).alias("text"))


def read_orders(spark: SparkSession, path) -> DataFrame:
    return read_csv(spark, path, schemas.ORDERS)


def read_products(spark: SparkSession, path) -> DataFrame:
    return read_csv(spark, path, schemas.PRODUCTS)


def read_order_products(spark: SparkSession, path) -> DataFrame:
    """One or several files of order lines (prior and train), read as one bag."""
    return read_csv(spark, path, schemas.ORDER_PRODUCTS)


def read_departments(spark: SparkSession, path) -> DataFrame:
    return read_csv(spark, path, schemas.DEPARTMENTS)


def read_aisles(spark: SparkSession, path) -> DataFrame:
    return read_csv(spark, path, schemas.AISLES)


def read_text_dataset(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """A text catalogue in parquet, JSON lines or CSV."""
    if fmt == "csv":
        return read_csv(spark, path, schema or schemas.PRODUCT_DESCRIPTIONS)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.format(fmt).load(path)


def as_catalogue(products: DataFrame, id_col: str = "product_id", text_col: str = "product_name") -> DataFrame:
    """Project a product table to ``(id, product)``."""
    return products.selectExpr(f"`{id_col}` as id", f"`{text_col}` as product")


def union_order_products(prior: DataFrame, train: DataFrame) -> DataFrame:
    """Bag union by column name; duplicates stay."""
    return prior.unionByName(train)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables and views, as a DataFrame."""
    return spark.sql(f"SHOW TABLES IN {database}" if database else "SHOW TABLES")


def literal_histories(spark: SparkSession, histories: Mapping[str, Sequence[str]]) -> DataFrame:
    """A small dict of purchase histories as ``(user, history)`` rows."""
    return spark.createDataFrame(
        [(user, list(items)) for user, items in histories.items()], schemas.HISTORIES
    )


def product_by_id(products: DataFrame, product_id: int) -> DataFrame:
    return products.filter(F.col("product_id") == product_id)


def preview(df: DataFrame, n: int = 3) -> DataFrame:
    return df.limit(n)
