"""Tables, views and file output."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

BUCKET_ROWS = 1_000_000  # rows of a bucket that one task joins


def bucket_count(rows: int, least: int = 8) -> int:
    """How many buckets a table of so many rows needs, so that one holds no more when the table grows."""
    return max(least, -(-rows // BUCKET_ROWS))


def overwrite_table(
    df: DataFrame,
    name: str,
    fmt: str = "parquet",
    path: str | None = None,
    buckets: tuple[int, str] | None = None,
) -> None:
    """Replace a table together with its schema.

    ``buckets`` is a number and a column. Orders and order lines bucketed alike by ``order_id`` join
    without a shuffle each time ratings are computed.
    """
    writer = df.write.format(fmt).mode("overwrite").option("overwriteSchema", "true")
    _save(writer, name, path, buckets)


def create_table(
    df: DataFrame,
    name: str,
    fmt: str = "parquet",
    path: str | None = None,
    buckets: tuple[int, str] | None = None,
) -> None:
    """Write a new table; fail when it exists."""
    _save(df.write.format(fmt).mode("errorifexists"), name, path, buckets)


def _save(writer: DataFrameWriter, name: str, path: str | None, buckets: tuple[int, str] | None) -> None:
    if path:
        writer = writer.option("path", path)
    if buckets:
        number, column = buckets
        writer = writer.bucketBy(number, column).sortBy(column)
    writer.saveAsTable(name)


def replace_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def use_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")
    spark.sql(f"USE {name}")


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and no index column."""
    df.write.option("header", True).csv(path)


def append_changes(df: DataFrame, path: str) -> None:
    """Add rows to an append-only change table ``(id, text, version, op)``."""
    df.select("id", "text", "version", "op").write.mode("append").parquet(path)
