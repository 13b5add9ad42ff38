"""Row identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import materialize

_POSITION_BITS = 33  # monotonically_increasing_id keeps the partition number above these bits


def dense_id(df: DataFrame, order: str | list[str], name: str = "id", partitions: int | None = None) -> DataFrame:
    """Number the rows 0, 1, 2 ... along ``order`` without sorting them in one task.

    Rows are range-partitioned, numbered inside their partition and shifted by the number of rows in
    the partitions before. The tagged rows are written first: range bounds come from a sample, and the
    counts must see the same partitions as the rows. ``order`` must be a unique key.
    """
    cols = [order] if isinstance(order, str) else list(order)
    ranged = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    tagged = ranged.sortWithinPartitions(*cols).withColumn("_tag", F.monotonically_increasing_id())
    tagged = materialize(tagged, "numbered").withColumn("_part", F.shiftright("_tag", _POSITION_BITS))
    # one row per partition: the frame is as long as the number of partitions
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    position = F.col("_tag").bitwiseAND((1 << _POSITION_BITS) - 1)
    return (
        tagged.join(F.broadcast(offsets), "_part")
        .withColumn(name, position + F.col("_offset"))
        .drop("_part", "_tag", "_offset")
    )


def hash_id(df: DataFrame, *cols: str, name: str = "row_id") -> DataFrame:
    """A row id that is the same on every read, from the columns that identify the row: 63 bits of md5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 16), 16, -10).cast("long")
    return df.withColumn(name, F.shiftrightunsigned(bits, 1))
