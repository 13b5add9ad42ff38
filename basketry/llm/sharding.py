"""Sharding by sampled splitters.

A size-weighted sample of the sort keys gives quantile boundaries; records are range-partitioned by
them, ranges that turn out overfull are subdivided with a sample of their own, and running totals
along the key order then cut the whole order into shards of nearly equal size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import materialize, ship_code

RANGES_PER_SHARD = 64
SAMPLES_PER_RANGE = 16
OVERFULL = 2.0  # times the mean size of a range
_DICE = 1 << 30


def group_key(group: Column, member: Column) -> Column:
    """A non-negative long: 39 bits of a hash of the group, then 24 bits of a hash of its member.

    Members of a group are neighbours in the key order, and a group of any size can still be cut.
    """
    high = F.shiftrightunsigned(F.xxhash64(group, F.lit("group")), 25).bitwiseAND((1 << 39) - 1)
    low = F.shiftrightunsigned(F.xxhash64(member, F.lit("member")), 40)
    return F.shiftleft(high, 24).bitwiseOR(low)


def _sample(rows: DataFrame, key: str, size: str, total: int, wanted: int) -> np.ndarray:
    """At most about ``wanted`` keys with weights, drawn in proportion to size by a hash.

    Rows of ``total / wanted`` bytes or more are all drawn; the expected sample is ``wanted`` rows, so
    what reaches the driver is bounded by the parameter, whatever the input.
    """
    step = max(1.0, total / wanted)
    dice = F.pmod(F.xxhash64(F.col(key), F.col(size), F.lit("dice")), F.lit(_DICE)) / _DICE
    drawn = rows.filter(dice < F.col(size) / step).select(
        F.col(key).alias("key"), F.greatest(F.col(size).cast("double"), F.lit(step)).alias("weight")
    )
    # equal rows roll equal dice: add them up before they travel
    drawn = drawn.groupBy("key").agg(F.sum("weight").alias("weight"))
    found = drawn.toArrow()
    pairs = np.empty(found.num_rows, dtype=[("key", "i8"), ("weight", "f8")])
    pairs["key"], pairs["weight"] = found["key"].to_numpy(), found["weight"].to_numpy()
    return np.sort(pairs, order="key")


def _quantiles(sample: np.ndarray, parts: int) -> np.ndarray:
    """Boundaries that cut the weight of the sample into ``parts``."""
    if not len(sample) or parts < 2:
        return np.empty(0, dtype="i8")
    running = np.cumsum(sample["weight"])
    at = np.searchsorted(running, running[-1] * np.arange(1, parts) / parts)
    return np.unique(sample["key"][np.minimum(at, len(sample) - 1)])


def _range_of(bounds: np.ndarray):
    @F.pandas_udf("int")
    def number(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in parts:
            yield pd.Series(np.searchsorted(bounds, keys.to_numpy(), side="left").astype("i4"))

    return number


def shard_by_bytes(rows: DataFrame, key: str, size: str, order: list[str], shards: int) -> DataFrame:
    """``rows`` with ``shard`` (0 .. shards-1) and ``slot`` (0, 1, ... within the shard).

    ``key`` is a long that is never null, ``size`` a non-negative long. Shards follow the order of
    ``key`` and then ``order``; a record belongs to the shard in which its middle byte falls, so a
    shard differs from the mean by less than its largest records. Rows equal in all these columns are
    interchangeable. An empty frame gives an empty frame.
    """
    ship_code()
    rows = materialize(rows.withColumn("_id", F.monotonically_increasing_id()), "unsharded")
    total, count = rows.agg(F.sum(size), F.count(F.lit(1))).first()
    total = int(total or 0)
    if not count:
        return rows.drop("_id").withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    ranges = RANGES_PER_SHARD * shards
    bounds = _quantiles(_sample(rows, key, size, total, ranges * SAMPLES_PER_RANGE), ranges)
    limit = OVERFULL * total / ranges
    for _ in range(3):
        tagged = rows.withColumn("_range", _range_of(bounds)(F.col(key)))
        sums = tagged.groupBy("_range").agg(
            F.sum(size).alias("bytes"), F.min(key).alias("low"), F.max(key).alias("high")
        )
        over = [r for r in sums.filter((F.col("bytes") > limit) & (F.col("low") < F.col("high"))).collect()]
        extra = [bounds]
        if over:  # at most ranges / OVERFULL of them
            inside = tagged.filter(F.col("_range").isin([r._range for r in over]))
            weight = sum(r.bytes for r in over)
            again = _sample(inside, key, size, weight, max(64, int(4 * SAMPLES_PER_RANGE * weight / limit)))
            for r in over:
                part = again[(again["key"] >= r.low) & (again["key"] <= r.high)]
                extra.append(_quantiles(part, int(np.ceil(2 * r.bytes / limit))))
        finer = np.unique(np.concatenate(extra))
        if len(finer) == len(bounds):
            break
        bounds = finer
    tagged = _with_parts(rows.withColumn("_range", _range_of(bounds)(F.col(key))), key, size, limit)
    # one row per range or part of one, and their number is set by the parameters
    before = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tagged.groupBy("_range", "_part").agg(F.sum(size).alias("_b"), F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select(
        "_range", "_part",
        F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows_before"),
    )
    inside = Window.partitionBy("_range", "_part").orderBy(key, *order)
    run = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = tagged.withColumn("_run", F.sum(size).over(run)).withColumn("_row", F.row_number().over(inside))
    placed = placed.join(F.broadcast(offsets), ["_range", "_part"])
    middle = 2 * (F.col("_bytes_before") + F.col("_run")) - F.col(size)
    placed = placed.withColumn(
        "shard", F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * max(total, 1)))).cast("int")
    ).withColumn("_at", F.col("_rows_before") + F.col("_row") - 1)
    placed = materialize(placed.drop("_run", "_row", "_bytes_before", "_rows_before", "_range", "_part", "_id"), "placed")
    starts = placed.groupBy("shard").agg(F.min("_at").alias("_start"))  # one row per shard
    return placed.join(F.broadcast(starts), "shard").withColumn("slot", F.col("_at") - F.col("_start")).drop("_at", "_start")


def _with_parts(tagged: DataFrame, key: str, size: str, limit: float) -> DataFrame:
    """Add ``_part``: 0, or for an overfull range of one single key, which no splitter can cut, a number
    dealt to its rows, so that none of its parts is overfull."""
    sums = tagged.groupBy("_range").agg(F.sum(size).alias("_b"), F.min(key).alias("_low"), F.max(key).alias("_high"))
    hot = sums.filter((F.col("_b") > limit) & (F.col("_low") == F.col("_high")))
    # each has more than ``limit`` bytes, so they are fewer than the ranges
    hot = materialize(hot.select("_range", F.ceil(F.col("_b") / limit).alias("_parts")), "hot-keys")
    dealt = F.pmod(F.xxhash64("_id"), F.col("_parts"))
    return tagged.join(F.broadcast(hot), "_range", "left").withColumn("_part", F.coalesce(dealt, F.lit(0)).cast("long")).drop("_parts")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Shards of nearly equal bytes for documents; equal texts are neighbours and stay together
    except where a shard's border falls among them.

    The size is the UTF-8 bytes of the text plus 8. A null text counts as empty; null ids, repeated
    rows, ties and other columns do no harm, and each input row gives one row.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        group_key(text, F.coalesce(docs["doc_id"].cast("long"), F.lit(-1))).alias("key"),
    )
    return shard_by_bytes(rows, "key", "size", ["doc_id", "text_crc32"], shards)


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write the documents as one folder per shard, each in slot order; ids must be unique."""
    rows = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    rows = rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(path)
