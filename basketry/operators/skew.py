"""Ordered windows that stay parallel when one key holds a large share of the rows.

A window by user puts all rows of a user into one task. ``OrderedGroups`` finds the few keys that are
too large for that, cuts their rows into chunks along the window order, runs the window inside each
chunk and then carries the value over the chunk border with a small table of one row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A group up to this size is sorted by one task without trouble.
HOT_ROWS = 10_000_000
# Share of the rows looked at to find larger groups; such a group has 100,000 rows even in the sample.
PROBE_FRACTION = 0.01


def hot_rows_setting(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.basketry.hotRows", str(HOT_ROWS)))


def probe_fraction_setting(spark: SparkSession) -> float:
    return float(spark.conf.get("spark.basketry.probeFraction", str(PROBE_FRACTION)))


def hot_keys(probe: DataFrame, keys: Sequence[str], hot_rows: int, fraction: float = 1.0) -> list:
    """Keys with more than ``hot_rows`` rows, as a list of tuples.

    ``probe`` may be a sample taken with ``fraction``: it only selects the physical strategy, rows are
    never dropped. The list holds fewer than ``rows / hot_rows`` keys, as each has more than
    ``hot_rows`` rows of its own, so at 10**12 rows it stays below 100,000.
    """
    counts = probe.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = counts.filter(F.col("n") > hot_rows * fraction).select(*keys)
    return [tuple(row) for row in hot.toLocalIterator()]


def splittable(grouped: DataFrame, *columns: str) -> DataFrame:
    """Prepare the result of a grouping (or window) for a join on its key with skewed rows.

    Spark splits a skewed partition of a join at run time only where both sides come straight from a
    shuffle. A grouped side is already partitioned by the key and would be joined as it is, which
    leaves a hot key to one task. Spread over ``columns``, the key and any other, it is shuffled for the
    join like the other side; being grouped, it is the small one.
    """
    return grouped.repartition(*columns)


class OrderedGroups:
    """Row numbers and neighbours of rows inside ``keys``, ordered by ``order``.

    ``order`` must be a total order inside a key and keys must not be null. ``buckets`` are used for
    hot keys only, finest first: each must not decrease along ``order`` and each must be a function of
    the finer one before it. ``probe`` is a sample of the rows taken with ``probe_fraction``, for input
    that is cheaper to sample before it is joined together. ``hot`` are the keys found by another object on the
    same rows. ``spark.basketry.hotRows`` and
    ``spark.basketry.probeFraction`` set what is not given.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        buckets: Sequence[Column],
        hot_rows: int | None = None,
        probe: DataFrame | None = None,
        probe_fraction: float | None = None,
        hot: list | None = None,
    ):
        spark = df.sparkSession
        hot_rows = hot_rows_setting(spark) if hot_rows is None else hot_rows
        probe_fraction = probe_fraction_setting(spark) if probe_fraction is None else probe_fraction
        self.keys, self.order = list(keys), list(order)
        self.levels: list[str] = []
        self.df = df
        if hot is None:
            if probe is None:
                probe = df.select(*keys) if probe_fraction >= 1 else df.select(*keys).sample(probe_fraction, 17)
            hot = hot_keys(probe, keys, hot_rows, probe_fraction)
        self.hot = hot
        if hot:
            schema = df.select(*keys).schema
            marks = spark.createDataFrame(hot, schema).withColumn("_hot", F.lit(True))
            self.df = df.join(F.broadcast(marks), self.keys, "left")
            for i, bucket in enumerate(buckets):
                self.df = self.df.withColumn(f"_chunk{i}", F.when(F.col("_hot"), bucket))
                self.levels.append(f"_chunk{i}")
            self.df = self.df.drop("_hot")
        # chunk tables start from here, whatever columns the methods add
        self.base = self.df

    def _chunks(self):
        rows = self.base.filter(F.col(self.levels[0]).isNotNull())
        return rows.groupBy(*self.keys, *self.levels)

    def _window(self):
        return Window.partitionBy(*self.keys, *self.levels[:1]).orderBy(*self.order)

    def row_number(self, name: str) -> OrderedGroups:
        self.df = self.df.withColumn(name, F.row_number().over(self._window()).cast("long"))
        if self.levels:
            chunks = self._chunks().agg(F.count(F.lit(1)).alias("_total"))
            before = _totals_before(chunks, self.keys, self.levels)
            on = [*self.keys, self.levels[0]]
            self.df = (
                self.df.join(before.select(*on, "_before"), on, "left")
                .withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
                .drop("_before")
            )
        return self

    def neighbour(self, value: str, name: str, step: int = 1) -> OrderedGroups:
        """The value of the next (``step=1``) or previous (``step=-1``) row of the key."""
        shift = F.lead if step > 0 else F.lag
        edge = F.min_by if step > 0 else F.max_by
        self.df = self.df.withColumn(name, shift(value).over(self._window()))
        if self.levels:
            # wrapped in a struct so that a null value still counts as a neighbour
            inside = shift(F.struct(value)).over(self._window())
            first = edge(F.struct(F.col(value).alias("v")), F.struct(*self.order))
            chunks = self._chunks().agg(first.alias("_edge"))
            across = _edge_beyond(chunks, self.keys, self.levels, step)
            on = [*self.keys, self.levels[0]]
            self.df = (
                self.df.withColumn("_inside", inside)
                .join(across.select(*on, "_beyond"), on, "left")
                .withColumn(name, F.when(F.col("_inside").isNotNull(), F.col(name)).otherwise(F.col("_beyond.v")))
                .drop("_inside", "_beyond")
            )
        return self

    def result(self) -> DataFrame:
        return self.df.drop(*self.levels)


def _totals_before(chunks: DataFrame, keys: list[str], levels: list[str]) -> DataFrame:
    """Add ``_before``: the sum of ``_total`` over the earlier chunks of the key."""
    here, coarser = levels[0], levels[1:]
    window = (
        Window.partitionBy(*keys, *coarser[:1]).orderBy(here).rowsBetween(Window.unboundedPreceding, -1)
    )
    out = chunks.withColumn("_before", F.coalesce(F.sum("_total").over(window), F.lit(0)))
    if not coarser:
        return out
    parents = chunks.groupBy(*keys, *coarser).agg(F.sum("_total").alias("_total"))
    parents = _totals_before(parents, keys, coarser).select(*keys, coarser[0], F.col("_before").alias("_outer"))
    return out.join(parents, [*keys, coarser[0]]).withColumn("_before", F.col("_before") + F.col("_outer"))


def _edge_beyond(chunks: DataFrame, keys: list[str], levels: list[str], step: int) -> DataFrame:
    """Add ``_beyond``: the edge value of the neighbouring chunk of the key."""
    here, coarser = levels[0], levels[1:]
    shift, edge = (F.lead, F.min_by) if step > 0 else (F.lag, F.max_by)
    window = Window.partitionBy(*keys, *coarser[:1]).orderBy(here)
    out = chunks.withColumn("_beyond", shift("_edge").over(window))
    if not coarser:
        return out
    parents = chunks.groupBy(*keys, *coarser).agg(edge("_edge", here).alias("_edge"))
    parents = _edge_beyond(parents, keys, coarser, step).select(
        *keys, coarser[0], F.col("_beyond").alias("_outer")
    )
    return out.join(parents, [*keys, coarser[0]]).withColumn("_beyond", F.coalesce("_beyond", "_outer"))
