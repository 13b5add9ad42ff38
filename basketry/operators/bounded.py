"""Exact search that skips cells by the triangle inequality.

Index rows lie around centres, in rings: a cell is a centre and a ring, and knows the least and the
widest angle between its rows and the centre. A query first looks into its nearest cells until it has met
``k`` rows: their ``k``-th best score is a floor. Then it visits only the cells that can hold a row above
the floor: the angle to a row is at least the difference of the angles that both make with the centre.
The result is that of comparing all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from basketry.operators.ann import CellIndex
from basketry.operators.probing import ORDERED, with_columns
from basketry.operators.search import SCORE_DIGITS, TILE, DenseScore, top_k_join
from basketry.session import materialize

# what rounding of scores and of angles may hide
MARGIN = 2 * 10.0**-SCORE_DIGITS


RINGS = 32  # of equal width, over half a turn

FIRST = StructType(
    [StructField("cell", IntegerType()), StructField("rows", LongType()), StructField("away", DoubleType()), StructField("_far", DoubleType())]
)


@dataclass(frozen=True)
class BoundedReach:
    """What queries know of the cells: of each, by number, its centre, rows, and least and widest angle."""

    centres: np.ndarray
    cells: np.ndarray
    centre: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    column = "cell"
    columns = ("_floor",)

    def borders(self, cells: np.ndarray) -> list[int]:
        """Rows of one cell at a time."""
        starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        ends = np.append(starts[1:], len(cells))
        return [*(d for a, b in zip(starts, ends) for d in range(a, b, TILE[1])), len(cells)]

    def asking(self, queries: pa.Table) -> _Asking:
        floor = queries.column("_floor").to_numpy()  # NaN without one
        return _Asking(self, _angles(DenseScore._matrix(queries), self.centres), np.where(np.isnan(floor), -np.inf, floor))

    def away(self, angles: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The least angle between a query and a row of each of the ``cells``, given by their place here."""
        return np.maximum(0.0, np.maximum(angles - self.high[cells], self.low[cells] - angles))

    def first(self, angles: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """The nearest cells of each query, until they hold ``k`` rows: query, cell's place here, angles by which they
        are ordered."""
        every, widest = np.arange(len(self.cells)), np.finfo(float).max
        away, far = (np.nan_to_num(x, nan=widest) for x in (self.away(angles[:, self.centre], every), angles[:, self.centre] + self.low))
        left, met, found = np.arange(len(angles) if len(every) else 0), np.zeros(len(angles), np.int64), []
        for _ in every:
            if not len(left):
                break
            near = away[left]
            # ties by the second angle, then by cell
            at = np.where(near == near.min(axis=1)[:, None], far[left], np.inf).argmin(axis=1)
            found.append((left, at, away[left, at], far[left, at]))
            met[left] += self.rows[at]
            away[left, at], far[left, at] = np.inf, np.inf
            left = left[met[left] < k]
        return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, int) for i in range(4))


@dataclass
class _Asking:
    reach: BoundedReach
    angles: np.ndarray
    floor: np.ndarray

    def near_any(self, cells: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.meets(np.arange(len(self.floor))[:, None], cells[None, :]).any(axis=1))

    def meets(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether a cell can hold a row above the floor; ``rows`` of the queries and ``cells`` are broadcast
        against each other."""
        at = np.searchsorted(self.reach.cells, cells)
        # a query or row without a direction scores zero
        top = np.maximum(np.cos(self.reach.away(self.angles[rows, self.reach.centre[at]], at)), 0.0)
        return ~(top < self.floor[rows] - MARGIN)


@dataclass
class BoundedIndex:
    """Rows by cell; ``bounds`` is (cell, centre, rows, low, high), angles in radians. Centres and bounds, at most
    ``RINGS`` for a centre, are all the driver holds."""

    rows: DataFrame
    centres: np.ndarray
    bounds: DataFrame

    @classmethod
    def build(cls, index: DataFrame, centres: int, **options) -> BoundedIndex:
        """Centres by k-means on all rows ``(id, ..., embedding, norm)``."""
        built = CellIndex.build(index, cells=centres, keep=False, **options)
        angled = _with_angles(built.rows, built.centres)
        angled = angled.withColumn("angle", F.element_at("angles", F.col("cell").cast("int") + 1))
        ring = F.least(F.lit(RINGS - 1), F.floor(F.col("angle") * RINGS / F.pi()))
        placed = angled.withColumn("cell", (F.col("cell") * RINGS + ring).cast("int")).drop("angles")
        # many cells, some of them small: rows in the order of their cells, so that files know which they hold
        rows = materialize(placed.repartitionByRange("cell", "id").sortWithinPartitions("cell"), "cells")
        bounds = rows.groupBy("cell").agg(
            F.count(F.lit(1)).alias("rows"), F.min("angle").alias("low"), F.max("angle").alias("high")
        )
        bounds = bounds.withColumn("centre", F.floor(F.col("cell") / RINGS).cast("int"))
        return cls(rows.drop("angle"), built.centres, materialize(bounds, "bounds"))

    def _reach(self) -> BoundedReach:
        bounds = self.bounds.select("cell", "centre", "rows", "low", "high").orderBy("cell").toArrow()
        return BoundedReach(self.centres, *(bounds.column(n).to_numpy() for n in ("cell", "centre", "rows", "low", "high")))

    def _first(self, queries: DataFrame, k: int, reach: BoundedReach) -> DataFrame:
        """``(query_id, cell)``: the nearest cells of each query, looked into for its floor."""

        def nearest(m: np.ndarray) -> list[pa.Array]:
            step, parts = max(1, ORDERED // max(1, len(reach.cells))), []
            for start in range(0, len(m), step):
                query, at, away, far = reach.first(_angles(m[start : start + step], reach.centres), k)
                order = np.argsort(query, kind="stable")
                parts.append((query[order] + start, at[order], away[order], far[order]))
            query, at, away, far = (np.concatenate([p[i] for p in parts]) for i in range(4))
            columns = [pa.array(reach.cells[at], pa.int32()), pa.array(reach.rows[at], pa.int64()), pa.array(away, pa.float64()), pa.array(far, pa.float64())]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(query, minlength=len(m)))]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, names=FIRST.names))]

        near = with_columns(queries.select("query_id", "embedding", "norm"), [StructField("_first", ArrayType(FIRST))], nearest)
        near = near.select("query_id", F.explode("_first").alias("_c")).select("query_id", "_c.*")
        closer = Window.partitionBy("query_id").orderBy("away", "_far", "cell").rowsBetween(Window.unboundedPreceding, -1)
        first = near.withColumn("_met", F.coalesce(F.sum("rows").over(closer), F.lit(0))).filter(F.col("_met") < k)
        return materialize(first.select("query_id", "cell"), "first-cells")

    def _floors(self, queries: DataFrame, k: int, reach: BoundedReach) -> tuple[DataFrame, DataFrame]:
        """``(query_id, cell)`` looked into for floors, and the queries with ``_floor``, null where fewer than ``k``
        rows were met."""
        first = self._first(queries, k, reach)
        found = top_k_join(queries, self.rows, k, DenseScore(), group="cell", visits=first)
        floor = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("_floor"))
        # the planner would broadcast a small file of many rows
        asked = queries.select("query_id", "embedding", "norm").join(floor.hint("merge"), "query_id", "left")
        return first, materialize(asked, "queries-with-floors")

    def _visits(self, asked: DataFrame, reach: BoundedReach) -> DataFrame:
        """``(query_id, cell)`` of all cells that can hold one of the best; a list that only few queries are worth."""
        schema = StructType([asked.schema["query_id"], StructField("cell", IntegerType())])

        def run(batches):
            for asking, rows in _met(batches, reach):
                query, at = np.nonzero(asking.meets(np.arange(len(asking.floor))[:, None], reach.cells[None, :]))
                columns = [rows.column("query_id").combine_chunks().take(pa.array(query)), pa.array(reach.cells[at], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "cell"])

        return asked.mapInArrow(run, schema)

    def search(self, queries: DataFrame, k: int, columns: tuple[str, ...] = (), **options) -> DataFrame:
        """Exact top-k by cosine; ``queries`` is ``(query_id, embedding, norm)``."""
        reach = self._reach()
        _, asked = self._floors(queries, k, reach)
        visits = self._visits(asked, reach)
        return top_k_join(
            asked, self.rows, k, DenseScore(), payload=columns, group="cell", visits=visits, reach=reach, **options
        )

    def pairs_scored(self, queries: DataFrame, k: int) -> DataFrame:
        """One row: pairs scored, those for the floors included, and all pairs. Tasks count, cells by cells; no row
        per query and cell is made."""
        reach = self._reach()
        first, asked = self._floors(queries, k, reach)

        def run(batches):
            for asking, rows in _met(batches, reach):
                met = asking.meets(np.arange(rows.num_rows)[:, None], reach.cells[None, :])
                yield pa.RecordBatch.from_arrays([pa.array([int(met.sum(axis=0) @ reach.rows)], pa.int64())], names=["rows"])

        scored = first.join(self.bounds.select("cell", "rows"), "cell").select("rows")
        scored = scored.unionByName(asked.mapInArrow(run, "rows long")).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("scored"))
        every = queries.filter("embedding is not null").count() * self.rows.count()
        return scored.select("scored", F.lit(every).cast("long").alias("pairs"))


def _met(batches, reach: BoundedReach):
    """Batches of queries in parts, so that what is held of them against all cells stays small."""
    step = max(1, ORDERED // max(1, len(reach.cells)))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            rows = pa.Table.from_batches([batch.slice(start, step)])
            yield reach.asking(rows), rows


def _angles(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angles to all centres; a vector or centre without a direction is at a right angle to all."""
    length = np.linalg.norm(centres, axis=1)
    return np.arccos(np.clip(rows @ (centres / np.where(length == 0, 1.0, length)[:, None]).T, -1.0, 1.0))


def _with_angles(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """Add ``angles`` to all centres."""

    def angles(rows: np.ndarray) -> list[pa.Array]:
        found = _angles(rows, centres)
        offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
        return [pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))]

    return with_columns(df, [StructField("angles", ArrayType(DoubleType()))], angles)
