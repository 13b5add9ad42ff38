"""Approximate search by random projections with multi-probe order and a measured number of probes.

Vectors are projected on Gaussian planes (2-stable: differences of projections are distributed like
distances). Each projection falls below, into or above a middle bucket whose width is fitted to all rows;
the pattern over all planes is the cell of a row. The number of planes grows with the logarithm of the
table, so that a cell keeps the same few rows. A query visits cells in the order of their distance in the
projected space, as many as true neighbours of sample queries need at the recall asked for.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from basketry.operators.search import QUERY_BLOCK, TILE, DenseScore, top_k_join
from basketry.session import materialize

LEVELS = 3
ROWS_PER_CELL = 8
WIDTH = 0.8615  # of the root mean square: the middle third of a normal distribution
SAMPLE = 200  # queries by which the number of probes is measured
RECALL = 0.93  # on the sample, for at least 0.9 on all
ORDERED = 1 << 18  # distances of queries to cells held at a time inside a task, so many as a processor keeps near


def gaussian_planes(count: int, dimensions: int) -> np.ndarray:
    """Normal numbers from md5 (Box-Muller), so that any engine with md5 can make the same."""

    def uniform(name: str) -> float:
        return (int(hashlib.md5(name.encode()).hexdigest()[:8], 16) + 0.5) / 2**32

    def normal(i: int, j: int) -> float:
        return math.sqrt(-2 * math.log(uniform(f"r:{i}:{j}"))) * math.cos(2 * math.pi * uniform(f"t:{i}:{j}"))

    return np.array([[normal(i, j) for j in range(dimensions)] for i in range(count)]).reshape(count, dimensions)


def planes_for(rows: int) -> int:
    return max(1, round(math.log(max(rows, 1) / ROWS_PER_CELL, LEVELS))) if rows > ROWS_PER_CELL else 1


def cells_of(projections: np.ndarray, width: float) -> np.ndarray:
    """The cell of each row: a digit for each plane, 0 below, 1 in and 2 above the middle."""
    digits = 1 + (projections > width / 2).astype(np.int64) - (projections < -width / 2)
    return digits @ LEVELS ** np.arange(projections.shape[1], dtype=np.int64)


def probe_order(projections: np.ndarray, width: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` nearest cells of each query, nearest first, and their squared distances; ties by cell.

    Planes are taken in one by one. A cell among the nearest over all planes is, over the first few,
    among the nearest too, so ``count`` beginnings are enough at each step.
    """
    reach = np.stack(
        [np.maximum(0, projections + width / 2), np.maximum(0, np.abs(projections) - width / 2), np.maximum(0, width / 2 - projections)], axis=2
    )
    near = np.zeros((len(projections), 1))
    cells = np.zeros((len(projections), 1), dtype=np.int64)
    for plane in range(projections.shape[1]):
        near = (near[:, :, None] + reach[:, plane, None, :] ** 2).reshape(len(near), -1)
        cells = (cells[:, :, None] + np.arange(LEVELS) * LEVELS**plane).reshape(len(cells), -1)
        order = np.lexsort((cells, near), axis=1)[:, :count]
        near, cells = np.take_along_axis(near, order, 1), np.take_along_axis(cells, order, 1)
    return cells, near


def gaps_of(projections: np.ndarray, width: float) -> np.ndarray:
    """(plane, level, query): the square of how far a query is from each level."""
    x = projections.T
    return np.stack([np.maximum(0, x + width / 2), np.maximum(0, np.abs(x) - width / 2), np.maximum(0, width / 2 - x)], axis=1) ** 2


def distances(gaps: np.ndarray, queries: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Squared distances of cells, planes added up in the order of ``probe_order``; places of ``queries`` in ``gaps``
    and ``cells`` are broadcast against each other."""
    near = np.zeros(1)
    for plane, levels in enumerate(gaps):
        near = near + levels[cells // LEVELS**plane % LEVELS, queries]
    return near


def _all_distances(gaps: np.ndarray, count: int) -> np.ndarray:
    """(query, cell) of the squared distances of all ``count`` cells."""
    near = np.zeros((gaps.shape[2], 1))
    for levels in gaps:
        near = (near[:, None, :] + levels.T[:, :, None]).reshape(len(near), -1)
    return near[:, :count]


def last_visits(
    projections: np.ndarray, width: float, probes: int, sizes: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """The last of the ``probes`` cells of each query in the order of ``probe_order``: its squared distance and itself.

    With the ``sizes`` of all cells, also the rows of the cells up to there.
    """
    count = LEVELS ** projections.shape[1]
    probes, far, last = min(probes, count), np.zeros(len(projections)), np.zeros(len(projections), np.int64)
    rows, step = np.zeros(len(projections), np.int64), max(1, ORDERED // count)
    for start in range(0, len(projections), step):
        part = slice(start, start + step)
        near = _all_distances(gaps_of(projections[part], width), count)
        at = np.partition(near, probes - 1, axis=1)[:, probes - 1]
        before, level = near < at[:, None], near == at[:, None]
        # of the cells at that distance, the first by number; mostly there is one
        left = probes - np.count_nonzero(before, axis=1)
        end = level.argmax(axis=1)
        for i in np.flatnonzero(left > 1):
            end[i] = np.flatnonzero(level[i])[left[i] - 1]
        far[part], last[part] = at, end
        if sizes is not None:
            # whole numbers far below 2 ** 53
            rows[part] = before.astype(np.float64) @ sizes + sizes[end]
            for i in np.flatnonzero(left > 1):
                rows[start + i] += sizes[np.flatnonzero(level[i])[: left[i] - 1]].sum()
    return (far, last) if sizes is None else (far, last, rows)


def places_of(projections: np.ndarray, width: float, wanted: np.ndarray) -> np.ndarray:
    """The place that the ``wanted`` cell of each query has in its order, from 1; cells are counted in parts."""
    count, gaps = LEVELS ** projections.shape[1], gaps_of(projections, width)
    own, places = distances(gaps, np.arange(len(wanted)), wanted), np.zeros(len(wanted), np.int64)
    step = max(1, ORDERED // max(1, len(wanted)))
    for start in range(0, count, step):
        cells = np.arange(start, min(count, start + step))
        near = distances(gaps, np.arange(len(wanted))[:, None], cells)
        places += ((near < own[:, None]) | ((near == own[:, None]) & (cells <= wanted[:, None]))).sum(axis=1)
    return places


@dataclass(frozen=True)
class ProbeReach:
    """Which rows a query meets: those of cells up to the last that it visits."""

    width: float
    column = "cell"
    columns = ("_at", "_far", "_last")

    def borders(self, cells: np.ndarray) -> list[int]:
        return [*range(0, len(cells), TILE[1]), len(cells)]

    def asking(self, queries: pa.Table) -> _Asking:
        at = queries.column("_at").combine_chunks()
        at = at.flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
        return _Asking(gaps_of(at, self.width), queries.column("_far").to_numpy(), queries.column("_last").to_numpy())


@dataclass
class _Asking:
    gaps: np.ndarray
    far: np.ndarray
    last: np.ndarray

    @property
    def floor(self) -> np.ndarray:
        return np.full(len(self.far), -np.inf)

    def near_any(self, cells: np.ndarray) -> np.ndarray:
        return np.arange(len(self.far))

    def meets(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """``rows`` of the queries and ``cells``, which are broadcast against each other."""
        near, far = distances(self.gaps, rows, cells), self.far[rows]
        return (near < far) | ((near == far) & (cells <= self.last[rows]))


def with_columns(df: DataFrame, fields: list[StructField], fn) -> DataFrame:
    """Add columns computed from the normalised vectors of a batch; ``fn`` gives arrays, lists of a row flat."""
    schema = StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = fn(DenseScore._matrix(pa.Table.from_batches([batch])))
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return df.mapInArrow(run, schema)


@dataclass
class ProbeIndex:
    """Index rows by cell; ``probes`` cells are visited for each query."""

    rows: DataFrame
    planes: np.ndarray
    width: float
    probes: int

    @classmethod
    def build(
        cls, index: DataFrame, queries: DataFrame, k: int, dimensions: int, recall: float = RECALL, planes: int | None = None
    ) -> ProbeIndex:
        """Fit width and number of planes on all rows, and the number of probes on ``SAMPLE`` queries.

        ``index`` is ``(id, ..., embedding, norm)``, ``queries`` ``(query_id, embedding, norm)``.
        """
        if planes is None:
            planes = planes_for(index.count())
        matrix = gaussian_planes(planes, dimensions)
        width = cls._width(index, matrix)
        placed = with_columns(
            index, [StructField("cell", LongType())], lambda m: [pa.array(cells_of(m @ matrix.T, width))]
        )
        # many small cells: rows in the order of their cells, so that files know which they hold
        placed = placed.repartitionByRange("cell", "id").sortWithinPartitions("cell")
        built = cls(materialize(placed, "cells"), matrix, width, LEVELS**planes)
        built.probes = built._measure(queries, k, recall)
        return built

    @staticmethod
    def _width(index: DataFrame, matrix: np.ndarray) -> float:
        squares = with_columns(
            index, [StructField("square", DoubleType())], lambda m: [pa.array(((m @ matrix.T) ** 2).mean(axis=1))]
        )
        return WIDTH * math.sqrt(squares.agg(F.avg("square")).first()[0] or 1.0)

    def _measure(self, queries: DataFrame, k: int, recall: float) -> int:
        """The number of probes that finds this share of the true neighbours of ``SAMPLE`` queries: a
        quantile of the places that their cells have in the orders of the queries."""
        sample = queries.orderBy(F.md5(F.col("query_id").cast("string")), "query_id").limit(SAMPLE)
        sample = materialize(sample.select("query_id", "embedding", "norm"), "sample")
        true = top_k_join(sample, self.rows, k, DenseScore(), payload=("cell",))
        # SAMPLE * k rows at most
        pairs = sample.join(true.select("query_id", "cell"), "query_id").select("embedding", "norm", "cell").toArrow()
        if not pairs.num_rows:
            return 1
        places = np.sort(places_of(DenseScore._matrix(pairs) @ self.planes.T, self.width, pairs.column("cell").to_numpy()))
        return int(places[math.ceil(recall * pairs.num_rows) - 1])

    def placed(self, queries: DataFrame) -> DataFrame:
        """Queries with their projections, the last cell they visit, at its squared distance, and the ``_rows`` of the
        cells up to there; as they are, if they have been placed. The distances of all cells are made for each query,
        so that tasks are of few queries, and what is found is written."""
        if {*ProbeReach.columns, "_rows"} <= set(queries.columns):
            return queries
        planes, width, probes = self.planes, self.width, self.probes
        # not more cells than a query has distances
        found = self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).toArrow()
        sizes = np.zeros(LEVELS ** len(planes))
        sizes[found.column("cell").to_numpy()] = found.column("rows").to_numpy()
        sent = queries.sparkSession.sparkContext.broadcast(sizes)

        def place(m: np.ndarray) -> list:
            at = m @ planes.T
            offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * at.shape[1])
            far, last, rows = last_visits(at, width, probes, sent.value)
            return [pa.ListArray.from_arrays(offsets, pa.array(at.ravel())), pa.array(far), pa.array(last), pa.array(rows)]

        n, cores = queries.count(), queries.sparkSession.sparkContext.defaultParallelism
        tasks = max(1, math.ceil(n / QUERY_BLOCK), min(3 * cores, math.ceil(n / TILE[0])))
        fields = [StructField("_at", ArrayType(DoubleType())), StructField("_far", DoubleType()), StructField("_last", LongType())]
        placed = with_columns(queries.repartition(tasks, "query_id"), [*fields, StructField("_rows", LongType())], place)
        return materialize(placed, "placed")

    def probe(self, queries: DataFrame) -> DataFrame:
        """The cells each query visits, as ``(query_id, cell)``."""
        planes, width, probes = self.planes, self.width, self.probes

        def visit(m: np.ndarray) -> list:
            step = max(1, ORDERED // min(LEVELS * probes, LEVELS ** len(planes)))
            parts = [probe_order(m[i : i + step] @ planes.T, width, probes)[0] for i in range(0, len(m), step)]
            cells = np.concatenate(parts)
            offsets = pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1])
            return [pa.ListArray.from_arrays(offsets, pa.array(cells.ravel()))]

        placed = with_columns(queries, [StructField("_cells", ArrayType(LongType()))], visit)
        return placed.select("query_id", F.explode("_cells").alias("cell"))

    def search(self, queries: DataFrame, k: int, **options) -> DataFrame:
        reach = ProbeReach(self.width)
        return top_k_join(
            self.placed(queries), self.rows, k, DenseScore(), group="cell", visits=self.probe(queries), reach=reach, **options
        )

    def candidate_fraction(self, queries: DataFrame) -> DataFrame:
        """One row: scored pairs as a share of all pairs. The rows of its cells are counted where a query is placed; no
        row per query and cell is made."""
        every = queries.agg(F.countDistinct("query_id")).scalar() * self.rows.agg(F.countDistinct("id")).scalar()
        scored = self.placed(queries).agg(F.sum("_rows").alias("scored"))
        return scored.select((F.col("scored") / every).alias("candidate_fraction"))
