"""Approximate nearest neighbours with an inverted multi-index.

Both halves of a vector are quantised by k-means of their own, so that ``K`` centroids a half make
``K * K`` cells. A query walks the pairs of centroids by summed distance with a heap until the cells
hold enough entries; all entries of the cells it reached are ranked by their exact inner product.

Centroids are fitted on a bounded sample, every row is indexed. How many entries a query has to visit
is measured: for a bounded set of sample queries the exact neighbours are searched among all rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import materialize, ship_code

FIT_ROWS = 20_000  # vectors that k-means sees, picked by hash
PROBES = 100  # queries whose exact neighbours set the number of entries to visit
CENTROIDS = 2_000  # a half at most, a tenth of the sample they are fitted on
ENTRIES = 64  # of a cell, on the average, in tables of more than 64 centroids a half
BLOCK = 8_192  # entries that meet a batch of queries in one matrix product
TARGET = 0.95  # recall that the visited entries reach for the sample queries
RESULT = "query_id long, vec_id long, score double"


def usable(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vec): rows with an id and a finite vector that is not zero, of the most frequent length.

    Several rows of one id count as one, with the smallest vector in array order.
    """
    vec = F.col(vector).cast("array<double>")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).filter("vec_id is not null and size(vec) > 0")
    rows = rows.filter(~bad).filter(F.exists("vec", lambda x: x != 0))
    rows = materialize(rows.groupBy("vec_id").agg(F.min("vec").alias("vec")), "vectors")
    sizes = rows.groupBy(F.size("vec").alias("n")).count()
    usual = sizes.agg(F.max(F.struct("count", "n"))).first()[0]
    return rows.filter(F.size("vec") == (usual.n if usual else 0))


def kmeans(points: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Centroids by Lloyd's rounds from a fixed start; an empty cluster keeps its centroid."""
    start = np.random.default_rng(11).permutation(len(points))[:k]
    centres = points[start].copy()
    for _ in range(rounds):
        near = _squared(points, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        count = np.bincount(near, minlength=len(centres))
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def _squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less the points' own squares, which order nothing."""
    return (centres * centres).sum(1) - 2 * np.einsum("nd,kd->nk", points, centres)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> tuple[list[tuple[int, int]], float]:
    """Pairs of centroids by rising summed distance, until their cells hold ``wanted`` entries.

    ``first`` and ``second`` are the distances to each half's centroids, ``counts[i, j]`` the entries of
    a cell. Returns the pairs with entries and the last sum.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, found, total, reach = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0, -math.inf
    while heap and total < wanted:
        reach, i, j = heapq.heappop(heap)
        n = counts[a[i], b[j]]
        if n:
            found.append((int(a[i]), int(b[j])))
            total += n
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return found, float(reach)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype="i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def centroids_for(rows: int, most: int = CENTROIDS) -> int:
    """Centroids a half for so many rows: about one entry a cell up to 64, then ``ENTRIES``, so that cells
    stay small as the table grows, up to ``most`` squared cells."""
    return max(2, min(most, max(min(64, math.isqrt(rows)), math.isqrt(rows // ENTRIES))))


class MultiIndex:
    """The index of a table of vectors; ``search`` takes any table of queries of the same width."""

    def __init__(self, rows: DataFrame, centroids: int = CENTROIDS, block: int = BLOCK):
        """``rows`` as ``usable`` returns them. What the driver holds is bounded by the parameters:
        ``FIT_ROWS`` vectors while fitting, the centroids and one count per cell afterwards."""
        ship_code()
        self.rows, self.block = rows, block
        self.count = rows.count()
        if not self.count:
            return
        k = centroids_for(self.count, centroids)
        share = min(1.0, FIT_ROWS / self.count)
        dice = F.pmod(F.xxhash64("vec_id", F.lit("fit")), F.lit(1 << 30)) < int(share * (1 << 30))
        sample = rows.filter(dice).orderBy("vec_id").limit(2 * FIT_ROWS).toArrow()
        sample = sample if sample.num_rows >= k else rows.orderBy("vec_id").limit(k).toArrow()
        self.width = len(sample["vec"][0])
        points = _matrix(sample["vec"].combine_chunks(), self.width)
        self.cut = self.width // 2
        self.halves = [kmeans(points[:, : self.cut], k), kmeans(points[:, self.cut :], k)]
        index = rows.mapInArrow(self._assign(), "vec_id long, vec array<double>, cell int")
        self.index = materialize(index, "cells")
        self.cells = np.zeros((k, len(self.halves[1])), dtype="i8")
        for cell, n in self.index.groupBy("cell").count().collect():  # at most K * K
            self.cells[divmod(cell, self.cells.shape[1])] = n
        # neighbouring cells share a block, a large cell has several
        running = np.cumsum(self.cells.ravel()) - self.cells.ravel()
        self.block_of = (running // block).astype("i8")
        self.parts = np.maximum(1, -(-self.cells.ravel() // block)).astype("i8")

    def _assign(self):
        halves, cut, width = self.halves, self.cut, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    points = _matrix(batch.column(1), width)
                    first = _squared(points[:, :cut], halves[0]).argmin(1)
                    second = _squared(points[:, cut:], halves[1]).argmin(1)
                    cell = pa.array((first * len(halves[1]) + second).astype("i4"))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cell], names=["vec_id", "vec", "cell"])

        return run

    def search(self, queries: DataFrame, k: int, wanted: int) -> DataFrame:
        """The best ``k`` of at least ``wanted`` visited entries: query_id, rank, vec_id, score.

        ``queries`` has vec_id and vec. An entry with the query's own id is never a result. Each block
        of entries is loaded once and the queries that reach it stream past in batches; only their best
        ``k`` leave the task. Ties go to the smaller vec_id.
        """
        index, sent = self._entries(), queries.mapInArrow(self._route(max(wanted, k + 1)), index_schema())
        both = index.unionByName(sent).repartition("block").sortWithinPartitions("block", "kind", "vec_id")
        found = both.mapInArrow(self._meet(k), RESULT)
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        return found.select("query_id", "rank", "vec_id", "score")

    def _entries(self) -> DataFrame:
        block_of, parts = self.block_of, self.parts
        # one value per cell: bounded by the number of centroids
        first = F.element_at(F.lit([int(x) for x in block_of]), F.col("cell") + 1)
        many = F.element_at(F.lit([int(x) for x in parts]), F.col("cell") + 1)
        return self.index.select(
            (first + F.pmod(F.xxhash64("vec_id"), many)).alias("block"), F.lit(0).alias("kind"), "vec_id", "vec", "cell", F.lit(0.0).alias("reach")
        )

    def _route(self, wanted: int):
        halves, cut, width, cells, block_of, parts = self.halves, self.cut, self.width, self.cells, self.block_of, self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, points = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
                first, second = _squared(points[:, :cut], halves[0]), _squared(points[:, cut:], halves[1])
                rows, blocks, reaches = [], [], []
                for i in range(len(ids)):
                    found, reach = walk(first[i], second[i], cells, wanted)
                    at = np.array([a * cells.shape[1] + b for a, b in found])
                    own = np.unique(np.concatenate([block_of[at]] + [block_of[c] + np.arange(parts[c]) for c in at[parts[at] > 1]]))
                    blocks.append(own)
                    rows.append(np.full(len(own), i))
                    reaches.append(np.full(len(own), reach))
                    if sum(map(len, rows)) > 4096 or i == len(ids) - 1:
                        at, n = np.concatenate(rows), sum(map(len, rows))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.concatenate(blocks)), pa.array(np.ones(n, "i4")), pa.array(ids[at]),
                                _lists(points[at]), pa.array(np.full(n, -1, "i4")), pa.array(np.concatenate(reaches)),
                            ],
                            names=["block", "kind", "vec_id", "vec", "cell", "reach"],
                        )
                        rows, blocks, reaches = [], [], []

        return run

    def _meet(self, k: int):
        halves, cut, width = self.halves, self.cut, self.width

        def best(ids, vecs, cells, query_ids, queries, reaches):
            first, second = _squared(queries[:, :cut], halves[0]), _squared(queries[:, cut:], halves[1])
            a, b = np.divmod(cells, len(halves[1]))
            score = queries @ vecs.T
            out = first[:, a] + second[:, b] > reaches[:, None] + 1e-9 * (1 + np.abs(reaches[:, None]))
            score[out | (ids[None, :] == query_ids[:, None])] = -np.inf
            # a little more than k by the fast product, then exactly, always summed in the same order
            least = -np.inf if score.shape[1] <= k else np.partition(score, -k, axis=1)[:, -k]
            with np.errstate(invalid="ignore"):
                q, v = np.nonzero((score >= (least - 1e-9 * (1 + np.abs(least)))[:, None] if score.shape[1] > k else np.isfinite(score)) & np.isfinite(score))
            exact = np.zeros(len(q))
            for d in range(width):
                exact += queries[q, d] * vecs[v, d]
            order = np.lexsort((ids[v], -exact, q))
            q, v, exact = q[order], v[order], exact[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
            keep = rank < k
            return pa.RecordBatch.from_arrays(
                [pa.array(query_ids[q[keep]]), pa.array(ids[v[keep]]), pa.array(exact[keep])], names=["query_id", "vec_id", "score"]
            )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, parts, loaded = None, [], None
            for batch in batches:
                if not batch.num_rows:
                    continue
                block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
                change = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
                for lo, hi in zip([0, *change], [*change, len(block)]):
                    part = batch.slice(lo, hi - lo)
                    if block[lo] != now:
                        now, parts, loaded = block[lo], [], None
                    if kind[lo] == 0:
                        parts.append((part.column("vec_id").to_numpy(), _matrix(part.column("vec"), width), part.column("cell").to_numpy()))
                        continue
                    if loaded is None and parts:
                        loaded = [np.concatenate(x) for x in zip(*parts)]
                    if loaded is not None:
                        for s in range(0, hi - lo, 256):
                            few = part.slice(s, 256)
                            yield best(*loaded, few.column("vec_id").to_numpy(), _matrix(few.column("vec"), width), few.column("reach").to_numpy())

        return run

    def entries_to_visit(self, queries: DataFrame, k: int, target: float = TARGET) -> int:
        """How many entries reach ``target`` of the true neighbours of ``PROBES`` queries, picked by hash."""
        some = queries.orderBy(F.xxhash64("vec_id", F.lit("probe")), "vec_id").limit(PROBES)
        some = materialize(some, "probes")
        truth = self.search(some, k, self.count)
        hits = truth.join(self.index.select("vec_id", "cell"), "vec_id").select("query_id", "cell").collect()  # PROBES * k
        points = {r.vec_id: np.array(r.vec) for r in some.collect()}
        visited, before = [], {}
        for query, cell in hits:
            if query not in before:
                p = points[query][None, :]
                near = _squared(p[:, : self.cut], self.halves[0]).T + _squared(p[:, self.cut :], self.halves[1])
                order = np.argsort(near.ravel(), kind="stable")
                reached = np.empty(len(order), dtype="i8")
                reached[order] = np.cumsum(self.cells.ravel()[order])
                before[query] = reached
            visited.append(before[query][cell])
        return int(np.quantile(visited, target, method="higher")) if visited else self.count


def index_schema() -> str:
    return "block long, kind int, vec_id long, vec array<double>, cell int, reach double"


def nearest(rows: DataFrame, every: int = 20, k: int = 20, target: float = TARGET, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest of each row whose id is divisible by ``every``, among all other rows.

    Rows without an id or with a vector that is null, zero, of another length, or holds null or
    non-finite components take no part; no rows give no rows; other columns are ignored.
    """
    index = MultiIndex(usable(rows, id_col, vector))
    if not index.count:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = index.rows.filter(F.col("vec_id") % every == 0)
    return index.search(queries, k, index.entries_to_visit(queries, k, target))
