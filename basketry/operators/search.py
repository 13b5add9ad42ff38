"""Top-k similarity join.

Queries meet index rows in blocks: one matrix product per block, of which only the best ``k`` index
rows per query leave the task. No row is made per pair. Few queries are sent to all partitions of the
index, which then is not shuffled; many queries are cut into blocks on both sides of a grid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    StructField,
    StructType,
)

from basketry.session import materialize, spread

SCORE_DIGITS = 6
# Queries are sent to every task up to this many rows and bytes, which are counted before.
MAX_BROADCAST_QUERIES = 4096
MAX_BROADCAST_BYTES = 64 << 20
# A grid cell holds up to so many rows of each side, and bytes. Blocks are large, as each side is copied once for
# every block of the other and each cell sends on its best k per query, and smaller only where there would be too few
# cells for the cores.
QUERY_BLOCK = 16_384
INDEX_BLOCK = 65_536
BLOCK_BYTES = 64 << 20
SMALL_QUERY_BLOCK = 4096
SMALL_INDEX_BLOCK = 2048
TILE = (512, 2048)  # queries x index rows scored at once inside a task
PAIRS = 4096  # pairs scored one by one at a time
MARGIN = 10.0**-SCORE_DIGITS  # what rounding may bring level


@dataclass(frozen=True)
class DenseScore:
    """Cosine of two dense vectors with their norms."""

    columns = ("embedding", "norm")

    def size(self) -> Column:
        """Bytes of a vector."""
        return F.size("embedding") * F.lit(8)

    def scores(self, queries: pa.Table, index: pa.Table) -> np.ndarray:
        return self._matrix(queries) @ self._matrix(index).T

    @staticmethod
    def _matrix(rows: pa.Table) -> np.ndarray:
        vectors = rows.column("embedding").combine_chunks()
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        norm = rows.column("norm").to_numpy().astype(np.float64)
        return flat.reshape(len(vectors), -1) / np.where(norm == 0, 1.0, norm)[:, None]


class _Vectors:
    """Normalised vectors in double and in single precision, which is twice as fast and tells which pairs are looked
    at. All scores that leave are of double precision."""

    def __init__(self, exact: np.ndarray, single: np.ndarray | None = None, longest: float | None = None):
        self.exact = exact
        with np.errstate(over="ignore", invalid="ignore"):
            self.single = exact.astype(np.float32) if single is None else single
            lengths = np.sqrt(np.einsum("ij,ij->i", exact, exact)) if longest is None else longest
        self.longest = float(np.max(lengths, initial=0.0))

    def __getitem__(self, rows) -> _Vectors:
        return _Vectors(self.exact[rows], self.single[rows], self.longest)

    def scores(self, others: _Vectors) -> tuple[np.ndarray, float]:
        """Scores of all pairs, and by how much they may be wrong."""
        slack = (self.exact.shape[1] + 4) * float(np.finfo(np.float32).eps) * self.longest * others.longest
        if slack < 0.01:
            return self.single @ others.single.T, slack
        return self.exact @ others.exact.T, 0.0  # long vectors, or numbers that are none

    def pairs(self, others: _Vectors, qi: np.ndarray, di: np.ndarray) -> np.ndarray:
        """Scores of the pairs of rows ``qi`` of these and ``di`` of the others."""
        if len(qi) * 16 > len(self.exact) * len(others.exact):
            return (self.exact @ others.exact.T)[qi, di]
        out = np.empty(len(qi))
        for i in range(0, len(qi), PAIRS):
            part = slice(i, i + PAIRS)
            out[part] = np.einsum("ij,ij->i", self.exact[qi[part]], others.exact[di[part]])
        return out


def _at_least(scores: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the scores from the row's ``least`` on; none of minus infinity."""
    least = np.maximum(least.astype(scores.dtype), np.finfo(scores.dtype).min)
    return np.divmod(np.flatnonzero(scores >= least[:, None]), scores.shape[1])


def _order_key(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that sort like the ids."""
    if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
        return column.to_numpy()
    return pc.rank(column.combine_chunks(), tiebreaker="dense").to_numpy()


def _keep_best(hits: pa.Table, query_id: str, index_id: str, k: int) -> pa.Table:
    """The best ``k`` rows per query, each pair once."""
    q, d = _order_key(hits.column(query_id)), _order_key(hits.column(index_id))
    score = hits.column("score").to_numpy()
    order = np.lexsort((d, -score, q))
    q, d = q[order], d[order]
    fresh = np.r_[True, (q[1:] != q[:-1]) | (d[1:] != d[:-1])] if len(q) else np.zeros(0, bool)
    order, q = order[fresh], q[fresh]
    return hits.take(pa.array(order[_rank_in_runs(q) < k]))


def _best_in_tile(queries: _Vectors, index: _Vectors, ids: np.ndarray, floor: np.ndarray | None, k: int):
    """Positions (query, index row) and rounded scores of the best ``k`` per query, ties by id.

    ``floor`` is a score per query that ``k`` rows of earlier tiles reach. Rows clearly below it are
    not looked at; the margin keeps those that rounding may bring level.
    """
    scores, slack = queries.scores(index)
    if floor is None:
        if scores.shape[1] > k:
            floor = np.partition(scores, -k, axis=1)[:, -k].astype(np.float64) - slack
        else:
            floor = np.full(len(scores), -np.inf)
    qi, di = _at_least(scores, floor - MARGIN - slack)
    exact = queries.pairs(index, qi, di)
    good = (exact >= floor[qi] - MARGIN) & (exact > -np.inf)
    qi, di, rounded = qi[good], di[good], np.round(exact[good], SCORE_DIGITS)
    order = np.lexsort((ids[di], -rounded, qi))
    qi, di, rounded = qi[order], di[order], rounded[order]
    rank = _rank_in_runs(qi)
    last = rank == k - 1
    floor = floor.copy()
    floor[qi[last]] = np.maximum(floor[qi[last]], rounded[last] - MARGIN)
    keep = rank < k
    return qi[keep], di[keep], rounded[keep], floor


def _rank_in_runs(values: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... inside each run of equal values."""
    if not len(values):
        return np.zeros(0, int)
    start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return np.arange(len(values)) - np.repeat(start, np.diff(np.r_[start, len(values)]))


def _score_block(
    scorer, queries: pa.Table, index: pa.Table, query_id, index_id, payload, k, asked: _Vectors | None = None
) -> pa.Table:
    """The best ``k`` of all pairs; ``asked`` are the vectors of the queries, if they are made already."""
    asked = _Vectors(scorer._matrix(queries)) if asked is None else asked
    names = [query_id, index_id, *payload, "score"]
    starts = range(0, queries.num_rows, TILE[0])
    floors, found = [None] * len(starts), []
    held = 0
    for d0 in range(0, index.num_rows, TILE[1]):
        d = index.slice(d0, TILE[1])
        ids, rows, carried = _order_key(d.column(index_id)), _Vectors(scorer._matrix(d)), d.select([index_id, *payload])
        for i, q0 in enumerate(starts):
            qi, di, score, floors[i] = _best_in_tile(asked[q0 : q0 + TILE[0]], rows, ids, floors[i], k)
            chosen = carried.take(pa.array(di))
            found.append(pa.table([queries.column(query_id).take(pa.array(q0 + qi)), *chosen.columns, pa.array(score)], names=names))
            held += len(qi)
        if held > 16 * k * queries.num_rows:
            found = [_keep_best(pa.concat_tables(found), query_id, index_id, k)]
            held = found[0].num_rows
    return _keep_best(pa.concat_tables(found), query_id, index_id, k)


def _score_reached(scorer, reach, queries: pa.Table, index: pa.Table, query_id, index_id, payload, k) -> pa.Table:
    """The best ``k`` of the pairs that ``reach`` lets meet. Rows are taken in the order of their cells; once a
    query has a floor, only pairs above it are asked for."""
    cells = index.column(reach.column).to_numpy()
    order = np.argsort(cells, kind="stable")
    index, cells = index.take(pa.array(order)), cells[order]
    ids = _order_key(index.column(index_id))
    # an id that comes more than once takes as many places
    places = k * int(np.unique(ids, return_counts=True)[1].max())
    carried, names = index.select([index_id, *payload]), [query_id, index_id, *payload, "score"]
    found = [pa.table([queries.column(query_id).slice(0, 0), *carried.slice(0, 0).columns, pa.array([], pa.float64())], names=names)]
    borders = reach.borders(cells)
    tiles = [(d0, d1, *np.unique(cells[d0:d1], return_inverse=True)) for d0, d1 in zip(borders, borders[1:])]
    vectors = _Vectors(scorer._matrix(index))
    for q0 in range(0, queries.num_rows, TILE[0]):
        q = queries.slice(q0, TILE[0])
        asking, asked, best = reach.asking(q), _Vectors(scorer._matrix(q)), []
        floor = asking.floor - MARGIN
        for d0, d1, own, place in tiles:
            rows = asking.near_any(own)
            if not len(rows):
                continue
            near, part = asked[rows], vectors[d0:d1]
            scores, slack = near.scores(part)
            least = floor[rows]
            blank = np.flatnonzero(least == -np.inf)
            if len(blank):
                met = asking.meets(rows[blank][:, None], own[None, :])
                scores[blank] = np.where(met[:, place], scores[blank], -np.inf)
                if scores.shape[1] > places:
                    least[blank] = np.partition(scores[blank], -places, axis=1)[:, -places].astype(np.float64) - slack
            qi, di = _at_least(scores, least - MARGIN - slack)
            met = asking.meets(rows[qi], cells[d0:d1][di])
            qi, di = qi[met], di[met]
            exact = near.pairs(part, qi, di)
            good = (exact >= least[qi] - MARGIN) & (exact > -np.inf)
            qi, di, rounded = qi[good], di[good], np.round(exact[good], SCORE_DIGITS)
            by_score = np.lexsort((ids[d0:d1][di], -rounded, qi))
            qi, di, rounded = qi[by_score], di[by_score], rounded[by_score]
            rank = _rank_in_runs(qi)
            last = rank == places - 1
            floor[rows[qi[last]]] = np.maximum(floor[rows[qi[last]]], rounded[last] - MARGIN)
            qi, di, rounded = (x[rank < places] for x in (qi, di, rounded))
            chosen = carried.take(pa.array(d0 + di))
            best.append(pa.table([q.column(query_id).take(pa.array(rows[qi])), *chosen.columns, pa.array(rounded)], names=names))
            if sum(b.num_rows for b in best) > 16 * k * q.num_rows:
                best = [_keep_best(pa.concat_tables(best), query_id, index_id, k)]
        if best:
            found.append(_keep_best(pa.concat_tables(best), query_id, index_id, k))
    return _keep_best(pa.concat_tables(found), query_id, index_id, k)


def top_k_join(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    scorer,
    query_id: str = "query_id",
    index_id: str = "id",
    payload: tuple[str, ...] = (),
    group: str | None = None,
    visits: DataFrame | None = None,
    reach=None,
    max_broadcast: int = MAX_BROADCAST_QUERIES,
    query_block: int = QUERY_BLOCK,
    index_block: int = INDEX_BLOCK,
) -> DataFrame:
    """``(query_id, rank, id, *payload, score)``: the ``k`` best index rows of each query.

    Scores are rounded before they are compared, ties go to the smaller id. With ``group``, a column of
    the index, a query meets only rows of the groups it ``visits``, rows ``(query_id, group)`` without
    repeats. Both ids must be unique (inside a group) and not null.

    Where a query visits many groups, ``reach`` says the same from a few ``columns`` of the query and the group
    of a row. Many queries then meet the index in blocks of ids, and no row per query and group is made.
    """
    q_cols = [query_id, *scorer.columns, *(reach.columns if reach else [])]
    i_cols = [index_id, *([group] if group else []), *payload, *scorer.columns]
    has_vector = F.col(scorer.columns[0]).isNotNull()
    queries, index = queries.filter(has_vector).select(*q_cols), index.filter(has_vector).select(*i_cols)
    if query_id in i_cols:
        raise ValueError(f"rename the query key: {query_id!r} is a column of the index too")
    schema = StructType(
        [queries.schema[query_id], index.schema[index_id]]
        + [index.schema[c] for c in payload]
        + [StructField("score", DoubleType())]
    )

    # computed once; the size decides how they meet the index
    queries = materialize(queries, "queries")
    row_bytes = scorer.size() + F.octet_length(F.col(query_id).cast("string")) + 16
    size = queries.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_bytes), F.lit(0)).alias("bytes")
    ).first()
    few, n_bytes = size["rows"] <= max_broadcast, size["bytes"]
    wide = max(SMALL_INDEX_BLOCK, BLOCK_BYTES * size["rows"] // max(1, n_bytes))
    blocks = min(query_block, wide), min(index_block, wide)
    if group and (few or not reach):
        visits = materialize(visits.select(query_id, group), "visits")
        n_bytes += 16 * visits.count() if few else 0
    if few and n_bytes <= MAX_BROADCAST_BYTES:
        sent = queries.select(query_id, *scorer.columns).toArrow(), visits.toArrow() if group else None
        hits = _against_all(*sent, index, k, scorer, query_id, index_id, payload, group, schema)
    elif reach:
        hits = _over_grid(queries, index, k, scorer, query_id, index_id, payload, None, schema, blocks, reach)
    else:
        if group:
            # small files may hold many rows: the planner would broadcast them by their bytes
            queries = queries.join(visits.hint("merge"), query_id)
        hits = _over_grid(queries, index, k, scorer, query_id, index_id, payload, group, schema, blocks)
    if group:
        hits = hits.groupBy(query_id, index_id, *payload).agg(F.max("score").alias("score"))
    best_first = Window.partitionBy(query_id).orderBy(F.desc("score"), index_id)
    return (
        hits.withColumn("rank", F.row_number().over(best_first))
        .filter(F.col("rank") <= k)
        .select(query_id, "rank", index_id, *payload, "score")
    )


def _against_all(
    queries: pa.Table, visits: pa.Table | None, index, k, scorer, query_id, index_id, payload, group, schema
) -> DataFrame:
    """Score each partition of the index against the few queries."""
    if group:
        # files of other groups are skipped where an index is written by group
        index = index.filter(F.col(group).isin(pc.unique(visits.column(group)).to_pylist()))
    sent = index.sparkSession.sparkContext.broadcast((queries, visits))
    tile = TILE[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few, where = sent.value
        if not few.num_rows:
            return
        meet = _Visits(few, where, scorer, query_id, group) if group else None
        asked = None if group else _Vectors(scorer._matrix(few))
        best = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for start in range(0, rows.num_rows, tile):
                part = rows.slice(start, tile)
                if meet:
                    hits = meet.hits(part, index_id, payload, k)
                else:
                    hits = _score_block(scorer, few, part, query_id, index_id, payload, k, asked)
                best = hits if best is None else pa.concat_tables([best, hits])
                if best.num_rows > 4 * k * few.num_rows:
                    best = _keep_best(best, query_id, index_id, k)
                    if meet:
                        meet.raise_floor(best, k)
        if best is not None:
            best = _keep_best(best, query_id, index_id, k)
            yield from best.combine_chunks().to_batches()

    return index.mapInArrow(run, schema)


class _Visits:
    """Which queries meet the rows of a group; vectors are kept once, however many groups a query visits."""

    def __init__(self, queries: pa.Table, visits: pa.Table, scorer, query_id: str, group: str):
        self.query_ids, self.matrix = queries.column(query_id).combine_chunks(), scorer._matrix(queries)
        self.scorer, self.query_id, self.group = scorer, query_id, group
        groups = visits.column(group).combine_chunks()
        order = pc.sort_indices(groups).to_numpy()
        self.rows = pc.index_in(visits.column(query_id).combine_chunks(), self.query_ids).to_numpy(zero_copy_only=False)[order]
        self.groups, self.starts = np.unique(groups.to_numpy(zero_copy_only=False)[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        self.floor = np.full(queries.num_rows, -np.inf)

    def raise_floor(self, best: pa.Table, k: int) -> None:
        """``best`` has each query's best rows in order: a ``k``-th one is a floor for all to come."""
        rows = pc.index_in(best.column(self.query_id).combine_chunks(), self.query_ids).to_numpy()
        last = _rank_in_runs(rows) == k - 1
        self.floor[rows[last]] = best.column("score").to_numpy()[last]

    def hits(self, part: pa.Table, index_id: str, payload, k: int) -> pa.Table:
        matrix = self.scorer._matrix(part)
        values = part.column(self.group).to_numpy()
        order = np.argsort(values, kind="stable")
        starts = np.flatnonzero(np.r_[True, values[order][1:] != values[order][:-1]])
        found = []
        for start, end in zip(starts, np.append(starts[1:], len(order))):
            at = np.searchsorted(self.groups, values[order[start]])
            if at == len(self.groups) or self.groups[at] != values[order[start]]:
                continue
            q_rows, d_rows = self.rows[self.starts[at] : self.ends[at]], order[start:end]
            scores = self.matrix[q_rows] @ matrix[d_rows].T
            floor = self.floor[q_rows]
            if scores.shape[1] > k:
                floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k])
            qi, di = np.nonzero(scores >= floor[:, None] - 10.0**-SCORE_DIGITS)
            found.append((q_rows[qi], d_rows[di], scores[qi, di]))
        qi, di, scores = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, int) for i in range(3))
        chosen = part.select([index_id, *payload]).take(pa.array(di, pa.int64()))
        hits = pa.table(
            [self.query_ids.take(pa.array(qi, pa.int64())), *chosen.columns, pa.array(np.round(scores.astype(float), SCORE_DIGITS))],
            names=[self.query_id, index_id, *payload, "score"],
        )
        return _keep_best(hits, self.query_id, index_id, k)


def _over_grid(queries, index, k, scorer, query_id, index_id, payload, group, schema, blocks, reach=None) -> DataFrame:
    """Cut both sides, of each group if there are groups, into blocks and pair the blocks.

    Ids are unique, so hashing them fills the blocks evenly, and a group of any size is spread over
    as many cells as its rows need.
    """
    spark = index.sparkSession
    # counted, then paired: what made it, a model perhaps, runs once. Both are copied many times, by all cores
    index = spread(materialize(index, "index"), index_id)
    queries = spread(queries, query_id)
    query_block, index_block = blocks
    cores = spark.sparkContext.defaultParallelism

    def block_counts(query_rows: Column, index_rows: Column) -> tuple[Column, Column]:
        n_q = F.ceil(query_rows / query_block)
        enough = F.least(F.ceil(index_rows / SMALL_INDEX_BLOCK), F.ceil(F.lit(3 * cores) / n_q))
        n_i = F.greatest(F.ceil(index_rows / index_block), enough)
        enough = F.least(F.ceil(query_rows / SMALL_QUERY_BLOCK), F.ceil(F.lit(3 * cores) / n_i))
        return F.greatest(n_q, enough).cast("long"), n_i.cast("long")

    if group:
        # one row per group; written, as both sides and all retries must see the same numbers
        sizes = [df.groupBy(group).agg(F.count(F.lit(1)).alias(n)) for df, n in ((queries, "_q"), (index, "_i"))]
        n_q, n_i = block_counts(F.col("_q"), F.col("_i"))
        sizes = sizes[0].join(sizes[1], group).select(group, n_q.alias("_nq"), n_i.alias("_ni"))
        sizes = materialize(sizes, "grid")
        queries, index = queries.join(sizes, group), index.join(sizes, group)
    else:
        n_q, n_i = block_counts(F.lit(queries.count()), F.lit(index.count()))
        queries, index = (df.withColumn("_nq", n_q).withColumn("_ni", n_i) for df in (queries, index))

    cell = [*([group] if group else []), "_qb", "_ib"]
    # a given number of partitions: cells are few bytes but much work, so small ones must not be joined
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def place(df: DataFrame, key: str, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_other) - 1))
        placed = df.withColumn(own, F.pmod(F.xxhash64(key), F.col(n_own))).withColumn(other, copies)
        return placed.drop("_nq", "_ni").repartition(partitions, *cell)

    q = place(queries, query_id, "_qb", "_nq", "_ib", "_ni")
    d = place(index, index_id, "_ib", "_ni", "_qb", "_nq")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            none = left.select([query_id]).slice(0, 0), right.select([index_id, *payload]).slice(0, 0)
            return pa.table(
                [*none[0].columns, *none[1].columns, pa.array([], pa.float64())],
                names=[query_id, index_id, *payload, "score"],
            )
        if reach:
            return _score_reached(scorer, reach, left, right, query_id, index_id, payload, k)
        return _score_block(scorer, left, right, query_id, index_id, payload, k)

    return q.groupBy(*cell).cogroup(d.groupBy(*cell)).applyInArrow(run, schema)

