"""Inverted index with weight bounds: top-k cosine of sparse vectors without scoring every pair.

A posting is ``(term, block, id, weight)`` with the weight the term has in the normalised vector of the
row. Blocks are weight classes: weights of block ``b`` are at most ``2 ** -b``. Vectors have length one, so
what two of them can still add to a score is bounded by the lengths of what has not been seen
(Cauchy-Schwarz):

* a first join on the heaviest terms of each query gives partial scores, whose ``k``-th best is a floor
  under the query's ``k``-th score;
* a row that shares no term before a certain one, by falling weight, cannot reach the floor: rows are
  looked for under the terms up to there only, and of these only in the blocks whose weights can still
  lead to the floor;
* of the rows met, those whose partial score and unseen rest stay below the floor are dropped;
* the terms after that one, as a rule the frequent ones, are added up for the few rows left. A query
  whose postings lie mostly in its first terms takes all terms at once instead.

Only rows that share a term with a query are ever paired with it.

Terms of few rows are told apart before that. Their postings are joined as they are. In the other terms many rows
agree, as many queries do: a row that shares no rare term scores like all rows of equal weights in the frequent
terms that are asked for, so that only the ``k`` smallest ids of such a class can be among the best. The steps above
run on classes of rows and of queries, each class once.

Queries few enough to be sent to every task go another way: the postings of their terms are dealt by row,
each task adds up its rows and sends on the ``k`` best it has seen for a query. The ``k``-th best so far
is the floor under which it looks at no more rows, and no pair leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from basketry.operators.search import MAX_BROADCAST_BYTES, SCORE_DIGITS, _keep_best, _rank_in_runs
from basketry.operators.skew import splittable
from basketry.session import materialize

LAST_BLOCK = 15  # holds all smaller weights too
SEED_SHARE = 0.5  # of a query's squared length that the terms of the first join hold
WORTH = 0.5  # share of a query's postings that the later terms must have to be put off
PRODUCTS = 4_000_000  # products added up at a time inside a task
# a floor is lowered by what rounding may bring level, and by sums taken in another order
MARGIN = 2 * 10.0**-SCORE_DIGITS
RARE = 32  # rows that have a rare term, at most
ASKING = 256  # queries that a posting may meet, on average, where every task looks at all queries


def block_of(weight: Column) -> Column:
    """The weight class: 0 for weights above 1/2, 1 for those above 1/4, and so on."""
    return F.least(F.lit(LAST_BLOCK), F.greatest(F.lit(0), F.ceil(-F.log2(weight)) - 1)).cast("int")


def with_blocks(entries: DataFrame) -> DataFrame:
    """Entries ``(id, term, weight)`` of normalised vectors as postings."""
    return entries.select("term", block_of(F.col("weight")).alias("block"), "id", "weight")


def query_terms(weights: DataFrame) -> DataFrame:
    """``(query_id, term, weight, df)``, any length, -> normalised, with ``before``: the squared length of
    the query's heavier terms."""
    whole = Window.partitionBy("query_id")
    rows = weights.withColumn("weight", F.col("weight") / F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(whole)))
    heavier = whole.orderBy(F.desc("weight"), "term").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum(F.col("weight") * F.col("weight")).over(heavier), F.lit(0.0)))


def partial_scores(terms: DataFrame, postings: DataFrame, on: list[str]) -> DataFrame:
    """``(query_id, id, partial, seen, asked)``: the score over the terms joined, and how much of the
    squared lengths of row and query these terms are. ``terms`` may set a ``least`` weight."""
    met = terms.withColumnRenamed("weight", "_q").join(postings, on)
    if "least" in terms.columns:
        met = met.filter(F.col("weight") >= F.col("least"))
    return met.groupBy("query_id", "id").agg(
        F.sum(F.col("_q") * F.col("weight")).alias("partial"),
        F.sum(F.col("weight") * F.col("weight")).alias("seen"),
        F.sum(F.col("_q") * F.col("_q")).alias("asked"),
    )


def floors(partials: DataFrame, k: int) -> DataFrame:
    """``(query_id, floor)``: a score that ``k`` rows reach; queries that met fewer rows have none."""
    best = Window.partitionBy("query_id").orderBy(F.desc("partial"))
    top = partials.select("query_id", "partial").withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k)
    return top.filter(F.col("_r") == k).select("query_id", (F.col("partial") - MARGIN).alias("floor"))


def with_bounds(terms: DataFrame, floor: DataFrame) -> DataFrame:
    """Terms with the query's floor, with ``first``: whether rows are looked for under the term, and the
    ``least`` weight worth a look.

    A row whose heaviest shared term is t scores at most ``sqrt(1 - before)``. One that has t with
    weight w scores at most the cosine of the difference of the angles that w and the query's weight
    stand for, which is solved for w.
    """
    rows = terms.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    reach = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("before")))
    rows = rows.withColumn("first", reach >= F.col("floor"))
    whole = Window.partitionBy("query_id")
    later = F.sum(F.when(~F.col("first"), F.col("df")).otherwise(F.lit(0))).over(whole)
    put_off = later >= WORTH * F.sum("df").over(whole)
    rows = rows.withColumn("first", F.col("first") | ~put_off)
    angle = F.acos(F.least(F.lit(1.0), F.col("weight"))) + F.acos(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("floor"))))
    return rows.withColumn("least", F.when(angle < F.pi() / 2, F.cos(angle)).otherwise(F.lit(0.0)))


def candidates(bounded: DataFrame, postings: DataFrame) -> DataFrame:
    """``(query_id, id, partial)`` of all rows that can be among the ``k`` best, and few others.

    A row dropped under one of its terms is out whatever the others add, so a partial score that lacks
    such a term does no harm.
    """
    last = F.when(F.col("least") > 0, block_of(F.col("least"))).otherwise(F.lit(LAST_BLOCK))
    blocks = F.explode(F.sequence(F.lit(0), last)).alias("block")
    first = bounded.filter("first").select("query_id", "term", "weight", "least", blocks)
    met = partial_scores(first, postings, ["term", "block"])
    floor = bounded.groupBy("query_id").agg(F.max("floor").alias("floor"))
    unseen = F.greatest(F.lit(0.0), 1 - F.col("seen")) * F.greatest(F.lit(0.0), 1 - F.col("asked"))
    met = met.join(floor, "query_id").filter(F.col("partial") + F.sqrt(unseen) >= F.col("floor"))
    return met.select("query_id", "id", "partial")


def top_k(
    weights: DataFrame, postings: DataFrame, k: int, kept: bool = True, max_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` rows of the highest cosine for each query.

    ``weights`` are ``(query_id, term, weight, df)`` of known terms, ``df`` the rows that have the term.
    Rows without a common term do not match. Scores are rounded before they are compared, ties go to
    the smaller id. Query terms of up to ``max_bytes``, counted before, are sent to every task, if a posting then
    meets few queries (``ASKING``), so that the work grows with the postings.
    Postings that are not ``kept`` in a table are written if they are read repeatedly.
    """
    terms = materialize(query_terms(weights), "query-terms")
    row_bytes = F.octet_length("term") + F.octet_length(F.col("query_id").cast("string")) + 24
    asked = terms.groupBy("term").agg(F.sum(row_bytes).alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("df").alias("df"))
    size = asked.agg(F.sum("bytes").alias("bytes"), F.sum(F.col("n") * F.col("df")).alias("products"), F.sum("df").alias("rows")).first()
    if (size["bytes"] or 0) <= max_bytes and (size["products"] or 0) <= ASKING * (size["rows"] or 0):
        scored = _by_row(terms, postings, k)
    else:
        found = _with_floors(terms, postings if kept else materialize(postings, "postings"), k)
        scored = found.select("query_id", "id", F.round("partial", SCORE_DIGITS).alias("score"))
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = scored.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")


def _by_row(terms: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, score)``, the best ``k`` of each task, for queries that fit into every task."""
    sent = terms.sparkSession.sparkContext.broadcast(terms.select("query_id", "term", "weight").toArrow())
    matched = postings.join(terms.select("term").distinct(), "term", "left_semi").select("id", "term", "weight")
    schema = StructType([terms.schema["query_id"], postings.schema["id"], StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adder, rest = _RowScores(sent.value, k), None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
            # the last row may go on in the next batch
            ids = rows.column("id")
            last = pc.index(ids, ids[-1]).as_py() if rows.num_rows else 0
            adder.add(rows.slice(0, last))
            rest = rows.slice(last)
        if rest is not None:
            adder.add(rest)
        if adder.found:
            yield from adder.best().to_batches()

    return matched.repartition("id").sortWithinPartitions("id").mapInArrow(run, schema)


class _RowScores:
    """Adds up the scores of rows for all queries and keeps the best ``k`` of each query."""

    def __init__(self, terms: pa.Table, k: int):
        self.k = k
        coded = terms.column("term").combine_chunks().dictionary_encode()
        asked = terms.column("query_id").combine_chunks().dictionary_encode()
        self.vocabulary, self.query_ids = coded.dictionary, asked.dictionary
        order = np.argsort(coded.indices.to_numpy(), kind="stable")
        self.queries = asked.indices.to_numpy().astype(np.int64)[order]
        self.weights = terms.column("weight").to_numpy()[order]
        self.counts = np.bincount(coded.indices.to_numpy(), minlength=len(self.vocabulary))
        self.starts = np.cumsum(self.counts) - self.counts
        self.floor = np.full(len(self.query_ids), -np.inf)
        self.found: list[pa.Table] = []
        self.held = 0

    def add(self, rows: pa.Table) -> None:
        """Whole rows ``(id, term, weight)``, one after the other, with terms of the queries."""
        if not rows.num_rows:
            return
        ids = rows.column("id").combine_chunks()
        row = np.concatenate([[0], np.cumsum(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False))])
        term = pc.index_in(rows.column("term").combine_chunks(), self.vocabulary).to_numpy()
        weight = rows.column("weight").to_numpy()
        products = np.cumsum(self.counts[term])
        begin = 0
        while begin < len(row):
            # as many whole rows as give about so many products
            end = int(np.searchsorted(products, (products[begin - 1] if begin else 0) + PRODUCTS, side="right"))
            end = int(np.searchsorted(row, row[max(begin, min(end, len(row) - 1))], side="left")) if end < len(row) else len(row)
            if end <= begin:
                end = int(np.searchsorted(row, row[begin], side="right"))
            self._add(ids.slice(begin, end - begin), row[begin:end] - row[begin], term[begin:end], weight[begin:end])
            begin = end

    def _add(self, ids: pa.Array, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        count = self.counts[term]
        ends = np.cumsum(count)
        at = np.arange(ends[-1]) + np.repeat(self.starts[term] - (ends - count), count)
        width = len(self.query_ids)
        pair = np.repeat(row * width, count) + self.queries[at]
        product = np.repeat(weight, count) * self.weights[at]
        cells = (int(row[-1]) + 1) * width
        if cells <= 8 * len(pair):
            score = np.bincount(pair, product, cells)
            pair = np.flatnonzero(score)
            score = score[pair]
        else:
            pair, place = np.unique(pair, return_inverse=True)
            score = np.bincount(place, product)
        query = pair % width
        good = score >= self.floor[query] - 10.0**-SCORE_DIGITS
        pair, query, score = pair[good], query[good], np.round(score[good], SCORE_DIGITS)
        first = np.searchsorted(row, pair // width)  # an entry of the row, for its id
        names = pa.array(query), ids.take(pa.array(first)), pa.array(score)
        self.found.append(_keep_best(pa.table(list(names), names=["query", "id", "score"]), "query", "id", self.k))
        self.held += self.found[-1].num_rows
        if self.held > 4 * self.k * width:
            self._cut()

    def _cut(self) -> None:
        best = _keep_best(pa.concat_tables(self.found), "query", "id", self.k)
        query = best.column("query").to_numpy()
        last = _rank_in_runs(query) == self.k - 1
        self.floor[query[last]] = best.column("score").to_numpy()[last]
        self.found, self.held = [best], best.num_rows

    def best(self) -> pa.Table:
        self._cut()
        best = self.found[0].combine_chunks()
        return pa.table([self.query_ids.take(best.column("query")), best.column("id"), best.column("score")], names=["query_id", "id", "score"])


def _with_floors(terms: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, partial)`` with the whole scores of all rows that can be among the best."""
    rare, frequent = terms.filter(F.col("df") <= RARE), terms.filter(F.col("df") > RARE)
    near = materialize(partial_scores(rare.select("query_id", "term", "weight"), postings, ["term"]), "rare-pairs")
    reached = materialize(floors(near, k), "rare-floors")
    alike = _class_hits(frequent, postings, reached, k)
    # a row that shares a rare term needs the others too, if these can lead it to the k-th best
    floor = reached.unionByName(floors(alike, k)).groupBy("query_id").agg(F.max("floor").alias("floor"))
    unseen = F.greatest(F.lit(0.0), 1 - F.col("seen")) * F.greatest(F.lit(0.0), 1 - F.col("asked"))
    near = near.join(floor, "query_id", "left").filter(F.col("partial") + F.sqrt(unseen) >= F.coalesce("floor", F.lit(0.0)))
    near = near.select("query_id", "id", "partial")
    whole = _added_up(near, frequent.select("query_id", "term", F.col("weight").alias("_q")), postings)
    # a pair of both kinds has its whole score in the first
    best = alike.unionByName(whole).groupBy("query_id", "id")
    return best.agg(F.max("partial").alias("partial"))


def _added_up(found: DataFrame, later: DataFrame, postings: DataFrame) -> DataFrame:
    """Pairs ``(query_id, id, partial)`` with what the ``later`` terms ``(query_id, term, _q)`` add.

    The pairs ask for the weights of their rows, so that a term of many rows and queries is not joined as a whole.
    """
    asked = found.select("query_id", "id").join(later, "query_id")
    more = asked.join(postings.select("term", "id", "weight"), ["id", "term"])
    more = more.select("query_id", "id", (F.col("_q") * F.col("weight")).alias("partial"))
    return found.unionByName(more).groupBy("query_id", "id").agg(F.sum("partial").alias("partial"))


def _profiles(entries: DataFrame, key: str) -> DataFrame:
    """``(key, profile, class)``: the terms and weights of each key, and 128 bits that stand for them."""
    rows = entries.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("profile"))
    bits = F.struct(F.xxhash64("profile").alias("a"), F.xxhash64(F.lit(1), "profile").alias("b"))
    return rows.withColumn("class", bits)


def _class_hits(frequent: DataFrame, postings: DataFrame, reached: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, partial)`` over the frequent terms: the ``k`` best rows of each query, without those that cannot
    come up to the floors ``reached``."""
    vocabulary = frequent.select("term").distinct()
    rows = _profiles(postings.join(vocabulary, "term", "left_semi").select("id", "term", "weight"), "id")
    place = F.row_number().over(Window.partitionBy("class").orderBy("id"))
    members = materialize(rows.withColumn("place", place).filter(F.col("place") <= k), "row-classes")
    firsts = members.filter("place = 1")
    own = materialize(with_blocks(firsts.select("id", F.inline("profile"))), "class-postings")

    # equal queries are asked once, under the smallest of their ids, with the lowest of their floors
    queries = _profiles(frequent.select("query_id", "term", "weight"), "query_id").join(reached, "query_id", "left")
    queries = materialize(queries.withColumn("floor", F.coalesce("floor", F.lit(0.0))), "query-classes")
    asked = queries.groupBy("class").agg(
        F.min("query_id").alias("asked_as"), F.min("floor").alias("floor"), F.first("profile").alias("profile")
    )
    asked = materialize(asked, "asked-classes")
    weights = asked.select(F.col("asked_as").alias("query_id"), F.inline("profile"))
    weights = weights.join(own.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term")
    length = F.sqrt(F.aggregate("profile", F.lit(0.0), lambda total, x: total + x["weight"] * x["weight"]))
    scale = asked.select(F.col("asked_as").alias("query_id"), length.alias("length"), "floor")
    best = _class_scores(weights, own, scale, k).join(scale.drop("floor"), "query_id")
    best = best.select("query_id", "id", (F.col("partial") * F.col("length")).alias("partial"))
    best = best.withColumn("score", F.round("partial", SCORE_DIGITS))
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = best.withColumn("_r", F.row_number().over(best_first)).filter(F.col("_r") <= k)

    # the k smallest ids of each class, of them the k best
    best = best.join(firsts.select("id", "class"), "id").select("query_id", "score", "partial", "class")
    best = best.join(members.select("class", F.col("id")), "class")
    best = best.withColumn("_r", F.row_number().over(best_first)).filter(F.col("_r") <= k)
    best = best.select(F.col("query_id").alias("asked_as"), "id", "partial")
    best = materialize(best.join(asked.select("asked_as", "class"), "asked_as").select("class", "id", "partial"), "class-hits")
    # one class may hold most queries
    return queries.select("query_id", "class").join(splittable(best, "class", "id"), "class").select("query_id", "id", "partial")


def _class_scores(weights: DataFrame, postings: DataFrame, scale: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, partial)``: the cosines of all rows that can be among the ``k`` best, by seeds and bounds.

    ``scale`` holds, per query, the ``length`` its ``weights`` have and a ``floor`` for scores of that length.
    """
    terms = materialize(query_terms(weights), "class-terms")
    known = scale.select("query_id", (F.col("floor") / F.col("length")).alias("_known"), (MARGIN / F.col("length") - MARGIN).alias("_more"))
    reach = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("before")))
    heavy = terms.filter(F.col("before") < SEED_SHARE).join(known, "query_id").filter(reach >= F.col("_known"))
    seeds = partial_scores(heavy.select("query_id", "term", "weight"), postings, ["term"])
    floor = known.join(floors(seeds, k), "query_id", "left")
    # scores of a short query are closer together than its cosines
    seeded = F.coalesce(F.col("floor") - F.col("_more"), F.lit(0.0))
    floor = floor.select("query_id", F.greatest("_known", seeded, F.lit(0.0)).alias("floor"))
    bounded = materialize(with_bounds(terms, floor), "bounded-terms")
    found = materialize(candidates(bounded, postings), "candidates")
    later = bounded.filter("not first").select("query_id", "term", F.col("weight").alias("_q"))
    return _added_up(found, later, postings)
