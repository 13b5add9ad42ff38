"""Mixing sources to target weights by cube-method balanced sampling.

Each document of a source is taken ``floor(target / size)`` times in whole and once more with the
fraction that is left as its inclusion probability. The flight phase moves these probabilities along
the null space of the balancing constraints (words and documents of the source), three documents at a
time, until at most two of a group are undecided. Which way along the null space is drawn so that each
probability stays the mean of what becomes of it; the draws come from a seed and the group, so a rerun
makes the same. Groups fly side by side; what they leave undecided flies together in further rounds.
The last round of a source holds back a few documents of many sizes; these and what its flight leaves
are the landing problem, small enough to try every choice.

Rows equal in id, source and size are one unit with a number: what the fractions of all of them add up to in
whole is taken, and the rest flies as one. So no group holds many equal rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import materialize, set_aside, ship_code

WEIGHTS = (3, 1, 2)
SHARE = 1.5  # words to take, times the words there are
MOST = 2  # times that a source may be taken
CHUNK = 2_000  # documents that fly together
ALIKE = 100_000  # equal rows that one task writes out
LANDING = 12  # documents of a source held back for the landing, besides the two that a flight leaves
_NEAR = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, documents) -> the same with ``target``.

    Sources in code point order, null last, get the weights in turn. A target is the source's weight
    times one level for all, at most ``most`` times its size: the level at which the targets add up
    to the share, where handing on the excess by weight ends. One row per source; the running sums
    along the sources are the only step in a single task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("_w", F.element_at(kinds, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("_cap", F.col("source_size") * float(most))
    # sources that reach their cap first come first; at each one: what is left if all before are full
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    above = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("_all", F.sum("source_size").over(Window.partitionBy()) * share)
    rows = rows.withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(above), F.lit(0.0))) / F.sum("_w").over(rest))
    rows = rows.withColumn("_open", F.col("_level") * F.col("_w") <= F.col("_cap"))
    level = F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("target", F.least(F.col("_cap"), F.coalesce(level * F.col("_w"), F.col("_cap"))))
    return rows.select("source", "source_size", "documents", "target")


def fly(size: np.ndarray, prob: np.ndarray, seed: int = 0) -> np.ndarray:
    """The flight phase: all but two probabilities become 0 or 1; sums of p and of size * p are kept, and
    over all seeds the mean of what a probability becomes is the probability."""
    dice = np.random.default_rng(seed)
    p = prob.astype(float).tolist()
    s = size.astype(float).tolist()
    pool: list[int] = []
    for i in range(len(p)):
        if not _NEAR < p[i] < 1 - _NEAR:
            p[i] = float(round(p[i]))
            continue
        pool.append(i)
        while len(pool) == 3:
            a, b, c = pool
            u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)  # equal sizes: only the count binds
            up = min((1 - p[i_]) / x if x > 0 else p[i_] / -x for i_, x in zip(pool, u) if x)
            down = min(p[i_] / x if x > 0 else (1 - p[i_]) / -x for i_, x in zip(pool, u) if x)
            # a step that is likelier the shorter it is does not move the mean
            step = up if dice.random() * (up + down) < down else -down
            for i_, x in zip(pool, u):
                p[i_] += step * x
                if p[i_] < _NEAR or p[i_] > 1 - _NEAR:
                    p[i_] = float(round(p[i_]))
            pool = [i_ for i_ in pool if 0.0 < p[i_] < 1.0]
    return np.array(p)


def land(size: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Settle the few that are undecided: of all choices whose number is within one of the sum of the
    probabilities, the one whose words come nearest to what the probabilities promise."""
    p = prob.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_):
        choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        words = np.abs(choices @ size[open_] - float(size[open_] @ p[open_]))
        count = np.abs(choices.sum(axis=1) - p[open_].sum())
        p[open_] = choices[np.lexsort((count, words, count >= 1))[0]]
    return p


def _fly_group(rows: pd.DataFrame) -> pd.DataFrame:
    # long documents fly first, so that those undecided at the end tend to be short
    rows = rows.sort_values(["size", "doc_id", "prob"], ascending=[False, True, True], kind="stable", na_position="last")
    size = rows["size"].to_numpy()
    prob = rows["prob"].to_numpy()
    seed = zlib.crc32(f"{rows['source'].iloc[0]}:{rows['chunk'].iloc[0]}:{len(rows)}:{rows['seed'].iloc[0]}".encode())
    if rows["last"].iloc[0]:
        stay = np.flatnonzero((prob > _NEAR) & (prob < 1 - _NEAR) & (size > 0))
        stay = stay[np.unique(np.linspace(0, len(stay) - 1, LANDING).astype(int))] if len(stay) else stay
        flying = np.setdiff1d(np.arange(len(prob)), stay)
        prob = prob.copy()
        prob[flying] = fly(size[flying], prob[flying], seed)
        prob = land(size, prob)
    else:
        prob = fly(size, prob, seed)
    return rows.assign(prob=prob)


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0
) -> DataFrame:
    """How often each document is taken: doc_id, source, size, source_size, target, copies, taken.

    One row per input row. The size is the number of words; null and empty texts have none and are
    taken or not without effect on the words. A null source is a source. Null ids and repeated rows
    are documents of their own; rows equal in id, source and size are interchangeable, and what is taken
    of them is dealt evenly. With one seed a rerun gives the same rows. Other columns are ignored; an
    empty frame gives an empty frame.
    """
    units = _units(docs, weights, share, most, seed)
    # a group of equal rows is written out in runs of bounded length
    runs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / ALIKE))
    many = units.filter(F.col("rows") > ALIKE).withColumn("_run", F.explode(runs)).repartition("doc_id", "source", "size", "_run")
    few = units.filter(F.col("rows") <= ALIKE).withColumn("_run", F.lit(0).cast("long"))
    units = few.unionByName(many)
    first = F.col("_run") * ALIKE + 1
    places = F.explode(F.sequence(first, F.least(F.col("rows"), first + ALIKE - 1)))
    rows = units.withColumn("_place", places)
    copies = F.expr("total div rows + case when _place <= total % rows then 1 else 0 end").alias("copies")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies, (copies * F.col("size")).alias("taken"))


def _units(docs: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: int) -> DataFrame:
    """(doc_id, source, size, source_size, target, rows, total): equal rows together, and how often all of
    them are taken."""
    ship_code()
    units = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), _words(docs).alias("size"))
    units = materialize(units.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "units")
    sizes = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("documents"), F.count(F.lit(1)).alias("kinds")
    )
    goals = source_targets(sizes.drop("kinds"), weights, share, most).join(
        sizes.select(F.col("source").alias("_s"), "kinds"), F.col("source").eqNullSafe(F.col("_s"))
    ).drop("_s")
    goals = materialize(goals, "targets").withColumnRenamed("source", "_source")
    units = units.join(goals, units["source"].eqNullSafe(goals["_source"])).drop("_source", "documents")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = units.withColumn("_all", ratio * F.col("rows"))
    units = units.withColumn("whole", F.floor(F.col("_all") + _NEAR).cast("long")).withColumn("prob", F.greatest(F.lit(0.0), F.col("_all") - F.col("whole")))
    units = units.withColumn("prob", F.when(F.col("prob") < _NEAR, 0.0).otherwise(F.col("prob"))).withColumn("seed", F.lit(seed)).drop("_all")
    units = _in_chunks(units, F.col("kinds")).drop("kinds")
    flown = materialize(_round(units), "flown")
    done, open_ = [flown.filter("prob = 0 or prob = 1")], flown.filter("prob > 0 and prob < 1")
    while True:  # each round leaves a thousandth
        # rows per source: the groups before, twice at most
        counts = open_.groupBy("source").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("source", "_source")
        left = materialize(counts, "left")
        if not left.head(1):
            break
        again = open_.drop("last", "chunk").join(left, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        flown = materialize(_round(_in_chunks(again, F.col("_n")).drop("_n")), "flown")
        done.append(flown.filter("prob = 0 or prob = 1"))
        open_ = flown.filter("prob > 0 and prob < 1")
    rows = done[0]
    for part in done[1:]:
        rows = rows.unionByName(part)
    total = (F.col("whole") + F.col("prob").cast("long")).alias("total")
    return rows.select("doc_id", "source", "size", "source_size", "target", "rows", total)


def _in_chunks(units: DataFrame, count: Column) -> DataFrame:
    """Add the group in which a unit flies, and whether its source lands in it."""
    chunks = F.ceil(count / CHUNK)
    return units.withColumn("last", chunks <= 1).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size"), chunks).cast("long"))


def mix_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``docs`` with each document as often as the mix takes it.

    Documents of an id, source and size are told apart by nothing: the copies taken of all of them are
    dealt evenly among their rows. Every other row is found by these three.
    """
    taken = _units(docs, weights, share, most, 0).select("doc_id", "source", "size", F.col("total").alias("all"), "rows")
    taken = materialize(taken.filter("all > 0").withColumnsRenamed({"doc_id": "_id", "source": "_source", "size": "_size"}), "taken")
    plain, back = set_aside(docs, "doc_id", "source", "text")
    sized = plain.withColumn("_words", _words(plain))
    same = sized["doc_id"].cast("long").eqNullSafe(taken["_id"]) & sized["source"].cast("string").eqNullSafe(taken["_source"])
    # texts travel at every size alike; the planner would broadcast what a small table takes
    rows = sized.join(taken.hint("merge"), same & (sized["_words"] == taken["_size"]))
    if not taken.filter("rows > 1").head(1):
        return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("all").cast("int")))).select(*back)
    alone = rows.filter("rows = 1").withColumn("_rank", F.lit(1))
    order = Window.partitionBy("_id", "_source", "_size").orderBy("text")
    rows = alone.unionByName(rows.filter("rows > 1").withColumn("_rank", F.row_number().over(order)))
    each = F.expr("int(all div rows) + case when _rank <= all % rows then 1 else 0 end")
    rows = rows.withColumn("_each", each).filter("_each > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_each")))).select(*back)


def _words(docs: DataFrame) -> Column:
    return F.regexp_count(F.coalesce(docs["text"].cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _round(units: DataFrame) -> DataFrame:
    kept = ["doc_id", "source", "size", "rows", "source_size", "target", "whole", "prob", "seed", "last", "chunk"]
    units = units.select(*kept)
    return units.groupBy("source", "chunk").applyInPandas(_fly_group, units.schema)
