"""What a user buys next, learned from whole histories: the longest seen run of last items decides.

The model counts what followed each run of one to ``length`` items. A history is answered from its
longest run of last items that was seen at all, and from the overall counts where none was. Temperature 0 takes
the most frequent follower; a higher one draws, with probabilities proportional to ``n ** (1 / temperature)``,
by adding Gumbel noise to the logarithms. The noise is a hash of seed, state and follower, so that a
rerun draws the same and any engine with md5 can repeat it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.arrays import append_item, last_items
from basketry.functions.hashing import hash_bucket
from basketry.operators.skew import OrderedGroups
from basketry.operators.transitions import most_bought_next
from basketry.session import materialize

LENGTH = 3
HASHED = 100_000  # runs from which on counts are looked up by hash; fewer may be sent to every task, as the planner sees fit


def follower_counts(
    purchases: DataFrame,
    order: Sequence[str],
    buckets: Sequence[Column],
    length: int = LENGTH,
    user: str = "user_id",
    **options,
) -> DataFrame:
    """``(context, next_product, n)``: how often ``next_product`` came right after the items of ``context``.

    ``order`` and ``buckets`` are those of ``OrderedGroups``, so that a user of any size is walked in parts.
    """
    names = ["product_id", *[f"_back{i}" for i in range(1, length)]]
    groups = OrderedGroups(purchases, [user], order, buckets, **options)
    rows = groups.neighbour("product_id", "next_product", 1).result()
    for before, name in zip(names, names[1:]):
        # the rows are the same, so large users are looked for once
        rows = OrderedGroups(rows, [user], order, buckets, hot=groups.hot).neighbour(before, name, -1).result()
    # runs are counted as columns, which are shorter than lists and faster to group
    lengths = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(m)) for m, n in enumerate(names, 1)]))
    ended = rows.filter(F.col("next_product").isNotNull()).select("next_product", *names, F.explode(lengths).alias("_m"))
    items = [F.when(F.col("_m") >= m, F.col(n)).alias(n) for m, n in enumerate(names, 1)]
    pairs = ended.select("_m", *items, "next_product").groupBy("_m", *names, "next_product").agg(F.count(F.lit(1)).alias("n"))
    run = F.slice(F.array(*reversed(names)), length + 1 - F.col("_m"), F.col("_m"))
    return pairs.select(run.alias("context"), "next_product", "n")


@dataclass
class BackoffGenerator:
    """``counts`` as from ``follower_counts``; ``fallback`` is one row.

    With ``names``, ``(code, name)`` both distinct, in the same order and not negative, the counts hold codes, which are
    short; histories and answers hold names.
    """

    counts: DataFrame
    fallback: DataFrame
    names: DataFrame | None = None
    length: int = LENGTH
    temperature: float = 0.0
    seed: int = 0
    row_wise = False

    @classmethod
    def fit(
        cls, counts: DataFrame, length: int = LENGTH, temperature: float = 0.0, seed: int = 0, names: DataFrame | None = None
    ) -> BackoffGenerator:
        """The model is written, as every step reads it."""
        counts = materialize(counts, "followers")
        usual = most_bought_next(counts.filter(F.size("context") == 1).select("next_product", "n"))
        if names is not None:
            usual = usual.join(names, F.col("fallback") == F.col("code")).select(F.col("name").alias("fallback"))
        return cls(counts, materialize(usual, "usual"), names, length, temperature, seed)

    def at(self, temperature: float, seed: int = 0) -> BackoffGenerator:
        """The same model with another temperature."""
        return replace(self, temperature=temperature, seed=seed)

    def state(self, history: Column) -> Column:
        return last_items(history, self.length)

    def advance(self, state: Column, item: Column) -> Column:
        return last_items(append_item(state, item), self.length)

    def _runs(self, states: DataFrame) -> DataFrame:
        """``(_id, _m, context)``: the runs of last items, as they stand in the counts."""
        states = states.filter(F.size("state") > 0).select("_id", "state")
        if self.names is None:
            coded = states.withColumnRenamed("state", "_items")
        else:
            items = states.select("_id", F.posexplode("state").alias("_at", "name")).join(self.names, "name", "left")
            code = F.coalesce("code", F.when(F.col("name").isNotNull(), F.lit(-1)))  # a name that was never bought
            listed = F.array_sort(F.collect_list(F.struct("_at", code.alias("code"))))
            coded = items.groupBy("_id").agg(listed.alias("_l")).select("_id", F.col("_l.code").alias("_items"))
        lengths = F.explode(F.sequence(F.lit(1), F.least(F.size("_items"), F.lit(self.length))))
        runs = coded.select("_id", "_items", lengths.alias("_m"))
        return runs.select("_id", "_m", F.slice("_items", -F.col("_m"), F.col("_m")).alias("context"))

    def _asked(self, runs: DataFrame) -> DataFrame:
        """The counts of the runs that are asked for. Counts, which are many, are moved once and not sorted: the runs,
        each once, are looked up by hash."""
        asked = runs.select("context").distinct()
        if runs.count() > HASHED:
            asked = asked.hint("shuffle_hash")
        return self.counts.join(asked, "context", "left_semi")

    def _named(self, rows: DataFrame, code: str) -> DataFrame:
        """``rows`` with names in place of the column of codes."""
        if self.names is None:
            return rows
        names = self.names.select(F.col("code").alias("_code"), F.col("name").alias("_name"))
        named = rows.join(names, F.col(code) == F.col("_code"))
        return named.withColumn(code, F.col("_name")).drop("_code", "_name")

    def generate(self, states: DataFrame) -> DataFrame:
        """Add ``generated`` to distinct ``states``."""
        # states are lists of names: what is grouped and joined by state is by a number that is written with it
        states = materialize(states.withColumn("_id", F.monotonically_increasing_id()), "states")
        runs = materialize(self._runs(states), "runs")
        counts = materialize(self._asked(runs), "asked-followers")
        if self.temperature > 0:
            seen = runs.join(counts.select("context").distinct(), "context")
            longest = seen.groupBy("_id").agg(F.max_by("context", "_m").alias("context"))
            words = states.select("_id", F.array_join(F.col("state").cast("array<string>"), "|").alias("_words"))
            longest = materialize(longest.join(words, "_id"), "longest-runs")
            followers = counts.join(longest.select("context").distinct(), "context", "left_semi")
            followers = longest.join(self._named(followers, "next_product"), "context")
            uniform = (hash_bucket(F.lit(self.seed), "_words", F.col("next_product"), buckets=1 << 32) + 0.5) / float(1 << 32)
            score = F.log("n") / self.temperature - F.log(-F.log(uniform))
            drawn = F.min_by("next_product", F.struct(-score, F.col("next_product")))
            answers = followers.groupBy("_id").agg(drawn.alias("generated"))
        else:
            first = F.min_by("next_product", F.struct(-F.col("n"), F.col("next_product")))
            seen = runs.join(counts.groupBy("context").agg(first.alias("best")), "context")
            answers = self._named(seen.groupBy("_id").agg(F.max_by("best", "_m").alias("generated")), "generated")
        found = states.join(answers, "_id", "left").drop("_id")
        return found.withColumn("generated", F.coalesce("generated", self.fallback.scalar()))
