"""Recommendations for all users in one job: one shot, and step by step."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.prompts import with_starter
from basketry.operators.index import TextIndex
from basketry.operators.skew import splittable
from basketry.session import materialize


@dataclass
class DirectItem:
    """The generator names the catalogue item itself; nothing to search."""

    lazy = True

    def retrieve(self, generated: DataFrame, k: int) -> DataFrame:
        if k != 1:
            raise ValueError("a generator that names one item gives one recommendation")
        return generated.withColumn("rank", F.lit(1)).withColumnRenamed("generated", "item")


@dataclass
class CatalogueSearch:
    """The generated text, used whole, is the query; the ``k`` nearest catalogue rows are the answer.

    ``item`` picks the returned column, ``id`` or ``text``. With ``names`` (product_id, product_name)
    the generator gives product ids, of which the names are searched.
    """

    index: TextIndex
    item: str = "id"
    names: DataFrame | None = None
    lazy = False

    def retrieve(self, generated: DataFrame, k: int) -> DataFrame:
        # a model is asked once: its texts are both searched and joined to the results
        generated, text = materialize(generated, "generated"), "generated"
        if self.names is not None:
            names = self.names.select(F.col("product_id").alias("generated"), F.col("product_name").alias("_text"))
            generated, text = generated.join(names, "generated", "left"), "_text"
        # each distinct text is searched once
        texts = generated.select(F.col(text).alias("query_id")).filter("query_id is not null").distinct()
        hits = self.index.search(
            texts.withColumn("text", F.col("query_id")), k, columns=("text",) if self.item == "text" else ()
        )
        found = hits.select(F.col("query_id").alias(text), "rank", F.col(self.item).alias("item"), "score")
        # many histories may lead to one text
        out = generated.join(splittable(found, text, "rank"), text, "left")
        return out.drop("_text", "generated")


def _states(histories: DataFrame, generator, user: str, starters, seed: int) -> DataFrame:
    history = F.col("history")
    if starters is not None:
        history = with_starter("history", user, starters, seed)
    return histories.select(user, generator.state(history).alias("start"))


def recommend(
    histories: DataFrame,
    generator,
    retriever,
    k: int = 1,
    user: str = "user_id",
    starters: Sequence[str] | None = None,
    seed: int = 0,
) -> DataFrame:
    """``(user, rank, item)`` for rows ``(user, history)``.

    The generator sees each distinct state once: users who would get the same answer share it. A user
    whose generated text finds nothing keeps one row, without rank and item.
    """
    placed = _states(histories, generator, user, starters, seed)
    states = placed.select(F.col("start").alias("state")).distinct()
    answers = retriever.retrieve(generator.generate(states), k)
    return placed.join(answers, F.col("start").eqNullSafe(F.col("state")), "left").drop("start", "state")


def recommend_sequence(
    histories: DataFrame,
    generator,
    retriever,
    steps: int = 5,
    user: str = "user_id",
    starters: Sequence[str] | None = None,
    seed: int = 0,
) -> DataFrame:
    """``(user, recommendations)``: ``steps`` items, each chosen with the ones before in the history.

    The steps run over the distinct start states, not over the users, who are joined at the end. When
    a step reads the walk more than once, the walk is written first, so that the plan does not double.
    """
    placed = _states(histories, generator, user, starters, seed)
    walk = placed.select("start").distinct().withColumn("state", F.col("start"))
    taken = []
    for step in range(steps):
        if generator.row_wise and retriever.lazy:
            walk = retriever.retrieve(generator.generate(walk), 1).drop("rank", "score")
        else:
            states = walk.select("state").distinct()
            answers = retriever.retrieve(generator.generate(states), 1).select("state", "item")
            walk = walk.join(
                answers.withColumnRenamed("state", "_s"), F.col("state").eqNullSafe(F.col("_s")), "left"
            ).drop("_s")
        taken.append(f"_item{step}")
        walk = walk.withColumnRenamed("item", taken[-1])
        moved = generator.advance(F.col("state"), F.col(taken[-1]))
        # a step that found nothing leaves the history as it is
        walk = walk.withColumn("state", F.when(F.col(taken[-1]).isNull(), F.col("state")).otherwise(moved))
        if not (generator.row_wise and retriever.lazy):
            walk = materialize(walk, "walk")
    # without nulls, in step order
    paths = walk.select(
        F.col("start").alias("_start"), F.array_compact(F.array(*taken)).alias("recommendations")
    )
    return placed.join(paths, F.col("start").eqNullSafe(F.col("_start"))).select(user, "recommendations")


def extended_history(histories: DataFrame, recommended: DataFrame, user: str = "user_id") -> DataFrame:
    """The history with the recommended items behind it."""
    return histories.join(recommended, user).withColumn("history", F.concat("history", "recommendations"))
