"""What a user buys next: a caller's model in batches, or a model learned from the orders.

A generator has ``state(history)``, a column that determines its answer, and
``generate(states)``, which adds the column ``generated`` to rows ``(state)``. ``row_wise`` tells that
it answers each row by itself, so that states may repeat and other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from basketry.functions.arrays import append_item
from basketry.functions.prompts import LONG_ENDING, SYSTEM_PROMPT, generated_text, generation_request, purchase_prompt
from basketry.operators.transitions import most_bought_next, top_transitions
from basketry.session import materialize

# () -> (list of prompts -> list of responses); the outer call opens the client, once per task
ResponderFactory = Callable[[], Callable[[Sequence[str]], Sequence[str]]]


def generate(
    df: DataFrame, prompt_col: str, responder: ResponderFactory, out: str = "response", batch_size: int = 64
) -> DataFrame:
    """Add the responder's answer to each prompt; a null prompt gets a null answer."""
    schema = StructType([f for f in df.schema.fields if f.name != out] + [StructField(out, StringType())])
    kept = [f.name for f in schema.fields if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        respond = None
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                prompts = part.column(prompt_col).to_pylist()
                present = [p for p in prompts if p is not None]
                if respond is None and present:
                    respond = responder()
                answers = iter(respond(present)) if present else iter(())
                column = [None if p is None else next(answers) for p in prompts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept] + [pa.array(column, pa.string())], names=[*kept, out]
                )

    return df.select(*kept).mapInArrow(run, schema)


@dataclass
class PromptGenerator:
    """Prompt -> responder -> text. ``json_response`` takes the first candidate out of a JSON answer."""

    responder: ResponderFactory
    system_prompt: str = SYSTEM_PROMPT
    ending: str = LONG_ENDING
    json_response: bool = True
    temperature: float | None = None
    row_wise = True

    def state(self, history: Column) -> Column:
        return history

    def advance(self, state: Column, item: Column) -> Column:
        return append_item(state, item)

    def generate(self, states: DataFrame) -> DataFrame:
        prompt = purchase_prompt("state", self.system_prompt, self.ending)
        if self.temperature is not None:  # the responder then gets the whole request, as JSON
            prompt = F.when(prompt.isNotNull(), generation_request(prompt, self.temperature))
        prompts = states.withColumn("prompt", prompt)
        answered = generate(prompts, "prompt", self.responder)
        text = generated_text("response") if self.json_response else F.col("response")
        return answered.withColumn("generated", text).drop("prompt", "response")


@dataclass
class TransitionGenerator:
    """The product most often bought next after the last one.

    ``best`` is ``(product_id, next_product)``, one row per product; ``fallback`` one row for products
    without a successor.
    """

    best: DataFrame
    fallback: DataFrame
    row_wise = True

    @classmethod
    def fit(cls, counts: DataFrame, keep: bool = True) -> TransitionGenerator:
        """``counts`` from ``transition_counts``. ``keep`` writes the model, which every step reads."""
        if keep:
            counts = materialize(counts, "transitions")
        best = top_transitions(counts, 1).select("product_id", "next_product")
        if keep:
            best = materialize(best, "best-next")
        return cls(best, most_bought_next(counts))

    def state(self, history: Column) -> Column:
        return F.try_element_at(history, F.lit(-1))

    def advance(self, state: Column, item: Column) -> Column:
        return item

    def generate(self, states: DataFrame) -> DataFrame:
        best = self.best.select(F.col("product_id").alias("state"), "next_product")
        return (
            states.join(best, "state", "left")
            .withColumn("generated", F.coalesce("next_product", self.fallback.scalar()))
            .drop("next_product")
        )


@dataclass
class NeighbourGenerator:
    """The product bought most often together with the products of the whole history.

    ``counts`` is ``(product_id, neighbour, n)``; every neighbour of every history item has its say.
    """

    counts: DataFrame
    fallback: DataFrame
    row_wise = False

    @classmethod
    def fit(cls, counts: DataFrame, keep: bool = True) -> NeighbourGenerator:
        """``counts`` from ``order_neighbours`` or ``cart_neighbours``."""
        if keep:
            counts = materialize(counts, "neighbours")
        totals = counts.groupBy("product_id").agg(F.sum("n").alias("n"))
        fallback = totals.orderBy(F.desc("n"), "product_id").limit(1).select(
            F.col("product_id").alias("fallback")
        )
        return cls(counts, fallback)

    def state(self, history: Column) -> Column:
        # a set of items: order and repeats do not change the answer
        return F.array_sort(F.array_distinct(history))

    def advance(self, state: Column, item: Column) -> Column:
        return F.array_sort(F.array_union(state, F.array(item)))

    def generate(self, states: DataFrame) -> DataFrame:
        items = states.select("state", F.explode("state").alias("product_id"))
        offers = items.join(self.counts, "product_id").select("state", F.col("neighbour").alias("product"), "n")
        scores = offers.groupBy("state", "product").agg(F.sum("n").alias("n"))
        best_first = Window.partitionBy("state").orderBy(F.desc("n"), "product")
        best = (
            scores.withColumn("r", F.row_number().over(best_first))
            .filter("r = 1")
            .select("state", F.col("product").alias("generated"))
        )
        return states.join(best, "state", "left").withColumn(
            "generated", F.coalesce("generated", self.fallback.scalar())
        )
