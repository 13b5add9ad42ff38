"""Prompt text and service payloads, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketry.functions.arrays import _col
from basketry.functions.hashing import hash_bucket

# The prompt wording and the starter items are part of the expected output.
SYSTEM_PROMPT = (
    "You are an AI assistant functioning as a recommendation system for an ecommerce website. "
    "Be specific and limit your answers to the requested format."
)
SYSTEM_PROMPT_NO_EXPLANATION = SYSTEM_PROMPT + " Do not provide an explanation"
SHORT_ENDING = " Express as a python list 'next_item' [/INST]"
LONG_ENDING = " Express as a python list 'next_item' with an inline description[/INST]"
GENERAL_STARTERS = (
    "Smartphone", "Laptop", "Headphones", "T-shirt", "Jeans",
    "Running Shoes", "Blender", "Novel", "Board Game", "Wristwatch",
)
FIXED_ITEMS = ("pen", "pencil", "glue stick")
GROCERY_STARTERS = ("chicken", "eggs", "olive oil", "pastrami", "spinach", "lettuce", "quinoa")


def spoken_list(items: str | Column) -> Column:
    """``a`` / ``a, and b`` / ``a, b, and c``; null for an empty list."""
    items = _col(items)
    last = F.try_element_at(items, F.lit(-1))
    lead = F.concat_ws(", ", F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0))))
    return F.when(F.size(items) > 1, F.concat(lead, F.lit(", and "), last)).when(F.size(items) == 1, last)


def purchase_prompt(
    items: str | Column, system_prompt: str = SYSTEM_PROMPT, ending: str = LONG_ENDING
) -> Column:
    """The instruction text that asks what a user buys next; null for an empty history."""
    return F.concat(
        F.lit(f"[INST] <<SYS>>\n{system_prompt}\n<</SYS>>\nA user bought "),
        spoken_list(items),
        F.lit(" in that order. What single item would he/she be likely to purchase next?" + ending),
    )


def is_cold(history: str | Column) -> Column:
    return F.coalesce(F.size(_col(history)), F.lit(0)) <= 0


def with_starter(
    history: str | Column, user: str | Column, starters: Sequence[str] = GENERAL_STARTERS, seed: int = 0
) -> Column:
    """The history, or one starter item picked by a hash of user and seed when it is empty."""
    pick = F.element_at(
        F.array(*[F.lit(s) for s in starters]),
        (hash_bucket(_col(user), F.lit(seed), buckets=len(starters)) + 1).cast("int"),
    )
    return F.when(is_cold(history), F.array(pick)).otherwise(_col(history))


def generation_request(prompt: str | Column, temperature: float = 0.0) -> Column:
    """JSON body of a generation call."""
    return F.to_json(F.struct(_col(prompt).alias("prompt"), F.lit(temperature).alias("temperature")))


def generated_text(response: str | Column) -> Column:
    """The first candidate's text of a generation response."""
    return F.get_json_object(_col(response), "$.candidates[0].text")


def search_response_column(response: str | Column, position: int = -2) -> Column:
    """One field of each row of a search response; -2 is the last requested column, -1 the score."""
    rows = F.from_json(F.get_json_object(_col(response), "$.result.data_array"), "array<array<string>>")
    return F.transform(rows, lambda row: F.element_at(row, position))


def split_payload(texts: str | Column) -> Column:
    """JSON body of a batch scoring call: an array of texts in split orientation."""
    texts = _col(texts)
    index = F.when(F.size(texts) > 0, F.sequence(F.lit(0), F.size(texts) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    frame = F.struct(
        index.alias("index"),
        F.array(F.lit(0)).alias("columns"),
        F.transform(texts, lambda t: F.array(t)).alias("data"),
    )
    return F.to_json(F.struct(frame.alias("dataframe_split")))


def safe_name(name: str | Column) -> Column:
    """A model name without dots."""
    return F.replace(_col(name), F.lit("."), F.lit("_"))
