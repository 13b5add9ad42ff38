"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketry.llm import conversation_repair, license_index, mixing, multi_index, near_duplicates, packing, piece_table, pii, quality_model, quality_rules, sharding, suffix_dedup, url_filter
from basketry.llm.common import table
from basketry.llm.oracles import ORACLES  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the class of its near copies and the number of its links."""
    return near_duplicates.join(table(spark, folder, "documents"))


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: counts, a digest of the base spans, and all spans."""
    return pii.digest(table(spark, folder, "documents"))


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of each document a mix of 150 % takes, sources weighted 3, 1, 2."""
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The quality of every document by passages, learned from labels that are not held out."""
    docs = table(spark, folder, "documents")
    return quality_model.score(docs, quality_model.train(docs, table(spark, folder, "labels")))


def op5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest rows of ``embeddings`` for each row whose id is divisible by 20."""
    return multi_index.nearest(table(spark, folder, "embeddings"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens: one row per piece."""
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts of every document and the verdict by thresholds of its language and source."""
    judged = quality_rules.judge(table(spark, folder, "documents"), ["doc_id", "lang", "source"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of each document without strings of 200 bytes that occur twice or more."""
    return suffix_dedup.deduplicate(table(spark, folder, "documents"))


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    placed = sharding.shard_documents(table(spark, folder, "documents"), 24)
    return placed.selectExpr(
        "doc_id", "size", "text_crc32", "'bytes' as law", "shard", "slot", "cast(null as int) as grown_shard"
    )


def op10_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Every url of ``pages`` allowed or blocked, by rule or by the words of host and path."""
    return url_filter.judge(table(spark, folder, "pages"))


def op11_fim(spark: SparkSession, folder: str) -> DataFrame:
    """All documents arranged for filling in their middle: facts, digests of output and restored text."""
    return piece_table.digest(table(spark, folder, "documents"))


def op12_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    return license_index.scan(table(spark, folder, "documents")).drop("notices")


def op13_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, damaged by a rule, with its faults and its cheapest repair."""
    return conversation_repair.repair(table(spark, folder, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_jaccard": op1_jaccard,
    "op2_pii": op2_pii,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_neighbours": op5_neighbours,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_suffixes": op8_suffixes,
    "op9_sharding": op9_sharding,
    "op10_urls": op10_urls,
    "op11_fim": op11_fim,
    "op12_licenses": op12_licenses,
    "op13_conversations": op13_conversations,
}
