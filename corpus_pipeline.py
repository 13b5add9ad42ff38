"""A corpus from documents: quality rules, near copies, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again
as the next stage's documents. All but the last keep the columns of ``documents``. Beginning a stage
drops the intermediate tables of the stages before it in this application, whose results have been
written by then.

Null and empty texts, null ids, ties and repeated rows are rows like others at every stage, with the
results that the operators state; columns of any other name pass through all stages but the last; no
rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from basketry.llm import mixing, near_duplicates, packing, pii, quality_rules
from basketry.llm.common import materialize, table
from basketry.llm.queries import tokenizer_path
from basketry.session import drop_path, scratch_scope

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_written: dict[str, list[str]] = {}  # application -> folders of its earlier stages


def _stage(fn: Stage) -> Stage:
    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        folders = _written.setdefault(spark.sparkContext.applicationId, [])
        while folders:
            drop_path(spark, folders.pop())
        with scratch_scope(spark, f"pipeline-{fn.__name__}") as folder:
            folders.append(folder)
            return fn(spark, docs, sf_dir)

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the fences of their language and source let pass."""
    return quality_rules.judge(docs).filter("kept").select(*docs.columns)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_duplicates.keep_one(docs)


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redact(docs)


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once, or twice as equal rows."""
    return mixing.mix_rows(docs)


@_stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
    ("packing", sequences),
]

#: none: the near copies, the cube method and the tokenizer are beyond SQL; tests compare each stage
#: with a plain version instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
