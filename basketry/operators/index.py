"""Catalogue index: build, search by vector or text, keep in step with a change log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.embed import (
    Model,
    embed,
    frequencies_of_counts,
    term_counts,
    tfidf_entries,
    tfidf_weights,
)
from basketry.operators.postings import top_k, with_blocks
from basketry.operators.search import DenseScore, top_k_join
from basketry.session import materialize
from basketry.sources.sinks import create_table, overwrite_table


class DuplicateKeyError(ValueError):
    pass


def require_unique(df: DataFrame, key: str) -> None:
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key).take(3)
    if repeated:
        raise DuplicateKeyError(f"{key} is not unique, e.g. {[row[0] for row in repeated]}")


def with_norm(df: DataFrame, vector: str = "embedding") -> DataFrame:
    square = F.aggregate(
        vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    return df.withColumn("norm", F.sqrt(square))


def build_index(
    df: DataFrame, key: str, text_col: str, model: Model, check_unique: bool = True
) -> DataFrame:
    """``(id, text, embedding, norm)`` of the rows that have a text."""
    if check_unique:
        require_unique(df, key)
    rows = df.filter(F.col(text_col).isNotNull()).select(
        F.col(key).alias("id"), F.col(text_col).alias("text")
    )
    return with_norm(embed(rows, "text", model, key="id"))


def index_of_vectors(df: DataFrame, key: str, vector: str, *columns: str) -> DataFrame:
    """The same index shape from vectors that exist already."""
    rows = df.filter(F.col(vector).isNotNull()).select(
        F.col(key).alias("id"), *columns, F.col(vector).alias("embedding")
    )
    return with_norm(rows)


def search_vectors(
    queries: DataFrame, index: DataFrame, k: int, columns: tuple[str, ...] = (), **options
) -> DataFrame:
    """Exact top-k by cosine; ``queries`` is ``(query_id, embedding, norm)``."""
    return top_k_join(queries, index, k, DenseScore(), payload=tuple(columns), **options)


def search_text_with_model(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    model: Model,
    text_col: str = "text",
    columns: tuple[str, ...] = ("text",),
    **options,
) -> DataFrame:
    """Exact top-k for text queries, embedded with the model that built the index."""
    vectors = with_norm(embed(queries.select("query_id", text_col), text_col, model, key="query_id"))
    return search_vectors(vectors, index, k, columns, **options)


def create_index(
    spark: SparkSession,
    source_table: str,
    index_table: str,
    primary_key: str,
    index_column: str,
    model: Model,
    path: str | None = None,
) -> None:
    """Embed a column of a table and save the index under a new name."""
    create_table(build_index(spark.table(source_table), primary_key, index_column, model), index_table, path=path)


def similarity_search(
    spark: SparkSession,
    index_table: str,
    query_text: str,
    model: Model,
    columns: tuple[str, ...] = ("id", "text"),
    num_results: int = 5,
) -> DataFrame:
    """The rows of a saved index nearest to one text: the requested columns and the score, best first."""
    query = spark.createDataFrame([(0, query_text)], "query_id int, text string")
    carried = tuple(c for c in columns if c != "id")
    hits = search_text_with_model(query, spark.table(index_table), num_results, model, columns=carried)
    return hits.orderBy("rank").select(*columns, "score")


@dataclass
class TextIndex:
    """TF-IDF index of a catalogue: ``postings`` (term, block, id, weight), ``idf`` (term, df, idf) and the texts."""

    postings: DataFrame
    idf: DataFrame
    catalogue: DataFrame
    kept: bool = True

    @classmethod
    def build(
        cls, docs: DataFrame, key: str, text_col: str, keep: bool = False, check_unique: bool = False
    ) -> TextIndex:
        """``keep`` writes the postings, for an index that is searched more than once."""
        if check_unique:
            require_unique(docs, key)
        catalogue = docs.filter(F.col(text_col).isNotNull()).select(
            F.col(key).alias("id"), F.col(text_col).alias("text")
        )
        # texts are taken apart once
        counts = materialize(term_counts(catalogue, "id", "text"), "term-counts")
        idf = frequencies_of_counts(counts, catalogue.count())
        postings = with_blocks(tfidf_entries(counts, idf, "id"))
        return cls(materialize(postings, "postings") if keep else postings, idf, catalogue, keep)

    def save(self, name: str) -> None:
        """Save under ``name_postings``, ``name_terms`` and ``name_catalogue``, replacing what is there."""
        overwrite_table(self.postings, f"{name}_postings")
        overwrite_table(self.idf, f"{name}_terms")
        overwrite_table(self.catalogue, f"{name}_catalogue")

    @classmethod
    def load(cls, spark: SparkSession, name: str) -> TextIndex:
        return cls(*(spark.table(f"{name}_{part}") for part in ("postings", "terms", "catalogue")))

    def search(
        self, queries: DataFrame, k: int, text_col: str = "text", columns: tuple[str, ...] = (), **options
    ) -> DataFrame:
        """Top-k catalogue rows for ``queries`` ``(query_id, text)``; only rows that share a term."""
        weights = tfidf_weights(term_counts(queries, "query_id", text_col), self.idf, "query_id")
        hits = top_k(weights, self.postings, k, self.kept, **options)
        if columns:
            # k rows per query, written so that the planner knows how few they are
            hits = materialize(hits, "hits").join(self.catalogue.select("id", *columns), "id")
            hits = hits.select("query_id", "rank", "id", *columns, "score")
        return hits


def change_order(version: str = "version", op: str = "op", text: str = "text") -> Column:
    """What decides between two changes of one id: version, at equal versions a delete, then the text.

    The order of arrival does not, so repeated or late changes do no harm.
    """
    return F.struct(
        F.col(version).alias("version"),
        (F.col(op) == "delete").alias("is_delete"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


def latest_changes(changes: DataFrame) -> DataFrame:
    """The change that holds for each id, as ``(id, text, version, op, ...)``."""
    others = [c for c in changes.columns if c != "id"]
    winner = F.max_by(F.struct(*others), change_order())
    return changes.groupBy("id").agg(winner.alias("c")).select("id", "c.*")


def live_rows(state: DataFrame) -> DataFrame:
    """The rows that are not deleted, of changes reduced to one per id."""
    return state.filter((F.col("op") != "delete") & F.col("text").isNotNull()).drop("op")


def embed_changes(changes: DataFrame, model: Model) -> DataFrame:
    """Changes with the vectors of their texts; a delete has none."""
    return with_norm(embed(changes.select("id", "text", "version", "op"), "text", model, key="id"))


def sync_index(state: DataFrame, changes: DataFrame, model: Model) -> DataFrame:
    """Apply changes to an index state ``(id, text, version, op, embedding, norm)``.

    Only changes that win over the indexed row are embedded. Deletes stay in the state, without a
    vector, so that an older change that arrives later cannot bring the row back; ``live_rows`` is
    what a search reads.
    """
    latest = latest_changes(changes.select("id", "text", "version", "op"))
    known = state.select("id", change_order().alias("known"))
    newer = (
        latest.join(known, "id", "left")
        .filter(F.col("known").isNull() | (change_order() > F.col("known")))
        .drop("known")
    )
    # both joined against and embedded: the change log is read once
    newer = materialize(newer, "newer")
    kept = state.join(newer.select("id"), "id", "left_anti")
    return kept.unionByName(embed_changes(newer, model))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def write_state(state: DataFrame, path: str, buckets: int) -> None:
    """Save an index state in folders by a hash of the id, for ``merge_changes``."""
    placed = state.withColumn("bucket", _bucket(buckets))
    placed.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merge_changes(spark: SparkSession, path: str, changes: DataFrame, model: Model, buckets: int) -> int:
    """Apply changes to a state saved by ``write_state`` with as many buckets; returns how many it rewrote.

    Only buckets that hold a change are read and written again; the files of the others stay as they
    are. The merged rows are written aside first, so that a failure leaves the old state whole.
    """
    latest = materialize(latest_changes(changes.select("id", "text", "version", "op")), "latest")
    touched = [row[0] for row in latest.select(_bucket(buckets).alias("b")).distinct().collect()]  # buckets at most
    if not touched:
        return 0
    state = read_state(spark, path).filter(F.col("bucket").isin(touched)).drop("bucket")
    merged = materialize(sync_index(state, latest, model).withColumn("bucket", _bucket(buckets)), "merged")
    writer = merged.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    return len(touched)
