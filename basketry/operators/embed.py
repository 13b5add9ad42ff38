"""Text to vectors: a caller's model in batches, or hashed terms and TF-IDF from built-in functions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from basketry.functions.hashing import hash_bucket
from basketry.functions.text import tokens
from basketry.session import materialize, spread

# The most frequent terms, up to so many, are sent to every task; only rows of other terms are shuffled by term.
FREQUENT = 100_000

# () -> (list of texts -> list of vectors); the outer call loads the model, once per task
ModelFactory = Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]]


def embed(
    df: DataFrame,
    text_col: str,
    model: Model,
    out: str = "embedding",
    key: str | None = None,
    batch_size: int = 256,
) -> DataFrame:
    """Add the model's vector of ``text_col`` to each row; a null text gets a null vector.

    ``HashedTerms`` need a ``key`` that tells the rows apart.
    """
    if isinstance(model, HashedTerms):
        return model.embed(df, text_col, key, out)
    schema = StructType(
        [f for f in df.schema.fields if f.name != out] + [StructField(out, ArrayType(FloatType()))]
    )
    kept = [f.name for f in schema.fields if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                texts = part.column(text_col)
                present = texts.drop_null().to_pylist()
                if encode is None and present:
                    encode = model()
                vectors = [np.asarray(v, dtype=np.float32) for v in encode(present)] if present else []
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept] + [_vector_column(vectors, texts.is_valid().to_numpy(zero_copy_only=False))],
                    names=[*kept, out],
                )

    return df.select(*kept).mapInArrow(run, schema)


def _vector_column(vectors: list[np.ndarray], valid: np.ndarray) -> pa.ListArray:
    """Vectors of the valid rows as a list column, null elsewhere."""
    lengths = np.zeros(len(valid), dtype=np.int64)
    lengths[valid] = [len(v) for v in vectors]
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), mask=np.append(~valid, False))
    flat = np.concatenate(vectors) if vectors else np.zeros(0, dtype=np.float32)
    return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float32()))


@dataclass
class HashedTerms:
    """Dense vectors of fixed length from terms: each term adds its TF-IDF weight, with a sign, to one place.

    Place and sign come from the md5 of the term, so that any engine with md5 can repeat them. ``idf`` is
    ``(term, idf)`` of the texts it was fitted on; other terms get ``unseen``, the IDF of a term in none.
    """

    idf: DataFrame
    unseen: float
    dimensions: int = 64

    @classmethod
    def fit(cls, docs: DataFrame, text_col: str, dimensions: int = 64) -> HashedTerms:
        idf, unseen = _frequencies(docs, text_col)
        return cls(idf, unseen, dimensions)

    def place(self, term: str = "term") -> Column:
        return hash_bucket(term, buckets=self.dimensions).cast("int")

    def sign(self, term: str = "term") -> Column:
        return F.when(F.substring(F.md5(F.col(term)), 9, 1) >= "8", 1.0).otherwise(-1.0)

    def embed(self, df: DataFrame, text_col: str, key: str | None, out: str = "embedding") -> DataFrame:
        """``df`` with the vectors; the zero vector for a text without terms. ``key`` must be unique."""
        if key is None:
            raise ValueError("hashed terms are put together by a key")
        df = df.drop(out)
        # the texts are moved once: what joins them below is partitioned by the key alike
        rows = df.repartition(key)
        terms = rows.select(key, F.explode(tokens(text_col)).alias("term"))
        common, rare = frequent_terms(self.idf)
        weight = F.coalesce("idf", F.lit(self.unseen)) * self.sign()
        known = common.select("term", weight.alias("_w"), self.place().alias("_place"))
        if rare is None:  # terms that it was not fitted on
            unseen = terms.join(F.broadcast(common), "term", "left")
            parts = [unseen.select(key, self.place().alias("_place"), weight.alias("_w"))]
        else:
            others = terms.join(F.broadcast(common.select("term")), "term", "left_anti")
            others = others.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
            others = others.join(rare.select("term", "idf"), "term", "left")
            parts = [
                terms.join(F.broadcast(known), "term").select(key, "_place", "_w"),
                others.select(key, self.place().alias("_place"), (F.col("tf") * weight).alias("_w")),
            ]
        found = []
        for part in parts:
            sums = part.groupBy(key, "_place").agg(F.sum("_w").alias("_w"))
            found.append(f"_places{len(found)}")
            filled = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_place", "_w"))).alias(found[-1]))
            rows = rows.join(filled, key, "left")
        places = F.sequence(F.lit(0), F.lit(self.dimensions - 1))
        at = lambda i: [F.coalesce(F.try_element_at(name, i), F.lit(0.0)) for name in found]
        vector = F.transform(places, lambda i: sum(at(i)[1:], at(i)[0]).cast("float"))
        return rows.withColumn(out, F.when(F.col(text_col).isNotNull(), vector)).drop(*found)


#: what turns texts into vectors
Model = ModelFactory | HashedTerms


def term_counts(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """``(key, term, tf)``.

    The texts are shuffled once by key; the count by key and term, and what is grouped by key after
    it, then need no shuffle of their own.
    """
    return (
        docs.select(key, text_col)
        .repartition(key)
        .select(key, F.explode(tokens(text_col)).alias("term"))
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def inverse_document_frequency(docs: DataFrame, text_col: str) -> DataFrame:
    """``(term, df, idf)`` with ``idf = ln((n + 1) / (df + 1)) + 1`` over the non-null texts."""
    return _frequencies(docs, text_col)[0]


def _frequencies(docs: DataFrame, text_col: str) -> tuple[DataFrame, float]:
    """The IDF of all terms, and that of a term in no text.

    The texts are read once: the empty term, which no text has, is counted in each of them and so
    gives ``n``. The counts, one row per term, are written, as the index and its queries both read them.
    """
    texts = spread(docs.filter(F.col(text_col).isNotNull()).select(text_col))
    terms = F.array_append(F.array_distinct(tokens(text_col)), F.lit(""))
    frequency = materialize(
        texts.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")),
        "document-frequency",
    )
    everything = frequency.filter("term = ''").first()
    n = everything["df"] if everything else 0
    return _with_idf(frequency.filter("term <> ''"), n), math.log(n + 1.0) + 1


def frequent_terms(idf: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``idf``, rows ``(term, df, idf)``, as the terms of the highest frequencies, at most ``FREQUENT``, and the others,
    None if there are none.

    The frequencies are counted by powers of two, one row each.
    """
    power = F.floor(F.log2("df")).cast("int").alias("power")
    counts = idf.groupBy(power).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("power")).collect()
    held, least = 0, None
    for row in counts:
        held += row["n"]
        if held > FREQUENT:
            break
        least = row["power"]
    else:
        return idf, None
    common = F.lit(False) if least is None else F.col("df") >= 2**least
    return idf.filter(common), idf.filter(~common)


def tfidf_weights(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """``(key, term, weight, df)`` before normalisation; terms the index does not know are left out."""
    return counts.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("weight"), "df")


def tfidf_vectors(docs: DataFrame, key: str, text_col: str, idf: DataFrame) -> DataFrame:
    """``(key, terms, weights, norm)``, one sparse vector per text that has a known term."""
    counts = term_counts(docs, key, text_col)
    common, rare = frequent_terms(idf)

    def collected(weights: DataFrame) -> DataFrame:
        squares = F.sum(F.col("weight") * F.col("weight")).alias("_squares")
        return weights.groupBy(key).agg(F.collect_list(F.struct("term", "weight")).alias("v"), squares)

    if rare is None:
        vectors = collected(tfidf_weights(counts, F.broadcast(common), key))
    else:
        # the rows of frequent terms stay where their texts are; the others come back to them
        named = counts.filter(F.col(key).isNotNull())
        others = named.join(F.broadcast(common.select("term")), "term", "left_anti")
        others = collected(tfidf_weights(others, rare, key)).withColumnsRenamed({"v": "_v", "_squares": "_more"})
        vectors = collected(tfidf_weights(named, F.broadcast(common), key)).join(others, key, "full")
        none = F.array().cast(vectors.schema["v"].dataType)
        vectors = vectors.select(
            key,
            F.concat(F.coalesce("v", none), F.coalesce("_v", none)).alias("v"),
            (F.coalesce("_squares", F.lit(0.0)) + F.coalesce("_more", F.lit(0.0))).alias("_squares"),
        )
        # rows without a key are one text
        vectors = vectors.unionByName(collected(tfidf_weights(counts.filter(F.col(key).isNull()), idf, key)))
    return vectors.select(key, F.col("v.term").alias("terms"), F.col("v.weight").alias("weights"), F.sqrt("_squares").alias("norm"))


def tfidf_entries(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """``(key, term, weight)`` of the normalised vectors, one row per entry, from written ``counts``.

    Lengths are added up before they are shuffled: the entries of a text lie together.
    """
    weights = tfidf_weights(counts, idf, key).drop("df")
    norms = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
    return weights.join(norms, key).select(key, "term", (F.col("weight") / F.col("_norm")).alias("weight"))


def frequencies_of_counts(counts: DataFrame, texts: int) -> DataFrame:
    """``(term, df, idf)`` from written ``counts`` of so many texts, written."""
    frequency = materialize(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "document-frequency")
    return _with_idf(frequency, texts)


def _with_idf(frequency: DataFrame, texts: int) -> DataFrame:
    idf = F.log(F.lit(texts + 1.0) / (F.col("df") + 1)) + 1
    return frequency.select("term", "df", idf.alias("idf"))
