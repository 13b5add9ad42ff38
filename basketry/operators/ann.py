"""Approximate search: candidates from cells or hash tables, re-ranked exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from basketry.operators.search import DenseScore, top_k_join
from basketry.session import materialize, scratch_path


def _add_int_lists(df: DataFrame, name: str, fn) -> DataFrame:
    """Add an ``array<int>`` column computed from the normalised vectors of a batch."""
    schema = StructType([*df.schema.fields, StructField(name, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = fn(DenseScore._matrix(pa.Table.from_batches([batch])))
            flat = pa.array(lists.astype(np.int32).ravel())
            offsets = pa.array(np.arange(len(lists) + 1, dtype=np.int32) * lists.shape[1])
            column = pa.ListArray.from_arrays(offsets, flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def write_by_group(rows: DataFrame, group: str) -> DataFrame:
    """Write index rows in one folder per group and read them back.

    Adaptive execution sizes the writing tasks by what they hold, so a cell that holds a third of the
    rows is written by many.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "index")
    rows.hint("rebalance", F.col(group)).write.partitionBy(group).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@dataclass
class CellIndex:
    """Index rows by k-means cell. The centres, ``cells`` x dimensions, are all the driver holds."""

    rows: DataFrame
    centres: np.ndarray

    @classmethod
    def build(
        cls,
        index: DataFrame,
        cells: int = 16,
        seed: int = 7,
        max_iter: int = 10,
        keep: bool = True,
    ) -> CellIndex:
        """Fit the centres on all rows, then assign them.

        ``keep`` writes the index by cell, so that a search for few queries reads the cells it probes.
        """
        unit = F.transform("embedding", lambda x: x.cast("double") / F.nullif("norm", F.lit(0.0)))
        train = index.filter("norm > 0").select(array_to_vector(unit).alias("features"))
        model = KMeans(k=cells, seed=seed, maxIter=max_iter).fit(train)
        centres = np.array(model.clusterCenters())
        rows = cls._assign(index, centres, 1)
        if keep:
            rows = write_by_group(rows, "cell")
        return cls(rows, centres)

    @staticmethod
    def _assign(df: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
        half_square = 0.5 * (centres**2).sum(axis=1)

        def nearest(m: np.ndarray) -> np.ndarray:
            return np.argsort(half_square - m @ centres.T, axis=1, kind="stable")[:, :n]

        placed = _add_int_lists(df, "_cells", nearest)
        return placed.withColumn("cell", F.explode("_cells")).drop("_cells")

    def probe(self, queries: DataFrame, n_probe: int) -> DataFrame:
        """The cells each query visits, as ``(query_id, cell)``."""
        return self._assign(queries, self.centres, min(n_probe, len(self.centres))).select("query_id", "cell")

    def search(self, queries: DataFrame, k: int, n_probe: int = 4, **options) -> DataFrame:
        visits = self.probe(queries, n_probe)
        return top_k_join(queries, self.rows, k, DenseScore(), group="cell", visits=visits, **options)

    def candidate_fraction(self, queries: DataFrame, n_probe: int = 4) -> DataFrame:
        return candidate_fraction(self.probe(queries, n_probe), self.rows, "cell")


def hash_planes(tables: int, bits: int, dimensions: int) -> np.ndarray:
    """Planes of +1/-1 from md5, so that any engine with md5 can build the same."""
    def sign(t: int, b: int, j: int) -> float:
        return 1.0 if int(hashlib.md5(f"{t}:{b}:{j}".encode()).hexdigest()[0], 16) >= 8 else -1.0

    return np.array(
        [[[sign(t, b, j) for j in range(dimensions)] for b in range(bits)] for t in range(tables)]
    )


@dataclass
class HashIndex:
    """Index rows by sign patterns against fixed planes, in several tables."""

    rows: DataFrame
    planes: np.ndarray

    @classmethod
    def build(
        cls, index: DataFrame, dimensions: int, tables: int = 4, bits: int = 4, keep: bool = True
    ) -> HashIndex:
        planes = hash_planes(tables, bits, dimensions)
        rows = cls._assign(index, planes)
        if keep:
            rows = write_by_group(rows, "bucket")
        return cls(rows, planes)

    @staticmethod
    def _assign(df: DataFrame, planes: np.ndarray) -> DataFrame:
        tables, bits, _ = planes.shape
        weights = 1 << np.arange(bits)

        def buckets(m: np.ndarray) -> np.ndarray:
            pattern = np.stack([(m @ planes[t].T >= 0) @ weights for t in range(tables)], axis=1)
            return pattern + (np.arange(tables) << bits)

        placed = _add_int_lists(df, "_buckets", buckets)
        return placed.withColumn("bucket", F.explode("_buckets")).drop("_buckets")

    def probe(self, queries: DataFrame) -> DataFrame:
        """The bucket of each query in each table, as ``(query_id, bucket)``."""
        return self._assign(queries, self.planes).select("query_id", "bucket")

    def search(self, queries: DataFrame, k: int, **options) -> DataFrame:
        visits = self.probe(queries)
        return top_k_join(queries, self.rows, k, DenseScore(), group="bucket", visits=visits, **options)

    def candidate_fraction(self, queries: DataFrame) -> DataFrame:
        return candidate_fraction(self.probe(queries), self.rows, "bucket")


def candidate_fraction(queries: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """One row: scored pairs as a share of all pairs, from counts per group."""
    per_query = queries.groupBy(group).agg(F.count(F.lit(1)).alias("nq"))
    per_row = rows.groupBy(group).agg(F.count(F.lit(1)).alias("ni"))
    scored = per_query.join(per_row, group).agg(F.sum(F.col("nq") * F.col("ni")).alias("scored"))
    all_queries = queries.agg(F.countDistinct("query_id")).scalar()
    all_rows = rows.agg(F.countDistinct("id")).scalar()
    return scored.select((F.col("scored") / (all_queries * all_rows)).alias("candidate_fraction"))


def recall_at_k(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of exact results that the approximate search found."""
    found = approximate.select("query_id", "id", F.lit(1).alias("hit"))
    return exact.select("query_id", "id").join(found, ["query_id", "id"], "left").agg(
        F.avg(F.coalesce("hit", F.lit(0))).alias("recall")
    )
