import math

import numpy as np
import pytest

from basketry.llm import multi_index as mi
from basketry.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string"


def exact(vectors, every=20, k=20):
    """query -> (vec_id, score) of the true nearest, by the plain sum."""
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], dtype="f8")
    out = {}
    for at, q in enumerate(ids):
        if q % every == 0:
            score = np.zeros(len(ids))
            for d in range(x.shape[1]):
                score += x[at, d] * x[:, d]
            order = sorted((j for j in range(len(ids)) if j != at), key=lambda j: (-score[j], ids[j]))[:k]
            out[q] = [(ids[j], score[j]) for j in order]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall(spark, folder):
    folder = f"/root/testdata/{folder}"
    got = by_query(queries.QUERIES["op5_neighbours"](spark, folder).collect())
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    truth = exact(vectors)
    assert set(got) == set(truth)
    hits = np.mean([len({i for i, _ in got[q]} & {i for i, _ in truth[q]}) / 20 for q in truth])
    assert hits >= 0.9
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and len(found) == 20
        for i, s in found:
            assert s == pytest.approx(math.fsum(a * b for a, b in zip(vectors[q], vectors[i])), abs=1e-12)


def test_full_visit_is_exact_with_ties_and_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(mi, "BLOCK", 64)
    rng = np.random.default_rng(2)
    hot = rng.normal(size=8).astype("f4")
    vectors = {i: (hot if i % 3 == 0 else rng.normal(size=8).astype("f4")).tolist() for i in range(900)}
    rows = spark.createDataFrame([(i, v, 0, 1, "s") for i, v in vectors.items()], SCHEMA)
    index = mi.MultiIndex(mi.usable(rows), block=64)
    assert index.cells.sum() == 900 and index.parts.max() > 1
    got = by_query(index.search(index.rows.filter("vec_id % 20 = 0"), 20, 900).collect())
    truth = exact(vectors)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in truth.items()}
    some = by_query(mi.nearest(rows).collect())
    assert np.mean([len({s for _, s in some[q]} & {s for _, s in truth[q]}) / len({s for _, s in truth[q]}) for q in truth]) > 0.85


def test_walk_is_by_rising_sum():
    rng = np.random.default_rng(1)
    first, second, counts = rng.random(7), rng.random(9), rng.integers(0, 5, (7, 9))
    found, reach = mi.walk(first, second, counts, 60)
    sums = [first[a] + second[b] for a, b in found]
    assert sums == sorted(sums) and reach == sums[-1]
    assert sum(counts[a, b] for a, b in found) >= 60 > sum(counts[a, b] for a, b in found[:-1])
    less = {(a, b) for a in range(7) for b in range(9) if first[a] + second[b] <= reach and counts[a, b]}
    assert less == set(found)
    assert len(mi.walk(first, second, counts, 10**6)[0]) == (counts > 0).sum()


def test_rows_that_take_no_part(spark):
    good = [(i, [float(i + 1), 2.0, -1.0, 0.5], 0, 1, "s") for i in range(30)]
    bad = [(40, None, 0, 1, "s"), (60, [0.0] * 4, 0, 1, "s"), (80, [1.0, None, 1.0, 1.0], 0, 1, "s"), (100, [float("nan")] * 4, 0, 1, "s"),
           (120, [float("inf"), 0.0, 0.0, 0.0], 0, 1, "s"), (None, [1.0] * 4, 0, 1, "s"), (140, [], 0, 1, "s"), (160, [1.0], 0, 1, "s")]
    rows = spark.createDataFrame(good + bad + good[:3], SCHEMA)
    got = by_query(mi.nearest(rows).collect())
    assert set(got) == {0, 20} and all(i < 30 for v in got.values() for i, _ in v)
    assert got[20] == exact({i: v for i, v, *_ in good})[20]


def test_few_and_no_rows(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0], 0, 1, "s"), (7, [1.0, 1.0], 0, 1, "s"), (8, [-1.0, 1.0], 0, 1, "s")], SCHEMA)
    assert [(r.vec_id, r.score) for r in mi.nearest(rows).collect()] == [(7, 3.0), (8, 1.0)]
    assert mi.nearest(rows.limit(0)).count() == 0 and mi.nearest(rows.filter("vec_id = 0")).count() == 0


def test_cells_grow_with_the_table():
    sizes = [mi.centroids_for(n) for n in (1, 100, 2_000, 51_000, 10**6, 10**7, 10**8, 10**10)]
    assert sizes == [2, 10, 44, 64, 125, 395, 1250, 2000]
    assert all(n / mi.centroids_for(n) ** 2 <= mi.ENTRIES + 1 for n in (10**5, 10**6, 10**7, 10**8))
    assert mi.centroids_for(10**6, 10) == 10
