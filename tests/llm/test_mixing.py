import numpy as np
import pytest

from basketry.llm import mixing, queries


def by_rounds(sizes, weights, share, most):
    """Targets by handing on the excess until none is above: {source: size} -> {source: target}."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, rest, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while rest > 1e-9 and open_:
        level = rest / sum(weight[s] for s in open_)
        for s in open_:
            target[s] += level * weight[s]
        rest = sum(max(0.0, target[s] - most * sizes[s]) for s in open_)
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


def check(rows, slack=2):
    sizes, longest = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        longest[r.source] = max(longest.get(r.source, 0), r.size)
    target = by_rounds(sizes, mixing.WEIGHTS, mixing.SHARE, mixing.MOST)
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]}
        assert own[0].target == pytest.approx(target[s], rel=1e-9, abs=1e-6)
        assert abs(sum(r.taken for r in own) - target[s]) <= slack * longest[s]
        ratio = target[s] / sizes[s] if sizes[s] else 0
        assert abs(sum(r.copies for r in own) - ratio * len(own)) <= slack
    assert all(0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in rows)


def test_query(spark, base):
    rows = mixing.mix(spark.read.parquet(f"{base}/documents.parquet")).collect()
    check(rows)
    again = queries.QUERIES["op3_mixing"](spark, base).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_near_target(spark):
    """The words of each source are much nearer to the target than a document is long."""
    rows = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    check(rows, 1)
    off = {}
    for r in rows:
        off.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert np.mean([abs(t - got) / t for t, got in off.values()]) < 0.003


def test_hot_source_flies_in_groups(spark, docs_frame):
    rows = [(i, "w " * (i * 7919 % 97), "en", "hot" if i % 5 else f"s{i % 3}") for i in range(9000)]
    check(mixing.mix(docs_frame(rows)).collect())


def test_flight_keeps_the_sums():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 50, 500):
        size, prob = rng.integers(0, 900, n), rng.random(n)
        flown = mixing.fly(size, prob)
        assert ((flown > 0) & (flown < 1)).sum() <= 2
        assert flown.sum() == pytest.approx(prob.sum()) and (flown * size).sum() == pytest.approx((prob * size).sum())
        assert set(mixing.land(size, flown)) <= {0.0, 1.0}


def test_odd_rows(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    check(rows)


def test_no_rows_and_no_words(spark, odd, docs_frame):
    assert mixing.mix(odd.limit(0)).count() == 0
    rows = mixing.mix(docs_frame([(1, None, "en", "a"), (2, "", "en", None)])).collect()
    assert [(r.target, r.taken) for r in rows] == [(0.0, 0), (0.0, 0)]


def test_inclusion_probabilities_are_kept():
    """Over many seeds a document is taken as often as its probability says, whatever its size."""
    rng = np.random.default_rng(8)
    size, prob = rng.integers(1, 400, 60), rng.uniform(0.05, 0.95, 60)
    prob[:6], size[:6] = 0.4, [10, 10, 200, 200, 390, 390]
    flown = np.array([mixing.fly(size, prob, seed) for seed in range(3000)])
    assert np.abs(flown.mean(axis=0) - prob).max() < 0.05
    assert (mixing.fly(size, prob, 7) == mixing.fly(size, prob, 7)).all()


def test_other_seeds_give_other_mixes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    taken = [sorted((r.doc_id, r.taken) for r in mixing.mix(docs, seed=s).collect()) for s in (0, 0, 1)]
    assert taken[0] == taken[1] != taken[2]


def test_equal_rows_are_one_unit(spark, docs_frame, monkeypatch):
    """Thousands of equal rows do not fly together; what is taken of them is dealt evenly."""
    monkeypatch.setattr(mixing, "ALIKE", 100)
    rows = [(None, "a b c", "en", "hot")] * 5000 + [(i, "w " * (i % 50), "en", "hot" if i % 2 else "cold") for i in range(1, 800)]
    found = mixing.mix(docs_frame(rows)).collect()
    check(found)
    alike = [r.copies for r in found if r.doc_id is None]
    assert len(alike) == 5000 and max(alike) - min(alike) <= 1
    units = mixing._units(docs_frame(rows), mixing.WEIGHTS, mixing.SHARE, mixing.MOST, 0)
    assert units.count() == 800 and units.filter("rows = 5000").count() == 1
