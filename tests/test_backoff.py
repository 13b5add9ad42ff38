"""The back-off generator against a plain version."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from basketry.operators import backoff
from basketry.plans.recommend import DirectItem, recommend_sequence


def sales(seed, users=30, items=6, n=25):
    rng = random.Random(seed)
    return {u: [f"i{rng.randrange(items)}" for _ in range(rng.randint(0, n if u else 40 * n))] for u in range(users)}


def counts_of(sequences, length=3):
    counts = Counter()
    for items in sequences.values():
        for at in range(1, len(items)):
            for m in range(1, length + 1):
                if at >= m:
                    counts[tuple(items[at - m : at]), items[at]] += 1
    return counts


def frame(spark, sequences):
    rows = [(u, day, item) for u, items in sequences.items() for day, item in enumerate(items)]
    return spark.createDataFrame(rows, "user_id long, day int, product_id string")


def model(spark, sequences, **options):
    counts = backoff.follower_counts(frame(spark, sequences), ["day"], [F.floor(F.col("day") / 16)], **options)
    return backoff.BackoffGenerator.fit(counts)


@pytest.mark.parametrize("hot_rows", [50, 10**9])
def test_counts(spark, hot_rows):
    """Also where one user holds most rows and is walked in chunks."""
    sequences = sales(1)
    counts = backoff.follower_counts(
        frame(spark, sequences), ["day"], [F.floor(F.col("day") / 16)], hot_rows=hot_rows, probe_fraction=1.0
    )
    assert {(tuple(r.context), r.next_product): r.n for r in counts.collect()} == counts_of(sequences)


def plain(counts, state, temperature, seed, usual):
    for m in range(min(3, len(state)), 0, -1):
        followers = {b: n for (c, b), n in counts.items() if c == tuple(state[-m:])}
        if followers:
            if not temperature:
                return min(followers, key=lambda b: (-followers[b], b))

            def score(b):
                u = (int(hashlib.md5(f"{seed}:{'|'.join(state)}:{b}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
                return math.log(followers[b]) / temperature - math.log(-math.log(u))

            return min(followers, key=lambda b: (-score(b), b))
    return usual


@pytest.mark.parametrize("temperature", [0.0, 0.5])
def test_answers(spark, temperature):
    sequences = sales(2)
    counts, generator = counts_of(sequences), model(spark, sequences).at(temperature, 7)
    after = Counter()
    for (c, b), n in counts.items():
        if len(c) == 1:
            after[b] += n
    usual = min(after, key=lambda b: (-after[b], b))
    rng = random.Random(3)
    states = [[f"i{rng.randrange(8)}" for _ in range(rng.randint(0, 3))] for _ in range(60)]
    states = [list(s) for s in dict.fromkeys(map(tuple, states))]
    rows = generator.generate(spark.createDataFrame([(s,) for s in states], "state array<string>")).collect()
    assert len(rows) == len(states)
    for r in rows:
        assert r.generated == plain(counts, r.state, temperature, 7, usual)
    again = generator.generate(spark.createDataFrame([(s,) for s in states], "state array<string>")).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


@pytest.mark.parametrize("temperature", [0.0, 0.5])
def test_codes_answer_like_names(spark, temperature):
    """F8, F9: the counts may hold numbers of the names, so that no name is shuffled with a count."""
    sequences = sales(5)
    names = sorted({i for items in sequences.values() for i in items})
    coded = {u: [names.index(i) for i in items] for u, items in sequences.items()}
    rows = [(u, day, item) for u, items in coded.items() for day, item in enumerate(items)]
    bought = spark.createDataFrame(rows, "user_id long, day int, product_id long")
    counts = backoff.follower_counts(bought, ["day"], [F.floor(F.col("day") / 16)])
    table = spark.createDataFrame(list(enumerate(names)), "code long, name string")
    by_code = backoff.BackoffGenerator.fit(counts, temperature=temperature, names=table)
    assert dict(by_code.counts.dtypes)["context"] == "array<bigint>"
    states = [([],), (None,), (["i9"],), (["", "i1"],), (["i1", "i9"],), (["i1", "i2", None],)]
    states += [([f"i{a}", f"i{b}", f"i{c}"],) for a in range(6) for b in range(6) for c in range(3)]
    asked = spark.createDataFrame(states, "state array<string>")
    by_name = model(spark, sequences).at(temperature)
    assert sorted(map(str, by_code.generate(asked).collect())) == sorted(map(str, by_name.generate(asked).collect()))


@pytest.mark.parametrize("temperature", [0.0, 0.5])
def test_counts_of_many_runs_are_not_sorted(spark, monkeypatch, temperature):
    """the counts are joined with the runs by hash; the answers stay."""
    generator = model(spark, sales(6)).at(temperature, 3)
    states = spark.createDataFrame([([f"i{a}", f"i{b}", f"i{c}"],) for a in range(6) for b in range(6) for c in range(4)], "state array<string>")
    plans, asked = [], backoff.BackoffGenerator._asked

    def seen(self, runs):
        found = asked(self, runs)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(backoff.BackoffGenerator, "_asked", seen)
    few = sorted(map(str, generator.generate(states).collect()))
    monkeypatch.setattr(backoff, "HASHED", 10)
    assert sorted(map(str, generator.generate(states).collect())) == few
    assert "ShuffledHashJoin" not in plans[0] and "ShuffledHashJoin" in plans[1] and "SortMergeJoin" not in plans[1]


def test_runs_over_a_missing_item(spark):
    """An item without a number breaks no count: runs that begin with it are left out, those around it stay."""
    rows = [(1, day, item) for day, item in enumerate([5, None, 7, 8, 9])]
    bought = spark.createDataFrame(rows, "user_id long, day int, product_id long")
    counts = backoff.follower_counts(bought, ["day"], [F.floor(F.col("day") / 16)])
    found = {(tuple(r.context), r.next_product): r.n for r in counts.collect()}
    assert found == {
        ((5, None), 7): 1, ((7,), 8): 1, ((5, None, 7), 8): 1, ((8,), 9): 1, ((7, 8), 9): 1,
    }


def test_walks_use_the_last_items_only(spark):
    sequences = sales(4)
    generator = model(spark, sequences)
    counts = counts_of(sequences)
    people = [(1, ["i0", "i1", "i2", "i3", "i4"]), (2, ["i2", "i3", "i4"]), (3, [])]
    got = {
        r.user_id: r.recommendations
        for r in recommend_sequence(
            spark.createDataFrame(people, "user_id long, history array<string>"), generator, DirectItem(), 4
        ).collect()
    }
    assert got[1] == got[2]
    state, want = ["i2", "i3", "i4"], []
    for _ in range(4):
        want.append(plain(counts, state, 0.0, 0, None))
        state = [*state, want[-1]][-3:]
    assert got[1] == want and len(got[3]) == 4


def test_draws_follow_the_counts(spark):
    """Over many seeds the share of a follower is its count to the power of one over the temperature."""
    counts = spark.createDataFrame([(["a"], "x", 8), (["a"], "y", 4), (["a"], "z", 1)], "context array<string>, next_product string, n long")
    generator = backoff.BackoffGenerator.fit(counts)
    states = spark.createDataFrame([(["a"],)], "state array<string>")
    for temperature in (1.0, 0.5):
        weight = {b: n ** (1 / temperature) for b, n in (("x", 8), ("y", 4), ("z", 1))}
        u = [[(int(hashlib.md5(f"{s}:a:{b}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32 for b in weight] for s in range(4000)]
        seen = Counter()
        for row in u:
            seen[max(zip(weight, row), key=lambda p: math.log({"x": 8, "y": 4, "z": 1}[p[0]]) / temperature - math.log(-math.log(p[1])))[0]] += 1
        for b, w in weight.items():
            assert seen[b] / 4000 == pytest.approx(w / sum(weight.values()), abs=0.03)
    drawn = {s: generator.at(1.0, s).generate(states).first().generated for s in range(6)}
    want = defaultdict(str)
    for s in drawn:
        u = {b: (int(hashlib.md5(f"{s}:a:{b}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32 for b in "xyz"}
        want[s] = max(u, key=lambda b: math.log({"x": 8, "y": 4, "z": 1}[b]) - math.log(-math.log(u[b])))
    assert drawn == want
