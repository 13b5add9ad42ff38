"""Generators, one-shot and step-by-step recommendations."""

import json
from collections import Counter

from pyspark.sql import functions as F

from basketry.functions import prompts
from basketry.operators import index
from basketry.operators.generate import NeighbourGenerator, PromptGenerator, TransitionGenerator, generate
from basketry.operators.transitions import top_neighbours, top_transitions
from basketry.plans.evaluation import score
from basketry.plans.recommend import (
    CatalogueSearch,
    DirectItem,
    extended_history,
    recommend,
    recommend_sequence,
)

MOVES = [(1, 2, 5), (1, 3, 5), (2, 4, 1), (3, 1, 2), (4, 2, 9), (4, 1, 9)]


def moves(spark):
    return spark.createDataFrame(MOVES, "product_id long, next_product long, n long")


def histories(spark, rows):
    return spark.createDataFrame(rows, "user_id long, history array<long>")


def test_top_transitions_break_ties_by_id(spark):
    got = {(r.product_id, r["rank"]): r.next_product for r in top_transitions(moves(spark), 2).collect()}
    assert got[(1, 1)] == 2 and got[(1, 2)] == 3 and got[(4, 1)] == 1


def test_transition_steps(spark):
    people = histories(spark, [(1, [3, 1]), (2, [7]), (3, []), (4, [1])])
    generator = TransitionGenerator.fit(moves(spark))
    once = {r.user_id: r.item for r in recommend(people, generator, DirectItem()).collect()}
    assert once == {1: 2, 2: 2, 3: 2, 4: 2}  # 2 is also what is bought next most often
    paths = recommend_sequence(people, generator, DirectItem(), 4)
    got = {r.user_id: r.recommendations for r in paths.collect()}
    assert got == {1: [2, 4, 1, 2], 2: [2, 4, 1, 2], 3: [2, 4, 1, 2], 4: [2, 4, 1, 2]}
    longer = {r.user_id: r.history for r in extended_history(people, paths).collect()}
    assert longer[1] == [3, 1, 2, 4, 1, 2]
    lazy = TransitionGenerator.fit(moves(spark), keep=False)
    assert {r.user_id: r.item for r in recommend(people, lazy, DirectItem()).collect()} == once


def brute_neighbour_walk(counts, history, steps):
    top = {}
    for (a, b), n in counts.items():
        top.setdefault(a, []).append((-n, b))
    total = Counter()
    for (a, _), n in counts.items():
        total[a] += n
    usual = min(total, key=lambda a: (-total[a], a))
    state, out = set(history), []
    for _ in range(steps):
        votes = Counter()
        for h in state:
            for n, b in top.get(h, []):
                votes[b] += -n
        item = min(votes, key=lambda b: (-votes[b], b)) if votes else usual
        out.append(item)
        state.add(item)
    return out


def test_neighbour_walk_against_brute_force(spark):
    import random

    rng = random.Random(2)
    counts = {}
    for _ in range(120):
        a, b = rng.sample(range(20), 2)
        counts[(a, b)] = counts[(b, a)] = rng.randint(1, 6)
    table = spark.createDataFrame([(a, b, n) for (a, b), n in counts.items()], "product_id long, neighbour long, n long")
    people = [(u, [rng.randint(0, 25) for _ in range(rng.randint(1, 4))]) for u in range(25)]
    generator = NeighbourGenerator.fit(table)
    got = {
        r.user_id: r.recommendations
        for r in recommend_sequence(histories(spark, people), generator, DirectItem(), 3).collect()
    }
    assert got == {u: brute_neighbour_walk(counts, h, 3) for u, h in people}
    assert top_neighbours(table, 2).groupBy("product_id").count().agg(F.max("count")).first()[0] <= 2


def test_users_without_a_find_stay(spark):
    """A text outside the vocabulary finds nothing; its user counts with a score of 0."""
    catalogue = spark.createDataFrame(CATALOGUE, "id long, product string")
    found = CatalogueSearch(index.TextIndex.build(catalogue, "id", "product"), item="text")
    people = named(spark, [("a", ["red pen"]), ("b", ["paper clip"]), ("c", ["zzz"])])
    generator = PromptGenerator(lambda: lambda ps: [json.dumps({"candidates": [{"text": "qqq" if "zzz" in p else "red pen"}]}) for p in ps])
    rows = recommend(people, generator, found, k=1, user="user_id").collect()
    assert {r.user_id: r.item for r in rows} == {"a": "red pen", "b": "red pen", "c": None}
    walks = recommend_sequence(people, generator, found, 1)
    truth = spark.createDataFrame([(u, ["red pen"]) for u in "abcd"], "user_id string, ground_truth array<string>")
    row = score(truth, walks, 5).first()
    assert row.users == 4 and row.map_at_k == 0.5


CATALOGUE = [(1, "red pen"), (2, "blue ink"), (3, "paper clip"), (4, "paper tray"), (5, "desk lamp")]
AFTER = {"red pen": "some blue ink", "blue ink": "paper", "paper clip": "a lamp for the desk"}


def clerk():
    """Names what follows the last item of the prompt."""

    def answer(prompt):
        bought = prompt.split("A user bought ")[1].split(" in that order")[0]
        last = bought.split(", and ")[-1]
        return json.dumps({"candidates": [{"text": AFTER.get(last, "pen")}]})

    return lambda texts: [answer(t) for t in texts]


def named(spark, rows):
    return spark.createDataFrame(rows, "user_id string, history array<string>")


def test_prompted_recommendations(spark):
    catalogue = spark.createDataFrame(CATALOGUE, "id long, product string")
    built = index.TextIndex.build(catalogue, "id", "product")
    people = named(spark, [("a", ["red pen"]), ("b", ["desk lamp", "red pen"]), ("c", ["blue ink"]), ("d", [])])
    search = CatalogueSearch(built, item="text")
    got = {}
    for r in recommend(people, PromptGenerator(clerk), search, 2, starters=["red pen"]).collect():
        got.setdefault(r.user_id, {})[r["rank"]] = r.item
    assert got["a"][1] == got["b"][1] == got["d"][1] == "blue ink"
    assert got["c"] == {1: "paper clip", 2: "paper tray"}
    paths = recommend_sequence(people, PromptGenerator(clerk), search, 3, starters=["red pen"])
    walks = {r.user_id: r.recommendations for r in paths.collect()}
    assert walks["a"] == walks["b"] == walks["d"] == ["blue ink", "paper clip", "desk lamp"]
    assert walks["c"] == ["paper clip", "desk lamp", "red pen"]


def test_a_model_is_asked_once_per_state(spark):
    asked = spark.sparkContext.accumulator(0)

    def counting():
        def answer(texts):
            asked.add(len(texts))
            return clerk()(texts)

        return answer

    catalogue = spark.createDataFrame(CATALOGUE, "id long, product string")
    built = index.TextIndex.build(catalogue, "id", "product")
    people = named(spark, [(str(i), [["red pen", "blue ink", "desk lamp"][i % 3]]) for i in range(60)])
    search = CatalogueSearch(built, item="text")
    assert recommend(people, PromptGenerator(counting), search, 2).count() > 60
    assert asked.value == 3
    assert recommend_sequence(people, PromptGenerator(counting), search, 2).count() == 60
    assert asked.value == 3 + 2 * 3


def test_a_step_that_finds_nothing_leaves_the_history(spark):
    catalogue = spark.createDataFrame([(1, "unrelated")], "id long, product string")
    built = index.TextIndex.build(catalogue, "id", "product")
    paths = recommend_sequence(named(spark, [("a", ["red pen"])]), PromptGenerator(clerk), CatalogueSearch(built, "text"), 2)
    assert paths.first().recommendations == []


def test_generate_keeps_rows(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 5 > 0, F.lit("A user bought x in that order")).alias("p"))
    rows = generate(df, "p", clerk, batch_size=9).collect()
    assert len(rows) == 500 and all((r.response is None) == (r.id % 5 == 0) for r in rows)


def test_ids_with_names_to_search(spark):
    catalogue = spark.createDataFrame(CATALOGUE, "id long, product string")
    names = catalogue.selectExpr("id as product_id", "product as product_name")
    built = index.TextIndex.build(catalogue, "id", "product")
    out = recommend(
        histories(spark, [(1, [4]), (2, [1])]), TransitionGenerator.fit(moves(spark)), CatalogueSearch(built, names=names), 2
    )
    got = {(r.user_id, r["rank"]): r.item for r in out.collect()}
    assert got == {(1, 1): 1, (2, 1): 2}  # "red pen" and "blue ink" share a word with nothing else


def test_score(spark):
    truth = spark.createDataFrame([(1, [2, 9]), (2, [5])], "user_id long, ground_truth array<long>")
    recs = spark.createDataFrame([(1, [2, 4, 9]), (2, [1])], "user_id long, recommendations array<long>")
    row = score(truth, recs, 3).first()
    assert row.users == 2 and abs(row.map_at_k - (1 + 2 / 3) / 2 / 2) < 1e-12


def test_no_leak_from_the_held_out_part(spark, base):
    """Pairs of user and product in the test part are not seen by the transition model."""
    from basketry.operators.split import in_train
    from basketry.plans import queries
    from basketry.sources import retail

    train = retail.purchases(spark, base).filter(in_train())
    counts = queries._transition_counts(spark, base)
    users = train.select("user_id").distinct().count()
    assert counts.agg(F.sum("n")).first()[0] == train.count() - users


def test_starters_are_fixed():
    assert prompts.GROCERY_STARTERS[0] == "chicken" and len(prompts.GENERAL_STARTERS) == 10
