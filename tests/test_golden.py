"""Small hand-made inputs with known results."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from basketry.functions import arrays, metrics, prompts
from basketry.operators import ratings, selections, split
from basketry.operators.keys import dense_id, hash_id
from basketry.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def strings(*items):
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


@pytest.mark.parametrize(
    "items, expected",
    [(["a"], "a"), (["a", "b"], "a, and b"), (["a", "b", "c"], "a, b, and c"), ([], None)],
)
def test_spoken_list(spark, items, expected):
    assert one(spark, prompts.spoken_list(strings(*items))) == expected


def test_prompt_short_and_long(spark):
    items = strings("pen", "pencil")
    short = one(spark, prompts.purchase_prompt(items, "S", prompts.SHORT_ENDING))
    assert short == (
        "[INST] <<SYS>>\nS\n<</SYS>>\nA user bought pen, and pencil in that order. What single item would "
        "he/she be likely to purchase next? Express as a python list 'next_item' [/INST]"
    )
    long = one(spark, prompts.purchase_prompt(items, "S"))
    assert long == short.replace(" [/INST]", " with an inline description[/INST]")
    assert one(spark, prompts.purchase_prompt(strings())) is None


def test_prompt_of_three_items(spark):
    text = one(spark, prompts.purchase_prompt(strings("a pen", "pencil", "a glue stick"), "S", prompts.SHORT_ENDING))
    assert "A user bought a pen, pencil, and a glue stick in that order." in text


def test_starter_only_for_empty_history(spark):
    histories = readers.literal_histories(
        spark, {"Ben": ["hammer", "nails", "saw", "super glue"], "Kumar": ["bicycle"], "noob": []}
    )
    started = histories.select("user", prompts.with_starter("history", "user").alias("h"))
    got = {r.user: r.h for r in started.collect()}
    assert got["Ben"] == ["hammer", "nails", "saw", "super glue"]
    assert got["Kumar"] == ["bicycle"]
    assert len(got["noob"]) == 1 and got["noob"][0] in prompts.GENERAL_STARTERS
    assert {r.user: r.h for r in started.collect()} == got
    cold = {r.user: r.c for r in histories.select("user", prompts.is_cold("history").alias("c")).collect()}
    assert cold == {"Ben": False, "Kumar": False, "noob": True}


def test_json_in_and_out(spark):
    response = json.dumps({"candidates": [{"text": "ruler"}, {"text": "other"}]})
    assert one(spark, prompts.generated_text(F.lit(response))) == "ruler"
    found = json.dumps({"result": {"data_array": [[1, "pen", 0.9], [2, "ink", 0.5]]}})
    assert one(spark, prompts.search_response_column(F.lit(found))) == ["pen", "ink"]
    assert one(spark, prompts.search_response_column(F.lit(found), -1)) == ["0.9", "0.5"]
    request = json.loads(one(spark, prompts.generation_request(F.lit("p"), 0.2)))
    assert request == {"prompt": "p", "temperature": 0.2}
    payload = json.loads(one(spark, prompts.split_payload(strings("Hello world", "Good morning"))))
    assert payload == {
        "dataframe_split": {"index": [0, 1], "columns": [0], "data": [["Hello world"], ["Good morning"]]}
    }
    assert json.loads(one(spark, prompts.split_payload(strings())))["dataframe_split"]["data"] == []
    assert one(spark, prompts.safe_name(F.lit("a.b.c"))) == "a_b_c"


def test_ratings_count_orders_without_lines(spark):
    orders = spark.createDataFrame([(o, 1) for o in range(5)], "order_id int, user_id int")
    lines = spark.createDataFrame(
        [(0, 7), (1, 7), (2, 7), (2, 8), (3, 999)], "order_id int, product_id int"
    )
    products = spark.createDataFrame([(7, "a"), (8, "b")], "product_id int, product_name string")
    got = {(r.user_id, r.product_id): r.rating for r in ratings.ratings(orders, lines, products).collect()}
    assert got == {(1, 7): 0.6, (1, 8): 0.2}
    assert sorted(map(tuple, ratings.ratings(orders, lines, products, unique_orders=True).collect())) == sorted(
        (u, p, x) for (u, p), x in got.items()
    )
    unfiltered = {r.product_id: r.rating for r in ratings.ratings(orders, lines).collect()}
    assert unfiltered == {7: 0.6, 8: 0.2, 999: 0.2}


def test_rating_passes_one_when_an_order_holds_a_product_twice(spark):
    orders = spark.createDataFrame([(0, 1)], "order_id int, user_id int")
    lines = spark.createDataFrame([(0, 7), (0, 7)], "order_id int, product_id int")
    assert ratings.ratings(orders, lines).first().rating == 2.0


def rated(spark, rows):
    return spark.createDataFrame(rows, "user_id int, product_id int, rating double")


def test_selections_take_tie_groups_whole(spark):
    df = rated(spark, [(1, 10, 0.9), (1, 12, 0.5), (1, 11, 0.5), (1, 13, 0.1)])
    for limit, expected in [(1, [10]), (2, [10]), (3, [10, 11, 12]), (4, [10, 11, 12, 13])]:
        assert selections.actual_selections(df, limit).first().selections == expected
    assert selections.actual_selections(df, 2, "strict").first().selections == [10, 11]
    with pytest.raises(ValueError):
        selections.actual_selections(df, 2, "other")


def test_user_with_too_large_a_first_tie_group_disappears(spark):
    df = rated(spark, [(1, p, 0.5) for p in range(11)] + [(2, p, 0.5) for p in range(10)])
    assert [(r.user_id, len(r.selections)) for r in selections.actual_selections(df).collect()] == [(2, 10)]
    strict = selections.actual_selections(df, ties="strict").collect()
    assert sorted((r.user_id, len(r.selections)) for r in strict) == [(1, 10), (2, 10)]


def test_selections_equal_the_longest_running_list(spark):
    """Against the running lists themselves: all that fit, and of them the longest."""
    import random

    rng = random.Random(5)
    rows = [(u, p, rng.choice([0.1, 0.2, 0.3, 0.5])) for u in range(60) for p in range(rng.randint(1, 30))]
    expected = {}
    for user in {r[0] for r in rows}:
        mine = sorted(((-r, p) for u, p, r in rows if u == user))
        best = []
        for value in sorted({r for r, _ in mine}):
            prefix = [p for r, p in mine if r <= value]
            if len(prefix) <= 10:
                best = prefix
        if best:
            expected[user] = best
    got = {r.user_id: r.selections for r in selections.actual_selections(rated(spark, rows)).collect()}
    assert got == expected


def test_frequent_users(spark):
    df = spark.createDataFrame([(1, [1] * 5), (2, [1] * 6)], "user_id int, selections array<int>")
    assert [r.user_id for r in selections.frequent_users(df).collect()] == [2]


def test_names_keep_order_repeats_and_unknown_ids(spark):
    products = spark.createDataFrame([(1, "name1"), (5, "name5")], "product_id int, product_name string")
    df = spark.createDataFrame(
        [(1, [5, 1, 999999, 5]), (2, [])], "user_id int, selections array<int>"
    )
    got = {r.user_id: r for r in selections.with_product_names(df, products).collect()}
    assert got[1].product_names == ["name5", "name1", "", "name5"]
    assert got[1].selections == [5, 1, 999999, 5]
    assert got[2].product_names == [] and got[2].selections == []


def test_history_and_truth(spark):
    df = spark.createDataFrame(
        [(1, list("abcdef")), (2, ["a", "b"]), (3, []), (4, list("abc"))], "user_id int, product_names array<string>"
    )
    got = {
        r.user_id: (r.previous_purchases, r.ground_truth)
        for r in selections.history_and_truth(df).collect()
    }
    assert got == {
        1: (["a", "b", "c"], ["d", "e", "f"]),
        2: (["a", "b"], []),
        3: ([], []),
        4: (["a", "b", "c"], []),
    }


def test_list_helpers(spark):
    assert one(spark, arrays.last_items(strings(*"abcdefg"), 5)) == list("cdefg")
    assert one(spark, arrays.last_items(strings(*"ab"), 5)) == ["a", "b"]
    assert one(spark, arrays.append_item(strings("a"), F.lit("b"))) == ["a", "b"]
    names = F.create_map(F.lit(1), F.lit("one"))
    assert one(spark, arrays.lookup(names, F.lit(1))) == "one"
    assert one(spark, arrays.lookup(names, F.lit(2))) == ""


METRIC_ROWS = [
    (1, list("axbyz"), ["a", "b"], [1, 0, 1, 0, 0], (1 + 2 / 3) / 2),
    (2, list("qqqqq"), ["a"], [0] * 5, 0.0),
    (3, list("abcde"), [], [0] * 5, 0.0),
    (4, ["x", "a"], ["a"], [0, 1], 0.5),
    (5, ["a", "a"], ["a"], [1, 1], 1.0),
]


def metric_frame(spark):
    df = spark.createDataFrame(
        [r[:3] for r in METRIC_ROWS],
        "user_id int, recommendations array<string>, ground_truth array<string>",
    )
    return df.withColumn("relevance", metrics.binary_relevance("recommendations", "ground_truth"))


def test_relevance_and_average_precision(spark):
    rows = metric_frame(spark).withColumn("ap", metrics.average_precision("relevance")).collect()
    for row, expected in zip(sorted(rows, key=lambda r: r.user_id), METRIC_ROWS, strict=True):
        assert row.relevance == expected[3]
        assert row.ap == pytest.approx(expected[4])


def test_map_and_precision(spark):
    frame = metric_frame(spark)
    row = metrics.map_at_k(frame, 5).first()
    assert (row.k, row.users) == (5, 5)
    assert row.map_at_k == pytest.approx((5 / 6 + 0 + 0 + 0.5 + 1) / 5)
    assert metrics.map_at_k(frame, 1).first().map_at_k == pytest.approx(2 / 5)
    p = {r.user_id: r.p for r in frame.select("user_id", metrics.precision_at_k("relevance", 5).alias("p")).collect()}
    assert p[4] == pytest.approx(1 / 5)
    with pytest.raises(ValueError):
        metrics.precision_at_k("relevance", 0)
    assert metrics.map_at_k(frame.filter("false"), 5).first().map_at_k is None
    assert one(spark, metrics.format_map(5, F.lit(0.4666))) == "MAP@5: 0.47"


def test_metric_variants(spark):
    frame = metric_frame(spark).withColumn(
        "d", metrics.binary_relevance("recommendations", "ground_truth", distinct=True)
    ).withColumn("t", metrics.average_precision("relevance", "relevant", F.size("ground_truth")))
    got = {r.user_id: r for r in frame.collect()}
    assert got[5].d == [1, 0]
    assert got[1].t == pytest.approx(5 / 6)
    assert got[3].t == 0.0


def test_metrics_on_random_lists(spark):
    import random

    rng = random.Random(9)
    lists = [[rng.randint(0, 1) for _ in range(rng.randint(0, 8))] for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, relevance array<int>")
    got = {
        r.i: r
        for r in df.select(
            "i", metrics.average_precision("relevance").alias("ap"), metrics.precision_at_k("relevance", 4).alias("p")
        ).collect()
    }
    for i, rel in enumerate(lists):
        at_hits = [sum(rel[: j + 1]) / (j + 1) for j, x in enumerate(rel) if x]
        assert got[i].ap == pytest.approx(sum(at_hits) / len(at_hits) if at_hits else 0.0)
        assert got[i].p == pytest.approx(sum(rel[:4]) / 4)
    k3 = metrics.map_at_k(df, 3).first().map_at_k

    def ap(rel):
        at_hits = [sum(rel[: j + 1]) / (j + 1) for j, x in enumerate(rel) if x]
        return sum(at_hits) / len(at_hits) if at_hits else 0.0

    assert k3 == pytest.approx(sum(ap(r[:3]) for r in lists) / len(lists))


def test_splits(spark):
    df = spark.range(2000).select(
        (F.col("id") % 50).cast("int").alias("user_id"), F.col("id").cast("int").alias("product_id")
    )
    for train, test in (split.hash_split(df), split.random_split(df)):
        a, b = {tuple(r) for r in train.collect()}, {tuple(r) for r in test.collect()}
        assert not a & b and len(a) + len(b) == 2000
        assert 0.75 < len(a) / 2000 < 0.85
    again = split.hash_split(df.repartition(7))[0]
    assert {tuple(r) for r in split.hash_split(df)[0].collect()} == {tuple(r) for r in again.collect()}
    assert 100 < split.bernoulli_sample(df).count() < 300
    assert 100 < split.hash_sample(df, "user_id", "product_id").count() < 300
    users = df.select("user_id").distinct()
    first = {r.user_id for r in split.sample_users(users, 10).collect()}
    assert len(first) == 10 and first == {r.user_id for r in split.sample_users(users.repartition(3), 10).collect()}
    assert split.sample_users(users, 100).count() == 50


def test_dense_id(spark):
    df = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("k")).repartition(9)
    rows = dense_id(df, "k", partitions=7).orderBy("k").collect()
    assert [r.id for r in rows] == list(range(5000))
    assert dense_id(df.limit(0), "k").count() == 0


def test_hash_id_is_stable_and_unique(spark):
    df = spark.range(3000).selectExpr("id % 30 as user_id", "id as product_id")
    a = {tuple(r) for r in hash_id(df, "user_id", "product_id").collect()}
    b = {tuple(r) for r in hash_id(df.repartition(5), "user_id", "product_id").collect()}
    assert a == b and len({r[-1] for r in a}) == 3000


def test_order_columns(spark, tmp_path):
    from basketry.sources import retail

    day = dt.datetime
    spark.createDataFrame(
        [(1, 5, day(1995, 1, 1)), (2, 5, day(1995, 1, 1)), (3, 5, day(1995, 1, 11)), (4, 6, day(1995, 1, 3, 14))],
        "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz",
    ).write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.order_id: tuple(r)[2:] for r in retail.orders(spark, str(tmp_path)).collect()}
    assert got[1] == ("prior", 1, 0, 0, None)
    assert got[2] == ("prior", 2, 0, 0, 0.0)
    assert got[3] == ("train", 3, 3, 0, 10.0)
    assert got[4] == ("test", 1, 2, 14, None)
