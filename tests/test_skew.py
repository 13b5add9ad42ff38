"""Windows over hot keys give what a plain window gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.operators.skew import OrderedGroups, hot_keys
from basketry.operators.transitions import cart_neighbours, next_purchases, order_neighbours


def events(spark, seed, n=600):
    """One user has a third of the rows, one day of that user most of those; values may be null."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = 0 if i < n // 3 else rng.randint(1, 40)
        day = 5 if user == 0 and rng.random() < 0.6 else rng.randint(0, 20)
        rows.append((user, day, i, None if rng.random() < 0.1 else rng.randint(0, 9)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "user_id int, day int, seq int, item int")


def plain(df):
    w = Window.partitionBy("user_id").orderBy("day", "seq")
    return (
        df.withColumn("rn", F.row_number().over(w).cast("long"))
        .withColumn("nxt", F.lead("item").over(w))
        .withColumn("prv", F.lag("item").over(w))
    )


BUCKETS = {
    "one level": lambda: [F.col("day")],
    "two levels": lambda: [F.struct("day", F.floor(F.col("seq") / 16).alias("s")), F.col("day")],
    "three levels": lambda: [
        F.struct("day", F.floor(F.col("seq") / 4).alias("s")),
        F.col("day"),
        F.floor(F.col("day") / 7),
    ],
}


@pytest.mark.parametrize("buckets", BUCKETS, ids=str)
@pytest.mark.parametrize("hot_rows", [0, 30, 10**9])
def test_same_as_plain_window(spark, buckets, hot_rows):
    df = events(spark, len(buckets))
    groups = OrderedGroups(
        df, ["user_id"], ["day", "seq"], BUCKETS[buckets](), hot_rows=hot_rows, probe_fraction=1.0
    )
    got = groups.row_number("rn").neighbour("item", "nxt", 1).neighbour("item", "prv", -1).result()
    assert bool(groups.levels) == (hot_rows < 10**9)
    columns = plain(df).columns
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, plain(df).collect()))


def test_hot_keys_are_few(spark):
    df = events(spark, 1)
    assert hot_keys(df, ["user_id"], hot_rows=100) == [(0,)]
    assert hot_keys(df, ["user_id"], hot_rows=1000) == []


def test_transitions_of_a_hot_user(spark):
    df = events(spark, 3).dropna().withColumnRenamed("item", "product_id")
    buckets = [F.struct("day", F.floor(F.col("seq") / 8).alias("s")), F.col("day")]

    def pairs(hot_rows):
        out = next_purchases(df, ["day", "seq"], buckets, hot_rows=hot_rows, probe_fraction=1.0)
        return sorted(map(tuple, out.collect()))

    assert pairs(20) == pairs(10**9)


HOT_SETTINGS = {
    "spark.basketry.hotRows": "3",
    "spark.basketry.probeFraction": "1.0",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
}


@pytest.fixture
def settings(spark):
    """Set some settings for one test."""
    before = {}

    def change(values):
        for key, value in values.items():
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


@pytest.mark.parametrize(
    "name",
    ["orders_shape", "order_products_shape", "transition_topk", "cooccurrence_topk", "cart_window_topk", "recommend_neighbours", "map_by_name"],
)
def test_every_key_hot_and_nothing_broadcast(spark, base, settings, name):
    import compare

    settings(HOT_SETTINGS)
    same, note = compare.compare(spark, compare.database(base), name, base)
    assert same, note


def brute_neighbours(orders, window):
    counts = {}
    for items in orders.values():
        for i, (p, a) in enumerate(items):
            for q, b in items[:i] + items[i + 1 :]:
                if a != b and abs(p - q) <= window:
                    counts[(a, b)] = counts.get((a, b), 0) + 1
    return counts


@pytest.mark.parametrize("gaps", [False, True])
def test_cart_neighbours_against_brute_force(spark, gaps):
    rng = random.Random(11)
    orders = {o: [(i + 1, rng.randint(0, 12)) for i in range(rng.choice([1, 2, 5, 9, 40]))] for o in range(30)}
    orders[99] = [(i + 1, rng.randint(0, 12)) for i in range(500)]  # one order with most rows
    if gaps:
        orders = {o: [x for x in items if rng.random() < 0.7] for o, items in orders.items()}
    rows = [(o, a, p) for o, items in orders.items() for p, a in items]
    df = spark.createDataFrame(rows, "order_id int, product_id int, add_to_cart_order int")
    for window, chunk in ((3, 4), (4, 4), (10, 4096), (3, 8)):
        got = {(r.product_id, r.neighbour): r.n for r in cart_neighbours(df, window, chunk).collect()}
        assert got == brute_neighbours(orders, window)
    with pytest.raises(ValueError):
        cart_neighbours(df, 5, 4)


def test_order_neighbours_against_brute_force(spark):
    rng = random.Random(12)
    orders = {o: [rng.randint(0, 30) for _ in range(rng.choice([1, 2, 5, 9, 60]))] for o in range(40)}
    df = spark.createDataFrame([(o, a) for o, items in orders.items() for a in items], "order_id int, product_id int")
    want = {}
    for items in orders.values():
        for a in set(items):
            for b in set(items) - {a}:
                want[(a, b)] = want.get((a, b), 0) + 1
    for block in (1, 4, 128):
        assert {(r.product_id, r.neighbour): r.n for r in order_neighbours(df, block).collect()} == want


def test_a_long_order_keeps_all_its_pairs(spark):
    n = 4200
    lines = spark.range(n).selectExpr("1L as order_id", "id as product_id")
    lines = lines.union(lines.limit(2)).union(spark.range(10).selectExpr("2L as order_id", "id as product_id"))
    row = order_neighbours(lines).agg(F.count("*").alias("pairs"), F.sum("n").alias("n")).first()
    assert row.pairs == n * (n - 1) and row.n == n * (n - 1) + 90


def test_skewed_joins_are_split(spark, tmp_path, settings):
    """A user with a third of the orders and an order with a third of the lines; nothing broadcast."""
    from basketry.operators import ratings

    folder = str(tmp_path)
    spark.range(0, 60000, 1, 16).selectExpr(
        "id as order_id", "if(id % 3 = 0, 0, id % 5000 + 1) as user_id"
    ).write.parquet(f"{folder}/orders")
    spark.range(0, 90000, 1, 16).selectExpr(
        "if(id % 3 = 0, 6, pmod(xxhash64(id), 60000)) as order_id", "pmod(xxhash64(id, 1), 3000) as product_id"
    ).write.parquet(f"{folder}/lines")
    orders, lines = spark.read.parquet(f"{folder}/orders"), spark.read.parquet(f"{folder}/lines")
    expected = sorted(map(tuple, ratings.ratings(orders, lines).collect()))
    settings(
        {
            **HOT_SETTINGS,
            "spark.sql.files.maxPartitionBytes": "16k",
            "spark.sql.files.openCostInBytes": "16k",
        }
    )
    df = ratings.ratings(orders, lines)
    assert sorted(map(tuple, df.collect())) == expected
    assert df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin(skew=true)") == 2
