"""Sources and sinks."""

import pytest
from pyspark.errors import PySparkException

from basketry.sources import readers, schemas, sinks


def test_csv_with_declared_schema(spark, tmp_path):
    rows = [(1, 7, 1, 0), (1, 8, 2, 1)]
    df = spark.createDataFrame(rows, schemas.ORDER_PRODUCTS)
    for name in ("prior", "train"):
        sinks.write_csv(df, str(tmp_path / name))
    both = readers.read_order_products(spark, [str(tmp_path / "prior"), str(tmp_path / "train")])
    assert both.schema == schemas.ORDER_PRODUCTS and both.count() == 4
    assert readers.union_order_products(df, df).count() == 4


def test_csv_with_an_index_column_fails(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text(",order_id,product_id,add_to_cart_order,reordered\n0,1,7,1,0\n")
    with pytest.raises(Exception, match="Number of column in CSV header"):
        readers.read_order_products(spark, str(path)).collect()


def test_all_csv_readers(spark, tmp_path):
    for read, schema in (
        (readers.read_orders, schemas.ORDERS),
        (readers.read_products, schemas.PRODUCTS),
        (readers.read_departments, schemas.DEPARTMENTS),
        (readers.read_aisles, schemas.AISLES),
    ):
        path = tmp_path / f"{read.__name__}.csv"
        path.write_text(",".join(schema.fieldNames()) + "\n" + ",".join("1" for _ in schema) + "\n")
        df = read(spark, str(path))
        assert df.schema == schema and df.count() == 1


def test_text_dataset(spark, tmp_path):
    df = spark.createDataFrame([(1, "a, b"), (2, "c")], schemas.PRODUCT_DESCRIPTIONS)
    for fmt in ("parquet", "json", "csv"):
        path = str(tmp_path / fmt)
        writer = df.write.option("header", True) if fmt == "csv" else df.write
        writer.format(fmt).save(path)
        got = readers.read_text_dataset(spark, path, fmt, schemas.PRODUCT_DESCRIPTIONS)
        assert sorted(map(tuple, got.collect())) == [(1, "a, b"), (2, "c")]


def test_tables_and_views(spark):
    sinks.use_database(spark, "shop")
    try:
        one = spark.createDataFrame([(1, "a")], "id long, text string")
        sinks.create_table(one, "items")
        with pytest.raises(PySparkException):
            sinks.create_table(one, "items")
        sinks.overwrite_table(spark.createDataFrame([(1.5,)], "price double"), "items")
        assert readers.read_table(spark, "items").columns == ["price"]
        sinks.replace_view(one, "seen")
        sinks.replace_view(one.union(one), "seen")
        assert readers.read_table(spark, "seen").count() == 2
        assert {"items", "seen"} <= {r.tableName for r in readers.list_tables(spark).collect()}
        assert "items" in {r.tableName for r in readers.list_tables(spark, "shop").collect()}
        sinks.drop_table(spark, "items")
        sinks.drop_table(spark, "items")
        assert "items" not in {r.tableName for r in readers.list_tables(spark).collect()}
    finally:
        spark.sql("USE default")


def test_bucketed_tables_join_without_a_shuffle(spark, base):
    from basketry.sources import retail

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sinks.overwrite_table(retail.plain_orders(spark, base), "b_orders", buckets=(4, "order_id"))
        sinks.overwrite_table(retail.line_pairs(spark, base), "b_lines", buckets=(4, "order_id"))
        joined = spark.table("b_orders").join(spark.table("b_lines"), "order_id")
        text = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "Exchange" not in text
        assert joined.count() == retail.line_pairs(spark, base).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        for name in ("b_orders", "b_lines"):
            sinks.drop_table(spark, name)


def test_projections(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "product_id int, product_name string")
    assert readers.as_catalogue(df).columns == ["id", "product"]
    assert readers.product_by_id(df, 2).first().product_name == "b"
    assert readers.preview(df, 1).count() == 1


def test_shared_folder_is_the_sessions(spark):
    from basketry.session import scratch_path, shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_bad_rows_are_routed(spark, tmp_path):
    path = tmp_path / "aisles.csv"
    path.write_text('aisle_id,aisle\n1,tea\nx,coffee\n2\n3,rice,4\n"5","a, b"\n,no id\n')
    good, bad = readers.read_csv_routed(spark, str(path), schemas.AISLES)
    assert sorted((r.aisle_id or 0, r.aisle) for r in good.collect()) == [(0, "no id"), (1, "tea"), (5, "a, b")]
    assert sorted(r.text for r in bad.collect()) == ["2", "3,rice,4", "x,coffee"]
    assert all(r.file.endswith("aisles.csv") for r in bad.collect())
    other = tmp_path / "other.csv"
    other.write_text("aisle_id,name\n1,tea\n")
    with pytest.raises(Exception, match="CSV header"):
        readers.read_csv_routed(spark, str(other), schemas.AISLES)
    assert bad.count() + good.count() == 6


def test_colocated_ratings_move_no_line_for_the_join(spark, base, tmp_path):
    from basketry.operators import ratings
    from basketry.plans import queries

    orders, lines, products = queries._order_tables(spark, base)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for name, frame in (("co_orders", orders), ("co_lines", lines)):
            sinks.overwrite_table(frame, name, path=str(tmp_path / name), buckets=(4, "order_id"))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rated = ratings.colocated_ratings(spark.table("co_orders"), spark.table("co_lines"), products)
        plan = rated._jdf.queryExecution().executedPlan().toString()
        lowest = plan[: plan.index("co_lines")].rindex("SortMergeJoin")
        assert "Exchange" not in plan[lowest : plan.index("co_lines")] and "order_id" in plan[lowest:].split("\n")[0]
        assert "Bucketed: true" in plan
        want = ratings.ratings(orders, lines, products)
        assert sorted(map(tuple, rated.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        for name in ("co_orders", "co_lines"):
            sinks.drop_table(spark, name)


def test_long_lists_are_scored_in_chunks(spark):
    from pyspark.sql import functions as F

    from basketry.functions import metrics

    n = 1_000_000
    rows = spark.range(n).select(
        F.lit(1).alias("user_id"), (F.col("id") + 1).alias("rank"), (F.col("id") % 3 == 0).cast("int").alias("rel")
    )
    few = spark.createDataFrame([(2, 1, 0), (2, 2, 1), (3, 1, 0)], "user_id int, rank long, rel int")
    scored = metrics.average_precision_long(rows.unionByName(few), chunk=10_000)
    got = {r.user_id: (r.ap, r.hits) for r in scored.collect()}
    hits = range(0, n, 3)
    want = sum((k + 1) / (i + 1) for k, i in enumerate(hits)) / len(hits)
    assert got[1] == (pytest.approx(want), len(hits)) and got[2] == (0.5, 1) and got[3] == (0.0, 0)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_chunk") > 0


@pytest.mark.parametrize("chunk", [1, 2, 100])
def test_long_and_array_forms_agree(spark, chunk):
    import random

    from pyspark.sql import functions as F

    from basketry.functions import metrics

    rng = random.Random(chunk)
    lists = [(u, [rng.randrange(6) for _ in range(rng.randint(1, 9))], [rng.randrange(6) for _ in range(rng.randint(1, 4))]) for u in range(40)]
    frame = spark.createDataFrame(lists, "user_id long, recs array<int>, truth array<int>")
    arrays = frame.withColumn("rel", metrics.binary_relevance("recs", "truth")).select("user_id", metrics.average_precision("rel").alias("ap"))
    recommended = frame.select("user_id", F.posexplode("recs").alias("rank", "item")).withColumn("rank", F.col("rank") + 1)
    hits = metrics.long_relevance(recommended, frame.select("user_id", F.explode("truth").alias("item")))
    got = {r.user_id: r.ap for r in metrics.average_precision_long(hits, chunk=chunk).collect()}
    assert got == pytest.approx({r.user_id: r.ap for r in arrays.collect()})


def test_buckets_grow_with_the_lines(spark, base, monkeypatch):
    """a task of the join by buckets reads no more rows when the tables grow."""
    from basketry.plans import queries

    made, create = [], queries.sinks.create_table
    monkeypatch.setattr(queries.sinks, "create_table", lambda df, name, **o: (made.append(o["buckets"][0]), create(df, name, **o)))
    want = sorted(map(tuple, queries.QUERIES["user_ratings"](spark, base).collect()))
    assert sorted(map(tuple, queries.QUERIES["ratings_colocated"](spark, base).collect())) == want
    lines = queries.retail.line_pairs(spark, base).count()
    monkeypatch.setattr(queries.sinks, "BUCKET_ROWS", lines // 20)
    assert sorted(map(tuple, queries.QUERIES["ratings_colocated"](spark, base).collect())) == want
    assert made[:2] == [8, 8] and set(made[2:]) == {-(-lines // (lines // 20))}
