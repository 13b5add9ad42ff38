"""Every registered query against its SQL, and the plans of the main ones."""

import glob
import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as registry
from basketry.plans import evaluation, queries
from basketry.sources import retail

NO_SQL = {"ratings_random_sample", "ratings_random_split", "cells_topk", "cells_recall", "bounded_share"}


@pytest.fixture(scope="module")
def con(base):
    import compare

    return compare.database(base)


def test_names():
    assert set(queries.QUERIES) - set(registry.oracle_sql()) == NO_SQL
    assert set(queries.QUERIES) <= set(registry.queries())
    assert not set(registry.oracle_sql()) - set(registry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def no_cross_join(df):
    text = plan(df)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, base, name):
    import compare

    same, note = compare.compare(spark, con, name, base, no_cross_join)
    assert same is not False, note


def test_entry(spark):
    row = registry.entry(spark).first()
    assert row.k == 5 and row.users > 0 and 0 <= row.map_at_k <= 1


def test_ratings_stay_in_the_engine(spark, base):
    text = plan(queries.QUERIES["user_ratings"](spark, base))
    assert "Python" not in text and "ArrowEval" not in text
    assert "IsNotNull(l_orderkey)" in text.split("PushedFilters: ", 1)[1].split("]")[0]
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in text


def test_selections_are_cut_before_the_shuffle(spark, base):
    text = plan(evaluation.held_out_selections(*queries._order_tables(spark, base)))
    assert text.count("WindowGroupLimit") == 2 and "Python" not in text


def test_top_transitions_are_cut_before_the_shuffle(spark, base):
    text = plan(queries.QUERIES["transition_topk"](spark, base))
    assert text.count("WindowGroupLimit") == 2


def test_search_does_not_shuffle_the_index_for_few_queries(spark, base):
    text = plan(queries.QUERIES["embedding_topk"](spark, base))
    below = text[text.index("MapInArrow") :]
    assert "Exchange" not in below


def test_joins_by_hash_when_nothing_is_small(spark, base):
    """Without broadcasts, as on large tables, results stay the same."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    run = lambda: sorted(map(str, queries.QUERIES["map_by_name"](spark, base).collect()))
    small = run()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert run() == small
        text = plan(evaluation.held_out_selections(*queries._order_tables(spark, base)))
        assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_no_banned_calls():
    root = os.path.dirname(os.path.abspath(registry.__file__))
    for path in glob.glob(f"{root}/basketry/**/*.py", recursive=True):
        text = open(path).read()
        for word in ("localCheckpoint", "crossJoin", ".rdd", ".toPandas("):
            assert word not in text, (path, word)


def test_bench_prints_one_json_line(base):
    import json

    root = os.path.dirname(os.path.abspath(registry.__file__))
    env = {**os.environ, "BENCH_SF_DIR": base, "BENCH_CPUS": "2", "BENCH_QUERIES": "purchase_events"}
    out = subprocess.run([sys.executable, f"{root}/bench.py"], env=env, capture_output=True, text=True, timeout=300)
    line = json.loads(out.stdout.strip().splitlines()[-1])
    assert line["unit"] == "sec" and line["sf"] == "0.001" and set(line["queries"]) == {"purchase_events"}


def test_entry_without_the_subpackage(tmp_path):
    """Nothing of the main part needs the operators for training data."""
    root = os.path.dirname(os.path.abspath(registry.__file__))
    gone = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__")
    shutil.copytree(root, tmp_path / "copy", ignore=gone)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.QUERIES), set(e.oracle_sql()) <= set(e.QUERIES))"
    run = [sys.executable, "-c", code]
    out = subprocess.run(run, cwd=tmp_path / "copy", env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["True", "True"], out.stderr


def test_sequences_are_a_table_of_the_right_size(spark, base):
    truth = queries._id_truth(spark, base)
    out = queries._sequences(spark, base, truth)
    assert out.count() == truth.count()
    assert retail.plain_orders(spark, base).count() == 1500
