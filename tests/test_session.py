import os

import pytest

from basketry import session


def test_scratch_scope_holds_what_is_written_inside(spark):
    frame = spark.range(10)
    outside = session.scratch_path(spark, "a")
    with session.scratch_scope(spark, "work") as folder:
        made = session.materialize(frame, "numbers")
        assert session.scratch_path(spark, "b").startswith(folder + "/")
        with session.scratch_scope(spark, "inner") as inner:
            assert inner.startswith(folder + "/")
    assert os.path.dirname(session.scratch_path(spark, "c")) == os.path.dirname(outside)
    assert made.count() == 10 and os.listdir(folder)
    session.drop_path(spark, folder)
    assert not os.path.exists(folder)
    with pytest.raises(ValueError):
        session.drop_path(spark, os.path.dirname(os.path.dirname(outside)))


def test_a_task_reads_no_more_when_tables_grow(spark):
    """partitions are joined, and files cut, at sizes that fit the memory of a task; others' settings stay."""
    before = {key: spark.conf.get(key) for key in session.TASK_BYTES}
    try:
        for key in before:
            spark.conf.unset(key)
        session.tune(spark)
        assert {key: spark.conf.get(key) for key in before} == {key: small for key, (_, small) in session.TASK_BYTES.items()}
        for key in before:
            spark.conf.set(key, "1m")
        session.tune(spark)
        assert {spark.conf.get(key) for key in before} == {"1m"}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
