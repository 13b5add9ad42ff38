"""The queries of the subpackage that have SQL, against it, and the contract of the others' columns."""

import pytest

import __spark_entry__ as registry
from basketry.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    import compare

    base = "/root/testdata/sf0.01"
    same, note = compare.compare(spark, compare.database(base), name, base)
    assert same, note


def test_names():
    assert set(queries.QUERIES) | {"pipeline"} <= set(registry.queries())
    numbers = sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES)
    assert numbers == list(range(1, len(numbers) + 1))
