import pytest
from check import compare, duck

import __spark_entry__ as entry

def own(known):
    """The library's own queries; those of its subpackage are tested in a folder of their own."""
    return {k: v for k, v in known.items() if not k.startswith("op") and k != "pipeline"}


QUERIES, ORACLES = own(entry.queries()), own(entry.oracle_sql())


@pytest.fixture(scope="module")
def con(sf):
    pytest.importorskip("duckdb")
    return duck(sf)


def test_every_statement_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, sf, name):
    got, want, *_ = compare(spark, con, sf, QUERIES[name], ORACLES[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 200 and "extractive_coverage" in df.columns
