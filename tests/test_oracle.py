"""Oracle parity at sf0.01, as the driver checks it: every registered query
against its DuckDB twin (row count, column names, value hash)."""

import os

import pytest

import __spark_entry__ as E
from harness import compare, duck
from moodgauge.plans.catalog import QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
# the queries of moodgauge/llm are tested in tests/llm
NAMES = sorted(set(E.oracle_sql()) & set(QUERIES))


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_twin_or_is_declared_rows_only():
    assert set(QUERIES) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_parity(spark, con, name):
    a, b = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert a[0] == b[0], "column names differ"
    assert a[1] == b[1], "row counts differ"
    if a[2] != b[2]:
        diff = sorted(set(a[3]) ^ set(b[3]))[:4]
        pytest.fail(f"values differ, e.g. {diff}")


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["report_group", "day", "n_posts", "score_mean", "score_std",
                          "score_var", "score_median", "score_std_roll"]
