"""Every registered query with a SQL statement agrees with DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as E
from tools.check_oracle import duck, frame_hash, types_match
from vesselflow.plans import catalog

from .conftest import SF001

SQL = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    df = E.queries()[name](spark, SF001)
    cols = df.columns
    got = [tuple(r) for r in df.collect()]
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    dcols, drows, dtypes = duck(SF001, SQL[name], with_types=True)
    assert sorted(cols) == sorted(dcols)
    assert types_match(df, dcols, dtypes) == {}
    assert len(got) == len(drows)
    assert frame_hash(cols, got) == frame_hash(dcols, drows)


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(SQL)))
def test_model_queries_run(spark, name):
    df = E.queries()[name](spark, SF001)
    assert df.count() > 0


def test_every_query_has_sql_or_is_a_model():
    rows_only = set(catalog.QUERIES) - set(SQL)         # the training-data queries have their own tests in tests/llm
    assert set(catalog.QUERIES) <= set(E.queries())
    assert rows_only <= {"m05_bayesian_impact", "m06b_bayesian_summary", "m07_gamma_trend"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["year", "month", "vessel_name", "zone", "hrs"]
    assert df.count() > 0
