import pytest

from gleanwork import queries

from .conftest import SF, rows_of


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_oracle(spark, oracle, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.SQL:
        want = oracle(queries.SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["irr_kappa", "cleaning_grid", "latest_per_key", "locate_exact", "form_coverage"])
def test_no_python_and_no_cartesian_in_plans(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "InPandas" not in plan
