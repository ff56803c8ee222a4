import pytest

from dagql import catalog
from tests.oracle import assert_same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_its_sql(spark, name):
    assert_same(catalog.queries()[name](spark, FOLDER), catalog.oracle_sql()[name], FOLDER)


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.queries()["btree_point"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,37)" in plan.replace(" ", "") or "GreaterThanOrEqual(o_custkey,37)" in plan.replace(" ", "")
    assert "o_totalprice" not in plan


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    d = e.entry(spark)
    assert d.columns == ["c_mktsegment", "n_orders"] and d.count() > 0
    assert set(catalog.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_entry_works_without_the_training_data_operators():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; from dagql import catalog; assert set(e.queries()) == set(catalog.queries()) and set(e.oracle_sql()) == set(catalog.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1], timeout=120)
