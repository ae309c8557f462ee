from pathlib import Path

import pytest

from arcavec import queries as Q

DATA = Path("/root/testdata")
ORACLE = Q.oracle_sql()


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_gives_the_rows_of_its_sql(spark, same_rows, name):
    df = Q.queries()[name](spark, str(DATA / "sf0.001"))
    if name in ORACLE:
        same_rows(df, ORACLE[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_range_filter_reaches_the_scan(spark):
    from arcavec.operators import search

    v = spark.read.parquet(str(DATA / "sf0.001" / "embeddings.parquet"))
    plan = search.search_range(v, [0.1] * 64, 5, 3, 4, "label")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(label), GreaterThanOrEqual(label,3), LessThanOrEqual(label,4)" in plan
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
