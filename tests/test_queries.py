"""Every registered query of the core against its SQL, on the smallest tables."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.plans import api_queries, pipeline_queries, pipeline_sql, table_queries
from tests.helpers import duck, rows

QUERIES = {**table_queries.QUERIES, **api_queries.QUERIES, **pipeline_queries.QUERIES}
SQL = {**table_queries.SQL, **api_queries.SQL, **pipeline_sql.SQL}


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, con, name):
    assert rows(QUERIES[name](spark, data).toPandas()) == rows(con.execute(SQL[name]).df())


def test_every_sql_has_its_query():
    assert not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, data, name):
    assert QUERIES[name](spark, data).columns


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


LINES = "l_orderkey long, l_extendedprice double"


def test_approximate_aggregates_keep_no_sketch_per_key(spark, data):
    # next to a distinct count each of the keys had its own sketches: at 36 million lines the query did not end
    plan = QUERIES["agg_approximate"](spark, data)._jdf.queryExecution().executedPlan().toString()
    keyed = [line for line in plan.splitlines() if "Aggregate(key=[l_orderkey" in line or "Aggregate(keys=[l_orderkey" in line]
    assert keyed and not [line for line in keyed if "approx" in line or "percentile" in line]


@pytest.mark.parametrize("lines", [[], [(None, None)], [(1, 0.0), (1, 0.0), (2, 0.0)], [(1, -5.0), (None, -5.0), (3, None)]])
def test_approximate_aggregates_of_odd_tables(spark, tmp_path, lines):
    spark.createDataFrame(lines, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in QUERIES["agg_approximate"](spark, str(tmp_path)).collect()] == [(True, True)]


def test_median_whatever_the_guesses(spark):
    rng = random.Random(1)
    for values in ([], [None], [3.0], [1.0, 2.0], [2.0, 2.0, None, 7.0], [1.0, 1.0, 9.0, 9.0], [float("nan"), 1.0, -1.0], [round(rng.gauss(0, 5), 1) for _ in range(500)]):
        df = spark.createDataFrame([(v,) for v in values], "x double").cache()
        exact = df.agg(F.percentile("x", 0.5)).first()[0]
        for low, high in ((None, None), (-0.5, 0.5), (1.0, 1.0), (1.0, 2.0), (100.0, 200.0), (-200.0, -100.0), (float("nan"), float("nan"))):
            assert table_queries._median(df, "x", low, high).first()[0] == exact, (values[:5], low, high)
        df.unpersist()
