"""Every query of the engine against its SQL."""

import duckdb
import pytest

from sedimenta.queries import oracle_sql, queries

from .oracle import compare

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name):
    compare(spark, queries()[name], oracle_sql()[name], SF)


def test_int_to_float_casts_run_on_all_rows(spark):
    out = queries()["cast_int_to_float_all"](spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/events.parquet").count()
    assert 0 < out.filter("b is null").count() < out.count()  # both exact and inexact values


@pytest.mark.parametrize("name", ["sort_multi_all", "sort_nulls_all"])
def test_whole_sorts_keep_their_order(spark, name):
    df = queries()[name](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = con.execute(oracle_sql()[name]).fetchall()
    assert [tuple(r) for r in df.collect()] == want and len(want) == spark.read.parquet(f"{SF}/events.parquet").count()
    assert "TakeOrdered" not in df._jdf.queryExecution().executedPlan().toString()


def test_literals_are_evaluated_on_all_rows(spark):
    assert queries()["project_literals_all"](spark, SF).first()["n"] == spark.read.parquet(f"{SF}/events.parquet").count()
