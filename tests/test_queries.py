"""Every registered query of the reference's operators beside its SQL."""

import os

import pytest
from oracle import SF_DIR, TABLES, compare
from pyspark.sql import functions as F

from tidemark.plans.oracles import ORACLE_SQL
from tidemark.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name])


def test_frequent_users_of_many(spark, tmp_path):
    """More users than the sketch tracks, each as often as others: events a hundred times, with shifted keys."""
    for t in set(TABLES) - {"events"}:
        os.symlink(f"{SF_DIR}/{t}.parquet", tmp_path / f"{t}.parquet")
    e = spark.read.parquet(f"{SF_DIR}/events.parquet").crossJoin(spark.range(100).toDF("copy"))
    e.withColumns({"event_id": F.col("event_id") + 10_000 * F.col("copy"), "user_id": F.col("user_id") + 150 * F.col("copy")}).drop("copy").write.parquet(f"{tmp_path}/events.parquet")
    compare(spark, QUERIES["frequent_users"], ORACLE_SQL["frequent_users"], str(tmp_path))


def test_layout_report(spark):
    got = QUERIES["layout_report"](spark, "/root/testdata/sf0.01").collect()
    assert {r.layout for r in got} == {"as_read", "sorted"} and {r.rows for r in got} == {60_000} and all(r.bytes > 0 for r in got)


@pytest.mark.parametrize("name", ["bucketed_join", "bucketed_star"])
def test_bucketed_facts_have_no_exchange(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.01")
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    assert not any(f"hashpartitioning({k}" in plan for k in ("l_orderkey", "o_orderkey", "m_orderkey")) and "Bucketed: true" in plan
    assert not [x.name for x in spark.catalog.listTables() if x.name.startswith("bucketed_")]


def test_funnel_does_not_join(spark):
    assert "Join" not in QUERIES["funnel_conversion"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
