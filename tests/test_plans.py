"""What the physical plans must and must not hold."""

import re

import pytest

from recordflow.operators import number
from recordflow.plans import QUERIES, changes, checks, reads, rollups, texts
from recordflow.plans.registry import Tables

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def names(module):
    return [n for n in QUERIES if QUERIES[n].__module__ == module.__name__]


@pytest.mark.parametrize("name", [n for m in (texts, reads, rollups, changes, checks)
                                  for n in names(m)])
def test_no_python_and_no_cartesian_product(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert not re.search("Python|ArrowEval|CartesianProduct", text)
    if name != "theta_join_small":
        assert "NestedLoop" not in text


@pytest.fixture(autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")


def test_filters_reach_the_scan(spark):
    text = plan(QUERIES["where_all"](spark, FOLDER))
    assert "EqualTo(o_orderstatus,F)" in text and "EqualTo(o_orderpriority,1-URGENT)" in text


def test_scans_read_only_what_is_used(spark):
    text = plan(QUERIES["project_columns"](spark, FOLDER))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in text
    text = plan(QUERIES["page_status_rollup"](spark, FOLDER))
    assert "struct<l_orderkey:bigint,l_returnflag:string,l_linestatus:string>" in text


def test_rollup_combines_before_the_shuffle(spark):
    text = plan(QUERIES["page_status_rollup"](spark, FOLDER))
    assert text.count("partial_bool_or") + text.count("partial_max") >= 1


def test_windows_never_hold_a_bare_key(spark):
    """Row windows run per (key, block); transitions are aggregates without any window."""
    t = Tables(spark, FOLDER)
    text = plan(number.numbered(t.orders, ["o_custkey"], "o_orderkey"))
    assert re.search(r"row_number\(\) windowspecdefinition\(o_custkey#\d+L?, _block#", text)
    text = plan(QUERIES["transitions"](spark, FOLDER))
    assert "Window" not in text and "partial_" in text


def test_tables_are_lazy(spark):
    t = Tables(spark, FOLDER)
    assert t.orders.columns[0] == "o_orderkey"


def test_rows_with_null_keys_do_not_meet_in_one_task(spark):
    from pyspark.sql import functions as F

    from recordflow.operators.join import left_unique

    settings = {"spark.sql.adaptive.enabled": "false",
                "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for kind in ("long", "int", "string"):
            df = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, F.col("id"))
                                          .cast(kind).alias("k"))
            side = spark.range(0, 4000, 20).select(F.col("id").cast(kind).alias("s"),
                                                   F.lit("x").alias("v"))
            out = left_unique(df, side, [("k", "s")], ["v"])
            sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
            assert len(sizes) == 4 and max(sizes) < 1400
            assert out.filter("v IS NOT NULL").count() == 200
            assert out.filter("v IS NOT NULL AND k IS NULL").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
