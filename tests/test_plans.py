"""What the plans must not contain, and what must reach the scans."""

import re

import pytest

from __spark_entry__ import queries

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["training_table", "context_counts", "lag_features", "best_scene", "pseudo_absence", "points_in_polygon", "within_distance",
             "split_60_20_20", "running_index", "glcm_texture", "bilinear_resize", "curve_points", "balance_random"],
)
def test_no_pairing_of_whole_tables_and_no_python(spark, name):
    text = plan(queries()[name](spark, SMALL))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert node not in text, node


def test_filters_and_columns_reach_the_scan(spark):
    from obsforge.operators.cleaning import filter_observations
    from pyspark.sql import functions as F

    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    df = filter_observations(
        orders, day="o_orderdate", presence="o_orderstatus", start="1997-01-01", min_year=1998, classes=["F"]
    ).select("o_orderkey")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    assert "EqualTo(o_orderstatus,F)" in pushed or "In(o_orderstatus" in pushed
    assert "GreaterThanOrEqual(o_orderdate" in pushed
    assert "o_totalprice" not in re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert df.where(F.col("o_orderkey").isNull()).count() == 0


def test_chained_lookups_read_the_left_side_once(spark):
    from obsforge.operators.skew import splittable_join

    base = spark.read.parquet(f"{SMALL}/orders.parquet")
    side = spark.range(100).withColumnRenamed("id", "o_custkey")
    df = base
    scans = []
    for i in range(4):
        df = splittable_join(df, side.selectExpr("o_custkey", f"o_custkey AS v{i}"), ["o_custkey"])
        scans.append(plan(df).count("Scan parquet"))
    assert len({b - a for a, b in zip(scans, scans[1:])}) == 1  # each lookup adds the same number of scans
    assert df.count() == base.count()
