"""Exact sizes, disjoint parts, unchanged under repartitioning."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from obsforge.operators import ranking as R
from obsforge.operators import sampling as S


def observations(spark, n, every=3):
    return spark.range(n).select(
        (F.col("id") * 7 + 5).alias("object_id"),
        F.when(F.col("id") % every == 0, "PRESENT").otherwise("ABSENT").alias("presence"),
        F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % 2).cast("int")).alias("day"),
    )


def ids(df):
    return sorted(r["object_id"] for r in df.select("object_id").collect())


def test_balance_first_takes_the_smallest_ids(spark):
    df = observations(spark, 100)
    out = S.balance_first(df, "object_id", "presence", most=21)
    assert ids(out.where("presence = 'PRESENT'")) == [i * 7 + 5 for i in range(0, 30, 3)]
    assert out.count() == 20
    assert S.balance_first(df, "object_id", "presence").count() == 68  # 34 of each


def test_balance_with_one_class_is_empty(spark):
    df = observations(spark, 30).where("presence = 'ABSENT'")
    assert S.balance_first(df, "object_id", "presence").count() == 0
    assert S.balance_random(df, "object_id", "presence").count() == 0


def test_split_is_exact_disjoint_and_independent_of_partitioning(spark):
    df = observations(spark, 101)
    a = {r["object_id"]: r["split"] for r in S.split_exact(df, "object_id", (0.6, 0.2), 1).collect()}
    b = {r["object_id"]: r["split"] for r in S.split_exact(df.repartition(7), "object_id", (0.6, 0.2), 1).collect()}
    assert a == b and len(a) == 101
    assert [list(a.values()).count(s) for s in ("train", "val", "test")] == [60, 20, 21]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(0, 60), k=st.integers(0, 70))
def test_sample_n_has_exactly_n(spark, n, k):
    assert S.sample_n(observations(spark, n), "object_id", k).count() == min(n, k)


def test_index_with_one_hot_day(spark):
    df = observations(spark, 500).withColumn("day", F.when(F.col("object_id") % 2 == 0, F.col("day")))
    out = {r["object_id"]: r["index"] for r in R.global_index(df, "day", "object_id", rows_per_bucket=8).collect()}
    rows = sorted(((r["day"] or dt.date(9999, 1, 1)), r["object_id"]) for r in df.collect())
    assert out == {i: k for k, (_, i) in enumerate(rows)}


def test_pages_lose_no_row(spark):
    out = S.page(observations(spark, 33), "day", "object_id", 8)
    assert [r["count"] for r in out.groupBy("batch").count().orderBy("batch").collect()] == [8, 8, 8, 8, 1]


def test_running_totals_both_ways(spark):
    df = spark.range(200).select((F.col("id") * F.col("id") % 1009).alias("k")).distinct().withColumn("v", F.col("k") % 5)
    values = sorted((r["k"], r["v"]) for r in df.collect())
    for descending in (False, True):
        out = {r["k"]: r["v_cum"] for r in R.running_totals(df, "k", ["v"], descending, rows_per_bucket=6).collect()}
        total, expected = 0, {}
        for k, v in reversed(values) if descending else values:
            total += v
            expected[k] = total
        assert out == expected


@pytest.mark.parametrize("spread", ["far", "clustered", "powers", "ties"])
def test_parts_are_even_however_ids_are_spread(spark, spread):
    n, rows = 400_000, 50_000
    ids = {
        "far": F.when(F.col("id") == 0, F.lit(10**18)).otherwise(F.col("id")),
        "clustered": F.col("id") % 7 * 10**12 + F.col("id"),
        "powers": F.expr("shiftleft(1L, CAST(id % 60 AS INT)) + id div 60"),
        "ties": F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") - 1),
    }[spread]
    df = spark.range(n).select(ids.cast("bigint").alias("k"))
    parts = R.with_part(df, "k", rows, "b").groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("low"), F.max("k").alias("high")).orderBy("b").collect()
    assert max(p["n"] for p in parts) <= 2 * rows and len(parts) >= n // rows // 2
    assert all(a["high"] < b["low"] for a, b in zip(parts, parts[1:]))


def test_few_scans_for_limits_per_class(spark):
    from __spark_entry__ import queries

    for name, most in (("balance_first", 20 * 3), ("split_60_20_20", 20 * 3)):  # three tables make the observations
        df = queries()[name](spark, "/root/testdata/sf0.001")
        text = df._jdf.queryExecution().executedPlan().toString()
        assert 0 < text.count("FileScan") <= most, (name, text.count("FileScan"))
        assert df.count() > 0


def test_index_and_balance_with_null_and_extreme_ids(spark):
    rows = [(k, "PRESENT" if k % 3 else "ABSENT") for k in [5, 1, 10**18, -(10**18), 0, 7, 8, 9]]
    df = spark.createDataFrame(rows, "id BIGINT, c STRING").withColumn("d", F.lit("2020-01-01").cast("date"))
    out = [r["id"] for r in R.global_index(df, "d", "id", rows_per_bucket=2).orderBy("index").collect()]
    assert out == sorted(k for k, _ in rows)
    kept = {r["id"] for r in S.balance_first(df, "id", "c").collect()}
    few = min(sum(c == "PRESENT" for _, c in rows), sum(c == "ABSENT" for _, c in rows))
    assert kept == {k for c in ("PRESENT", "ABSENT") for k in sorted(i for i, x in rows if x == c)[:few]}


@pytest.mark.parametrize("rows", [1, 7, 50_000])
def test_running_fold_of_a_merge_that_does_not_commute(spark, monkeypatch, rows):
    monkeypatch.setattr(R, "FOLDED", 3)
    ids = [5, -1, 10**15, 3, 8, 0, 77, 12, 13, 14, 15, 16, 99, 40]
    df = spark.createDataFrame([(k, f"<{k}>", "x") for k in ids], "id BIGINT, text STRING, row STRING").repartition(3)
    out = {r["id"]: r["all"] for r in R.running_fold(df, "id", F.col("text"), "string", lambda a, b: F.concat(a, b), "all", rows).collect()}
    assert out == {k: "".join(f"<{i}>" for i in sorted(ids) if i <= k) for k in ids}
    assert R.running_fold(df.where("false"), "id", F.col("text"), "string", lambda a, b: F.concat(a, b)).count() == 0
