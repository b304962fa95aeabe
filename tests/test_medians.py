"""Exact medians: both ways agree, hot groups, weights, nothing runs while the plan is made."""

import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from obsforge.operators import ranking as R
from obsforge.operators import sampling as S
from obsforge.operators.quantiles import exact_median


def table(spark, seed, n=3000):
    rng = random.Random(seed)
    rows = [(rng.choice([None, "a", "b"]) if rng.random() < 0.1 else "hot", rng.choice([rng.gauss(0, 1), 5.0, -1e12, 1e12, None])) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "k STRING, v DOUBLE").repartition(5)


@pytest.mark.parametrize("seed", range(3))
def test_hot_and_ordinary_groups_agree_with_the_definition(spark, seed):
    rows, df = table(spark, seed)
    want = {k: statistics.median([v for x, v in rows if x == k and v is not None]) for k in {k for k, _ in rows}}
    one = {r["k"]: r["median"] for r in exact_median(df, ["k"], "v").collect()}
    two = {r["k"]: r["median"] for r in exact_median(df, ["k"], "v", hot=None).collect()}
    every = df.select("k").distinct()
    three = {r["k"]: r["median"] for r in exact_median(df, ["k"], "v", hot=every, buckets=7).collect()}
    assert one == want and two == want and three == want


def test_weights(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1), ("a", 9.0, 2)], "k STRING, v DOUBLE, n INT")
    for hot in (None, df.select("k").distinct()):
        assert exact_median(df, ["k"], "v", times="n", hot=hot).first()["median"] == 1.5


def test_no_job_before_the_action(spark):
    _, df = table(spark, 9, 50)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("medians", "plan only")
    out = exact_median(df.withColumn("v", F.col("v") + 1), ["k"], "v")
    assert list(tracker.getJobIdsForGroup("medians")) == []
    assert out.count() > 0


def test_no_job_before_the_action_of_global_orders(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("orders", "plan only")
    df = spark.range(500).select((F.col("id") * 7).alias("id"), F.when(F.col("id") % 3 == 0, "PRESENT").otherwise("ABSENT").alias("c"), F.lit("2020-01-01").cast("date").alias("d"))
    planned = [S.page(df, "d", "id", 8), S.balance_first(df, "id", "c"), S.cap_rows(df, "id", 10), R.running_totals(df.withColumn("v", F.lit(1)), "id", ["v"])]
    assert list(tracker.getJobIdsForGroup("orders")) == []
    assert [p.count() for p in planned] == [500, 334, 10, 500]


def framed_medians(samples, measured, frame):
    out = {}
    for k, place, day in samples:
        inside = [v for p, d, v in measured if p == place and p is not None and v is not None and day is not None and day + frame[0] <= d <= day + frame[1]]
        out[k] = statistics.median(inside) if inside else None
    return out


@pytest.mark.parametrize("bucket_rows", [1, 7, 10_000])
@pytest.mark.parametrize("frame", [(-7, 6), (-3, -1)])
def test_window_medians_in_buckets_match_the_definition(spark, monkeypatch, bucket_rows, frame):
    from datetime import date, timedelta

    from obsforge.operators import lags, window_median

    rng = random.Random(bucket_rows)
    start = date(2020, 1, 1)
    values = [rng.choice([5.0, 5.0, rng.gauss(0, 1), -1e12, 1e12, None]) for _ in range(900)]
    measured = [(rng.choice(["hot", "hot", "hot", "hot", "b", "c", None]), rng.randint(0, 60), v) for v in values]
    samples = [(k, rng.choice(["hot", "hot", "b", "c", "never", None]), rng.choice([rng.randint(0, 60), rng.randint(0, 60), None])) for k in range(150)]
    dated = lambda n: None if n is None else start + timedelta(days=n)
    left = spark.createDataFrame([(k, p, dated(d)) for k, p, d in samples], "id INT, place STRING, day DATE").repartition(3)
    right = spark.createDataFrame([(p, dated(d), v, -v if v is not None else None) for p, d, v in measured], "place STRING, ts DATE, v DOUBLE, w DOUBLE").repartition(4)
    plain = window_median.window_medians
    monkeypatch.setattr(lags, "window_medians", lambda *a: plain(*a, bucket_rows=bucket_rows))
    found = {r.id: (r.v_median, r.w_median) for r in lags.window_median(left, right, ["place"], "day", "ts", ["v", "w"], frame).collect()}
    want = framed_medians(samples, measured, frame)
    assert {k: a for k, (a, _) in found.items()} == want
    assert {k: b for k, (_, b) in found.items()} == {k: None if v is None else -v for k, v in want.items()}


def ran(df):
    """Nodes of the plan that ran; what an exchange was reused for is there once."""
    def walk(node):
        yield node
        name = node.nodeName()
        below = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else [node.children().apply(i) for i in range(node.children().size())]
        for child in below:
            yield from walk(child)

    return list(walk(df._jdf.queryExecution().executedPlan()))


def test_window_median_reads_each_table_twice_at_most(spark):
    """Exchanges over a scan that are equal are one at run time; orders are also read where results are attached."""
    import __spark_entry__ as entry

    plan = entry.queries()["window_median"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
    found = {"l_suppkey": set(), "o_custkey": set()}

    def walk(node, above):
        if node.nodeName() == "Exchange":
            above = re.sub(r"plan_id=\d+", "", node.canonicalized().toString())
        for column, exchanges in found.items():
            if node.nodeName().startswith("Scan") and column in node.output().mkString():
                exchanges.add(above)
        for i in range(node.children().size()):
            walk(node.children().apply(i), above)

    walk(plan.initialPlan(), None)
    assert len(found["l_suppkey"]) == 2 and len(found["o_custkey"]) == 2


def test_only_the_middle_bucket_of_a_dense_place_is_looked_at(spark):
    """The join of samples with values makes a small part of what all values of all frames would be."""
    from datetime import date, timedelta

    from obsforge.operators import window_median

    rows = spark.range(20_000).select(F.lit("x").alias("place"), F.expr("date_add(DATE'2020-01-01', CAST(id % 40 AS INT))").alias("ts"), (F.xxhash64("id") % 1_000_003).cast("double").alias("v"))
    wanted = spark.createDataFrame([("x", (date(2020, 1, 1) + timedelta(days=k) - date(1970, 1, 1)).days) for k in range(10, 30)], "place STRING, __day INT")
    df = window_median.window_medians(wanted, rows, ["place"], "ts", ["v"], (-7, 6), 200)
    assert df.count() == 20
    df.collect()
    whole = 20 * 20_000 * 14 // 40
    made = [n.metrics().apply("numOutputRows").value() for n in ran(df) if n.nodeName().endswith("Join") and n.metrics().contains("numOutputRows")]
    assert made and max(made) < max(25_000, whole / 5), made


def test_composites_of_wanted_cells_are_the_same_and_others_are_left_out(spark):
    from obsforge.operators.skew import sieved

    df = spark.range(20000).select((F.col("id") % 500).alias("cell_x"), (F.col("id") % 7).cast("int").alias("cell_y"), "id")
    wanted = spark.createDataFrame([(3, 3), (3, 3), (499, 1), (9999, 0), (None, 2)], "cell_x BIGINT, cell_y BIGINT")
    kept = sieved(df, wanted, ["cell_x", "cell_y"])
    named = (F.col("cell_x") == 3) & (F.col("cell_y") == 3) | (F.col("cell_x") == 499) & (F.col("cell_y") == 1)
    assert kept.where(named).count() == df.where(named).count() > 0
    assert kept.count() < df.count() / 100  # of 3,500 cells a few share a bucket at most


def test_values_of_a_dense_place_are_not_compared_with_every_cut(spark):
    """Each value was compared with all of up to 255 cuts, one by one, twice; now eight of them, once."""
    from obsforge.operators import window_median

    rows = [("x", "2020-01-%02d" % (k % 30 + 1), float(k * 7919 % 4999 // 2)) for k in range(5000)]
    wanted = spark.createDataFrame([("x", 18_270)], "place STRING, __day INT")  # 2020-01-09
    measured = spark.createDataFrame(rows, "place STRING, ts STRING, v DOUBLE").withColumn("ts", F.to_date("ts"))
    df = window_median.window_medians(wanted, measured, ["place"], "ts", ["v"], (-7, 6), 10)
    inside = [v for _, d, v in rows if "2020-01-02" <= d <= "2020-01-15"]
    assert [r["v_median"] for r in df.collect()] == [statistics.median(inside)]
    assert not re.search(r"lambda[^\n]*<= __value", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("query, rows_read", [("window_median", ("orders", "lineitem")), ("fine_indices", ("orders", "events", "events", "events"))])
def test_medians_at_sparse_places_send_each_row_through_few_shuffles(spark, query, rows_read):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    df = entry.queries()[query](spark, sf)
    df.collect()
    sent = sum(n.metrics().apply("shuffleRecordsWritten").value() for n in ran(df) if n.nodeName() == "Exchange" and n.metrics().contains("shuffleRecordsWritten"))
    read = sum(spark.read.parquet(f"{sf}/{t}.parquet").count() for t in rows_read)
    assert 0 < sent < 3 * read
