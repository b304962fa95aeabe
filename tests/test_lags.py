"""Windows on hand-made tables: edges, empty windows, hot places."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from obsforge.functions.indices import ndwi_proxy
from obsforge.operators import lags as L
from obsforge.operators.quantiles import exact_median

D = dt.date(2020, 6, 1)


def back(n: int) -> dt.date:
    return D - dt.timedelta(days=n)


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(1, "a", D), (2, "b", D), (3, "a", back(200))], "object_id BIGINT, place STRING, day DATE")


@pytest.fixture(scope="module")
def measured(spark):
    rows = [("a", back(n), float(v)) for n, v in ((0, 1), (1, 2), (30, 4), (31, 8), (60, 16), (61, 32), (90, 64), (91, 128))]
    return spark.createDataFrame(rows, "place STRING, ts DATE, value DOUBLE")


def bands(reducer="sum"):
    return [L.Band("v", F.lit(True), F.col("value"), reducer)]


def rows(df):
    return {r["object_id"]: r.asDict() for r in df.collect()}


def test_edges_of_cumulative_windows(samples, measured):
    out = rows(L.lag_features(samples, measured, ["place"], "day", "ts", bands()))
    assert (out[1]["v_30"], out[1]["v_60"], out[1]["v_90"]) == (6.0, 30.0, 126.0)  # day itself and day 91 stay out


def test_empty_windows(samples, measured):
    zero = rows(L.lag_features(samples, measured, ["place"], "day", "ts", bands(), keep_counts=True))
    assert zero[2]["v_30"] == 0.0 and zero[2]["n_v_30"] == 0 and zero[3]["v_90"] == 0.0
    null = rows(L.lag_features(samples, measured, ["place"], "day", "ts", bands(), on_missing="null"))
    assert null[2]["v_30"] is None
    dropped = rows(L.lag_features(samples, measured, ["place"], "day", "ts", bands(), on_missing="drop"))
    assert set(dropped) == {1}


def test_a_measured_null_is_not_a_measurement(spark, samples):
    measured = spark.createDataFrame([("a", back(5), None)], "place STRING, ts DATE, value DOUBLE")
    out = rows(L.lag_features(samples, measured, ["place"], "day", "ts", bands("mean"), keep_counts=True))
    assert out[1]["n_v_30"] == 0 and out[1]["v_30"] == 0.0


def test_disjoint_periods_add_up(samples, measured):
    counts = [L.Band("n", F.lit(True), F.col("value"), "count")]
    parts = rows(L.disjoint_counts(samples, measured, ["place"], "day", "ts", counts))[1]
    whole = rows(L.lag_features(samples, measured, ["place"], "day", "ts", counts))[1]
    assert (parts["n_30"], parts["n_60"], parts["n_90"]) == (2, 2, 2)
    assert sum(parts[f"n_{p}"] for p in ("30", "60", "90")) == whole["n_90"]


def test_hot_place_and_day_keep_every_sample(spark, measured):
    hot = spark.range(3000).select(
        F.col("id").alias("object_id"),
        F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("p"), F.col("id"))).alias("place"),
        F.lit(D).alias("day"),
    )
    out = L.lag_features(hot, measured, ["place"], "day", "ts", bands())
    assert out.count() == 3000 and out.select("object_id").distinct().count() == 3000
    assert out.where("v_90 = 126.0").count() == 1000


def test_missing_list_and_gate(spark):
    df = spark.createDataFrame([(1, 0, 2), (2, 3, 0), (3, 1, 1)], "object_id BIGINT, n_a INT, n_b INT")
    listed = df.withColumn("m", L.missing_list({"A": F.col("n_a"), "B": F.col("n_b")}))
    out = rows(
        listed.select("object_id", "m", L.critical_gate(F.col("m"), ["A"]).alias("g"), L.critical_gate(F.col("m"), ["X"], most=0).alias("many"))
    )
    assert (out[1]["m"], out[1]["g"], out[1]["many"]) == (["A"], True, True)
    assert (out[2]["m"], out[2]["g"]) == (["B"], False)
    assert (out[3]["m"], out[3]["many"]) == ([], False)


def test_proxy_of_two_empty_inputs_is_one_half(spark):
    assert spark.range(1).select(ndwi_proxy(F.lit(0.0), F.lit(0.0)).alias("x")).first()["x"] == 0.5


def test_best_scene_ties_and_edges(spark):
    samples = spark.createDataFrame([(1, "a", D), (2, "z", D)], "object_id BIGINT, place STRING, day DATE")
    scenes = spark.createDataFrame(
        [(9, "a", back(15), 5.0), (7, "a", back(-14), 5.0), (1, "a", back(-15), 0.0), (2, "a", back(16), 0.0)],
        "scene_id BIGINT, place STRING, ts DATE, cloud DOUBLE",
    )
    out = rows(L.best_in_window(samples, scenes, ["place"], "day", "ts", ["cloud", "scene_id"], []))
    assert out[1]["best"]["scene_id"] == 7 and out[2]["best"] is None


def test_window_median_counts_repeats(spark, samples):
    measured = spark.createDataFrame([("a", back(n), v) for n, v in ((1, 1.0), (1, 1.0), (2, 2.0), (3, 10.0))], "place STRING, ts DATE, value DOUBLE")
    out = rows(L.window_median(samples, measured, ["place"], "day", "ts", ["value"], (-7, 6)))
    assert out[1]["value_median"] == 1.5 and out[2]["value_median"] is None


def test_exact_median_of_a_hot_group(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500 + 1).alias("k"),
        (F.xxhash64("id") % 100000).cast("double").alias("v"),
    )
    ours = {r["k"]: r["median"] for r in exact_median(df, ["k"], "v").collect()}
    plain = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert ours == plain


def test_windows_are_worked_out_for_wanted_days_only(spark, samples, measured):
    out = L.lag_features(samples, measured, ["place"], "day", "ts", bands())
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()  # a window would add a frame for each measured day
    assert rows(out)[1]["v_90"] == 126.0
