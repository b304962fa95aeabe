"""Ends of the domains: long ids, the 180th meridian and the poles, repeated ids, time zones."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsforge.functions import names as N
from obsforge.functions.dates import day_number
from obsforge.operators import sampling as S
from obsforge.operators import spatial as P
from obsforge.operators.cleaning import in_days
from obsforge.session import shared_dir


def test_long_numbers_in_names(spark):
    rows = [("a_label_1234567890_idx_1234567890123456789.tif",), ("a_label_2147483647_idx_99999999999999999999.tif",), ("a_label_-1_idx_x.tif",)]
    df = spark.createDataFrame(rows, "name STRING")
    out = df.select(N.index_from_name(F.col("name")).alias("i"), N.label_from_name(F.col("name")).alias("l")).collect()
    assert [tuple(r) for r in out] == [(1234567890123456789, 1234567890), (None, 2147483647), (None, -1)]


def distance(a, b):
    lon1, lat1, lon2, lat2 = map(math.radians, (*a, *b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(min(1, h)))


@pytest.mark.parametrize("metres", [10_000.0, 700_000.0])
def test_distances_across_the_meridian_and_at_the_poles(spark, metres):
    rng = np.random.default_rng(int(metres))
    spread = metres / 111_000 * 2

    def places(n):
        lon = np.concatenate([180 - rng.random(n) * spread, -180 + rng.random(n) * spread, rng.random(n) * 360 - 180, [180.0, -180.0, 0.0, 0.0]])
        lat = np.concatenate([rng.random(2 * n) * spread, 90 - rng.random(n) * spread, [0.0, 0.0, 90.0, -90.0]])
        return list(enumerate(zip(lon.tolist(), lat.tolist(), strict=True)))

    a, b = places(40), places(40)
    centres = spark.createDataFrame([(k, *p) for k, p in a], "a INT, a_lon DOUBLE, a_lat DOUBLE")
    points = spark.createDataFrame([(k, *p) for k, p in b], "b INT, lon DOUBLE, lat DOUBLE")
    found = {(r["a"], r["b"]) for r in P.within_distance(centres, points, metres, "a_lon", "a_lat", "lon", "lat").collect()}
    want = {(i, j) for i, p in a for j, q in b if distance(p, q) <= metres}
    assert found == want and len(want) > 40
    far = P.drop_near(centres.toDF("a", "lon", "lat"), points, metres, "lon", "lat")
    assert {r["a"] for r in far.collect()} == {i for i, _ in a} - {i for i, _ in want}


def test_exactly_n_rows_with_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "c"), (2, "d")], "id INT, v STRING")
    for n in range(7):
        assert S.sample_n(df, "id", n).count() == min(n, 5)


def test_capped_rows(spark):
    df = spark.range(1000).select((F.col("id") * 3).alias("id"), F.lit("x").alias("v"))
    assert sorted(r["id"] for r in S.cap_rows(df, "id", 137).collect()) == [3 * k for k in range(137)]
    assert S.cap_rows(df, "id", 5000).count() == 1000 and S.cap_rows(df, "id", 0).count() == 0


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_days_are_utc_in_any_session(spark, zone):
    moment = dt.datetime(2020, 1, 2, 0, 30, tzinfo=dt.timezone.utc)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        one = spark.range(1).select(F.timestamp_seconds(F.lit(int(moment.timestamp()))).alias("ts"))
        plain = spark.range(1).select(F.lit("2020-01-02 00:30:00").cast("timestamp_ntz").alias("ts"))
        for df in (one, plain, spark.range(1).select(F.lit("2020-01-02").cast("date").alias("ts"))):
            assert df.select(day_number(F.col("ts"))).first()[0] == 18263
        for df in (one, plain):
            assert df.where(in_days(F.col("ts"), "2020-01-02", "2020-01-03")).count() == 1
            assert df.where(in_days(F.col("ts"), "2020-01-01", "2020-01-02")).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_shared_folder_is_the_sessions(spark):
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    assert shared_dir(spark, "x").startswith(base.rstrip("/"))
