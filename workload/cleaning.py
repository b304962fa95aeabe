"""Dates, validity, filters and simple projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsforge.functions.dates import iso, parse_obs_date
from obsforge.functions.values import binarise, class_label, finite_or_zero, is_missing, rescale, unmask
from obsforge.operators import cleaning as C
from workload import fixtures as X
from workload.registry import query, r6, s6


@query("parse_dates", f"WITH {X.RAW} SELECT object_id, day, strftime(day, '%Y-%m-%d') AS iso FROM dated")
def parse_dates(spark, sf):
    day = parse_obs_date(F.col("obs_text"))
    return X.raw_dates(spark, sf).select("object_id", day.alias("day"), iso(day).alias("iso"))


@query(
    "parse_dates_fallback",
    f"""WITH {X.RAW} SELECT object_id, CASE WHEN year(day) >= 1998 AND year(day) <= 2000 THEN day
        ELSE DATE '2020-06-01' END AS day FROM dated""",
)
def parse_dates_fallback(spark, sf):
    day = parse_obs_date(F.col("obs_text"), min_year=1998, max_year=2000, fallback=F.lit("2020-06-01").cast("date"))
    return X.raw_dates(spark, sf).select("object_id", day.alias("day"))


REJECTS = f"""WITH {X.RAW}, marked AS (
  SELECT object_id, CASE WHEN day IS NULL THEN 'no_date' WHEN year(day) NOT BETWEEN 1900 AND 2000 THEN 'year_out_of_range'
    WHEN presence NOT IN ('PRESENT', 'ABSENT') THEN 'bad_presence' WHEN lat_m > 14900 THEN 'outside' END AS reason
  FROM dated)"""


def _split(spark, sf):
    raw = X.raw_dates(spark, sf).withColumn("day", parse_obs_date(F.col("obs_text")))
    reason = C.reject_reason(
        F.col("day"), F.col("lon_m"), F.col("lat_m"), F.col("presence"), 2000, {"outside": F.col("lat_m") > 14900}
    )
    return C.split_rejects(raw, reason)


@query("validate_rejects", REJECTS + " SELECT object_id, reason FROM marked WHERE reason IS NOT NULL")
def validate_rejects(spark, sf):
    return _split(spark, sf)[1].select("object_id", "reason")


@query("validate_good", REJECTS + " SELECT object_id FROM marked WHERE reason IS NULL")
def validate_good(spark, sf):
    return _split(spark, sf)[0].select("object_id")


@query(
    "filter_observations",
    f"""WITH {X.OBS} SELECT object_id, obs_date, country FROM obs WHERE obs_date BETWEEN DATE '1996-03-01' AND DATE '2000-10-31'
        AND year(obs_date) >= 1997 AND presence = 'PRESENT' AND country IN (SELECT n_name FROM nation WHERE n_nationkey IN (3, 7, 12))""",
)
def filter_observations(spark, sf):
    obs = X.observations(spark, sf)
    names = X.table(spark, sf, "nation").where(F.col("n_nationkey").isin(3, 7, 12)).select(F.col("n_name").alias("country"))
    kept = C.filter_observations(obs, start="1996-03-01", end="2000-10-31", min_year=1997, classes=["PRESENT"])
    return kept.join(names, "country", "left_semi").select("object_id", "obs_date", "country")


@query(
    "filter_strict_years",
    f"WITH {X.OBS} SELECT object_id, obs_date FROM obs WHERE year(obs_date) > 1996 AND year(obs_date) < 2000 AND presence IN ('PRESENT', 'ABSENT')",
)
def filter_strict_years(spark, sf):
    kept = C.filter_observations(X.observations(spark, sf), after_year=1996, before_year=2000, classes=C.CLASSES)
    return kept.select("object_id", "obs_date")


@query("filter_countries", f"WITH {X.OBS} SELECT object_id, country FROM obs WHERE country IN ('KENYA', 'ETHIOPIA', 'EGYPT')")
def filter_countries(spark, sf):
    kept = C.filter_observations(X.observations(spark, sf), countries=("KENYA", "ETHIOPIA", "EGYPT"))
    return kept.select("object_id", "country")


@query(
    "iso_range",
    f"WITH {X.OBS} SELECT object_id, strftime(obs_date, '%Y-%m-%d') AS iso FROM obs WHERE obs_date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'",
)
def iso_range(spark, sf):
    text = X.observations(spark, sf).select("object_id", iso(F.col("obs_date")).alias("iso"))
    return C.iso_range(text, "iso", "1998-01-01", "1999-12-31")


@query(
    "not_null_rows",
    f"WITH {X.RAW} SELECT object_id, obs_text FROM texts WHERE obs_text IS NOT NULL AND presence IS NOT NULL AND lon_m IS NOT NULL AND lat_m IS NOT NULL",
)
def not_null_rows(spark, sf):
    return C.require(X.raw_dates(spark, sf), ["obs_text", "presence", "lon_m", "lat_m"]).select("object_id", "obs_text")


@query(
    "time_window",
    "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'",
)
def time_window(spark, sf):
    start, end = (F.lit(t).cast("timestamp") for t in ("2024-01-05", "2024-01-20"))
    return X.table(spark, sf, "events").where(C.in_window(F.col("ts"), start, end)).select("event_id", "user_id")


@query(
    "conform_schema",
    """SELECT o_orderkey AS object_id, CAST(o_orderdate AS DATE) AS obs_date, o_orderstatus AS presence,
       CAST(o_totalprice AS DOUBLE) AS lon, CAST(NULL AS DOUBLE) AS lat FROM orders""",
)
def conform_schema(spark, sf):
    schema = {"object_id": "bigint", "obs_date": "date", "presence": "string", "lon": "double", "lat": "double"}
    rename = {"o_orderkey": "OBJECT_ID", "o_orderdate": "obs_date", "o_orderstatus": "presence", "o_totalprice": "lon"}
    return C.conform(X.table(spark, sf, "orders"), schema, rename)


@query(
    "label_and_bands",
    f"""WITH {X.OBS} SELECT object_id, CASE WHEN presence = 'PRESENT' THEN 1 ELSE 0 END AS label,
        {s6("price * 0.1::DOUBLE - 5.0::DOUBLE")} AS "price_30", CAST(site AS BIGINT) AS place FROM obs""",
)
def label_and_bands(spark, sf):
    return X.observations(spark, sf).select(
        "object_id",
        class_label(F.col("presence")).cast("int").alias("label"),
        r6(rescale(F.col("price"), 0.1, -5.0)).alias("price_30"),
        F.col("site").alias("place"),
    )


@query(
    "missing_bands",
    """SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 5 = 0 THEN 'a' END, CASE WHEN p_size % 7 = 0 THEN 'b' END,
       CASE WHEN p_size % 11 = 0 THEN 'c' END) AS missing FROM part""",
)
def missing_bands(spark, sf):
    size, price = F.col("p_size"), F.col("p_retailprice")
    bands = X.table(spark, sf, "part").select(
        "p_partkey",
        F.when(size % 5 != 0, price).alias("a"),
        F.when(size % 7 == 0, F.lit(float("nan"))).otherwise(price).alias("b"),
        F.when(size % 11 != 0, price).alias("c"),
    )
    return C.missing_bands(bands, ["a", "b", "c"]).select("p_partkey", F.array_join("missing_bands", ",").alias("missing"))


@query(
    "plan_summary",
    f"""WITH {X.OBS} SELECT count(*) AS n_total, count(*) FILTER (presence = 'PRESENT') AS n_presence,
        count(*) FILTER (presence = 'ABSENT') AS n_absence FROM obs""",
)
def plan_summary(spark, sf):
    return C.plan_summary(X.observations(spark, sf))


@query("inspect_page", f"WITH {X.OBS} SELECT object_id, presence, country FROM obs ORDER BY object_id LIMIT 25 OFFSET 50")
def inspect_page(spark, sf):
    return C.inspect(X.observations(spark, sf).select("object_id", "presence", "country"), "object_id", 25, 50)


@query(
    "clean_values",
    f"""WITH {X.PIX} SELECT file_key, band, count(*) AS n, {s6("sum(value)")} AS total,
        CAST(sum(CASE WHEN value > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS above FROM pix GROUP BY file_key, band""",
)
def clean_values(spark, sf):
    pix = X.pixels(spark, sf).withColumn("v", finite_or_zero(F.col("value")))
    return pix.groupBy("file_key", "band").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("v")).alias("total"), F.sum(binarise(F.col("v"), 0.05)).alias("above")
    )


@query(
    "unmask_zero",
    f"""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0.0::DOUBLE ELSE {s6("p_retailprice")} END AS value,
        CAST(p_size % 5 = 0 AS INTEGER) AS was_missing FROM part""",
)
def unmask_zero(spark, sf):
    v = F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice"))
    return X.table(spark, sf, "part").select(
        "p_partkey", r6(unmask(v)).alias("value"), is_missing(v).cast("int").alias("was_missing")
    )
