"""Windows before and around samples, fallbacks, best scenes and medians."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsforge.functions import indices as I
from obsforge.functions.dates import season, seasonal_cycle
from obsforge.operators import lags as L
from obsforge.operators.quantiles import exact_median
from obsforge.operators.skew import splittable_join
from workload import fixtures as X
from workload.registry import query, r6, s6

PLACE = ["site"]


def _band(name, source=None, value="value", reducer="mean"):
    rows = F.lit(True) if source is None else F.col("source") == source
    return L.Band(name, rows, F.col(value), reducer)


def _window_sql(body: str, low: str, high: str, source: str = "meas", samples: str = "obs", place: str = "site") -> str:
    """Samples left-joined to the measurements between two days, grouped per sample."""
    return f"""w AS (
  SELECT o.object_id, {body} FROM {samples} o LEFT JOIN {source} m
    ON m.{place} = o.{place} AND m.ts >= o.obs_date + CAST({low} AS INTEGER) AND m.ts <= o.obs_date + CAST({high} AS INTEGER)
  GROUP BY o.object_id)"""


LAG_SQL = ", ".join(
    f"""coalesce(sum(value) FILTER (m.ts >= o.obs_date - {lag}), 0.0::DOUBLE) AS quantity_{lag},
        coalesce(avg(value) FILTER (m.ts >= o.obs_date - {lag} AND source = 'src_A'), 0.0::DOUBLE) AS a_{lag},
        count(value) FILTER (m.ts >= o.obs_date - {lag}) AS n_quantity_{lag}"""
    for lag in (30, 60, 90)
)


@query(
    "lag_features",
    f"""WITH {X.OBS}, {X.MEAS}, {_window_sql(LAG_SQL, "-90", "-1")}
        SELECT object_id, {", ".join(f"quantity_{l}, {s6(f'a_{l}')} AS a_{l}" for l in (30, 60, 90))} FROM w""",
)
def lag_features(spark, sf):
    bands = [_band("quantity", reducer="sum"), _band("a", "src_A")]
    out = L.lag_features(X.observations(spark, sf), X.measurements(spark, sf), PLACE, "obs_date", "ts", bands)
    return out.select("object_id", *[c for l in L.LAGS for c in (F.col(f"quantity_{l}"), r6(f"a_{l}").alias(f"a_{l}"))])


@query(
    "lag_extremes",
    f"""WITH {X.OBS}, {X.MEAS}, {_window_sql(
        "min(value) FILTER (m.ts >= o.obs_date - 30) AS low_30, max(value) AS high_90, count(value) FILTER (m.ts >= o.obs_date - 60) AS n_60",
        "-90", "-1")} SELECT object_id, low_30, high_90, n_60 FROM w""",
)
def lag_extremes(spark, sf):
    bands = [_band("low", reducer="min"), _band("high", reducer="max"), _band("n", reducer="count")]
    out = L.lag_features(
        X.observations(spark, sf), X.measurements(spark, sf), PLACE, "obs_date", "ts", bands, on_missing="null"
    )
    return out.select("object_id", "low_30", "high_90", "n_60")


@query(
    "lag_drop_missing",
    f"""WITH {X.OBS}, {X.MEAS}, {_window_sql("sum(value) AS s, count(value) AS n", "-30", "-1",
        "(SELECT * FROM meas WHERE source = 'src_A')")} SELECT object_id, s AS a_30 FROM w WHERE n > 0""",
)
def lag_drop_missing(spark, sf):
    out = L.lag_features(
        X.observations(spark, sf), X.measurements(spark, sf), PLACE, "obs_date", "ts",
        [_band("a", "src_A", reducer="sum")], lags=(30,), on_missing="drop",
    )
    return out.select("object_id", "a_30")


MISS = {"src_A": "a", "src_N": "n", "src_R": "r"}
MISS_SQL = ", ".join(
    f"count(value) FILTER (m.ts >= o.obs_date - {lag} AND source = '{s}') AS {v}_{lag}" for s, v in MISS.items() for lag in (30, 60, 90)
)
MISS_LIST = ", ".join(f"CASE WHEN {v}_{lag} = 0 THEN '{v}_{lag}' END" for v in MISS.values() for lag in (30, 60, 90))


@query(
    "lag_missing",
    f"""WITH {X.OBS}, {X.MEAS}, {_window_sql(MISS_SQL, "-90", "-1")}, listed AS (
        SELECT object_id, concat_ws(',', {MISS_LIST}) AS missing, a_30 = 0 OR n_30 = 0 AS gate FROM w)
        SELECT object_id, missing, CAST(gate AS INTEGER) AS critical,
          CAST(gate OR len(string_split(missing, ',')) > 2 AS INTEGER) AS critical_or_many FROM listed""",
)
def lag_missing(spark, sf):
    bands = [_band(v, s, reducer="count") for s, v in MISS.items()]
    out = L.lag_features(X.observations(spark, sf), X.measurements(spark, sf), PLACE, "obs_date", "ts", bands)
    names = {f"{v}_{lag}": F.col(f"{v}_{lag}") for v in MISS.values() for lag in L.LAGS}
    listed = out.withColumn("m", L.missing_list(names))
    return listed.select(
        "object_id",
        F.array_join("m", ",").alias("missing"),
        L.critical_gate(F.col("m"), ["a_30", "n_30"]).cast("int").alias("critical"),
        L.critical_gate(F.col("m"), ["a_30", "n_30"], most=2).cast("int").alias("critical_or_many"),
    )


@query(
    "disjoint_counts",
    f"""WITH {X.VALID}, w AS (
        SELECT o.object_id, {", ".join(
            f"count(*) FILTER (o.obs_date - m.obs_date BETWEEN {a} AND {b} AND m.presence = '{p}') AS {k}_{n}"
            for n, a, b in (("30", 1, 30), ("60", 31, 60), ("90", 61, 90)) for k, p in (("present", "PRESENT"), ("absent", "ABSENT")))}
        FROM obs o LEFT JOIN valid m ON m.site = o.site AND m.obs_date < o.obs_date AND m.obs_date >= o.obs_date - 90
        GROUP BY o.object_id) SELECT * FROM w""",
)
def disjoint_counts(spark, sf):
    bands = [
        L.Band(k, F.col("presence") == p, F.lit(1), "count") for k, p in (("present", "PRESENT"), ("absent", "ABSENT"))
    ]
    reports = X.valid(spark, sf).select("site", F.col("obs_date").alias("ts"), "presence")
    samples = X.observations(spark, sf).select("object_id", "site", "obs_date")
    out = L.disjoint_counts(samples, reports, PLACE, "obs_date", "ts", bands)
    return out.select("object_id", *[f"{k}_{n}" for n in ("30", "60", "90") for k in ("present", "absent")])


@query(
    "symmetric_window",
    f"""WITH {X.OBS}, {X.MEAS}, {_window_sql("avg(value) AS m, sum(value) AS s", "-7", "6")}
        SELECT object_id, {s6("m")} AS mean_week, s AS sum_week FROM w""",
)
def symmetric_window(spark, sf):
    bands = [_band("mean"), _band("sum", reducer="sum")]
    out = L.frame_features(
        X.observations(spark, sf), X.measurements(spark, sf), PLACE, "obs_date", "ts", bands, {"week": (-7, 6)}
    )
    return out.select("object_id", r6("mean_week").alias("mean_week"), "sum_week")


@query(
    "source_fallback",
    f"""WITH {X.OBS}, {X.MEAS}, {_window_sql(
        "avg(value) FILTER (source = 'src_A') AS a, avg(value) FILTER (source = 'src_R') AS r, count(*) FILTER (source = 'src_A') AS na, count(*) FILTER (source = 'src_R') AS nr",
        "-30", "-1")} SELECT object_id, {s6("CASE WHEN na > 0 THEN a WHEN nr > 0 THEN r ELSE 0.0::DOUBLE END")} AS wind_30,
        CAST(CASE WHEN na > 0 THEN 1 WHEN nr > 0 THEN 2 ELSE 0 END AS INTEGER) AS used FROM w""",
)
def source_fallback(spark, sf):
    out = L.lag_features(
        X.observations(spark, sf), X.measurements(spark, sf), PLACE, "obs_date", "ts",
        [_band("a", "src_A"), _band("r", "src_R")], lags=(30,), on_missing="null", keep_counts=True,
    )
    na, nr = F.col("n_a_30"), F.col("n_r_30")
    value = L.with_fallback(na, F.col("a_30"), nr, F.col("r_30"))
    return out.select(
        "object_id", r6(value).alias("wind_30"), F.when(na > 0, 1).when(nr > 0, 2).otherwise(0).alias("used")
    )


@query(
    "best_scene",
    f"""WITH {X.SCENE_OBS}, {X.SCENES}, w AS (
        SELECT o.object_id, min({{'cloud': cloud, 'scene_id': scene_id}}) AS b
        FROM sobs o LEFT JOIN (SELECT * FROM scenes WHERE cloud < 8) s ON s.scene_site = o.scene_site
          AND s.day >= o.obs_date - 4 AND s.day < o.obs_date + 4 GROUP BY o.object_id)
        SELECT object_id, b.cloud AS cloud, b.scene_id AS scene_id,
          CASE WHEN b.scene_id IS NULL THEN 'no_scene' END AS reason FROM w""",
)
def best_scene(spark, sf):
    clear = X.scenes(spark, sf).where(F.col("cloud") < 8)
    out = L.best_in_window(
        X.scene_samples(spark, sf), clear, ["scene_site"], "obs_date", "ts", ["cloud", "scene_id"], [], (-4, 3)
    )
    reason = F.when(F.col("best").isNull(), "no_scene")
    return out.select("object_id", "best.cloud", "best.scene_id", reason.alias("reason"))


@query(
    "best_scene_bands",
    f"""WITH {X.SCENE_OBS}, {X.SCENES}, w AS (
        SELECT o.object_id, min({{'cloud': cloud, 'scene_id': scene_id, 'B4': B4, 'B8': B8}}) AS b
        FROM sobs o JOIN (SELECT * FROM scenes WHERE cloud < 20) s ON s.scene_site = o.scene_site
          AND s.day >= o.obs_date - 15 AND s.day < o.obs_date + 15 GROUP BY o.object_id)
        SELECT object_id, b.scene_id AS scene_id, b.B4 AS "B4", b.B8 AS "B8" FROM w""",
)
def best_scene_bands(spark, sf):
    clear = X.scenes(spark, sf).where(F.col("cloud") < 20)
    out = L.best_in_window(
        X.scene_samples(spark, sf), clear, ["scene_site"], "obs_date", "ts", ["cloud", "scene_id"], ["B4", "B8"]
    )
    return out.where(F.col("best").isNotNull()).select("object_id", "best.scene_id", "best.B4", "best.B8")


@query(
    "window_median",
    f"""WITH {X.OBS}, {X.MEAS}, {_window_sql("median(m.value) AS m, median(m.price) AS p", "-7", "6")}
        SELECT object_id, m AS value_median, {s6("p")} AS price_median FROM w""",
)
def window_median(spark, sf):
    out = L.window_median(
        X.observations(spark, sf).drop("price"), X.measurements(spark, sf), PLACE, "obs_date", "ts", ["value", "price"], (-7, 6)
    )
    return out.select("object_id", "value_median", r6("price_median").alias("price_median"))


@query(
    "window_median_dense",
    f"""WITH {X.OBS}, {X.MEAS},
        days AS (SELECT DISTINCT site % 3 AS zone, obs_date FROM obs),
        w AS (SELECT d.zone, d.obs_date, median(m.price) AS p FROM days d JOIN meas m ON m.site % 3 = d.zone AND m.ts >= d.obs_date - 7 AND m.ts < d.obs_date + 7 GROUP BY ALL)
        SELECT object_id, {s6("p")} AS price_median FROM obs o LEFT JOIN w ON w.zone = o.site % 3 AND w.obs_date = o.obs_date""",
)
def window_median_dense(spark, sf):
    """Three places that hold all measurements: frames of hundreds of values, found through their middle buckets."""
    zone = (F.col("site") % 3).alias("zone")
    samples = X.observations(spark, sf).select("object_id", "obs_date", zone)
    measured = X.measurements(spark, sf).select("ts", F.col("price"), zone)
    out = L.window_median(samples, measured, ["zone"], "obs_date", "ts", ["price"], (-7, 6))
    return out.select("object_id", r6("price_median").alias("price_median"))


@query(
    "median_composite",
    f"""WITH {X.MEAS} SELECT site, source, {s6("median(price)")} AS median FROM meas GROUP BY site, source""",
)
def median_composite(spark, sf):
    out = exact_median(X.measurements(spark, sf), ["site", "source"], "price")
    return out.select("site", "source", r6("median").alias("median"))


@query("median_by_source", f"""WITH {X.MEAS} SELECT source, {s6("median(price)")} AS median FROM meas GROUP BY source""")
def median_by_source(spark, sf):
    """Three groups that hold a third of the table each."""
    return exact_median(X.measurements(spark, sf), ["source"], "price").select("source", r6("median").alias("median"))


INDEX_SQL = f"""{X.OBS}, {X.MEAS}, {_window_sql(", ".join(
    f"coalesce(avg(value) FILTER (m.ts >= o.obs_date - {lag} AND source = '{s}'), 0.0::DOUBLE) AS {v}_{lag}"
    for v, s in (("ndvi", "src_A"), ("evi", "src_N"), ("lst", "src_R")) for lag in (30, 60, 90)), "-90", "-1")}"""


def _indexed(spark, sf):
    bands = [_band("NDVI", "src_A"), _band("EVI", "src_N"), _band("LST_Day_1km", "src_R")]
    return L.lag_features(X.observations(spark, sf), X.measurements(spark, sf), PLACE, "obs_date", "ts", bands)


@query(
    "env_indices",
    f"""WITH {INDEX_SQL} SELECT object_id, {", ".join(
        f'''{s6(f"(lst_{l} - 273.15::DOUBLE) * 0.1::DOUBLE")} AS tci_{l},
            {s6(f"ndvi_{l} * 0.5::DOUBLE + (lst_{l} - 273.15::DOUBLE) * 0.1::DOUBLE * 0.5::DOUBLE")} AS vhi_{l},
            {s6(f"(lst_{l} - 273.15::DOUBLE) / (ndvi_{l} * 10 + 273.15::DOUBLE)")} AS tvdi_{l},
            {s6(f"(evi_{l} - ndvi_{l}) * 0.5::DOUBLE + 0.5::DOUBLE")} AS ndwi_{l}''' for l in (30, 60, 90))} FROM w""",
)
def env_indices(spark, sf):
    out = I.add_lag_indices(_indexed(spark, sf))
    cols = []
    for lag in L.LAGS:
        cols += [r6(f"{v}_{lag}").alias(f"{v.lower()}_{lag}") for v in ("TCI", "VHI", "TVDI")]
        cols.append(r6(I.ndwi_proxy(F.col(f"EVI_{lag}"), F.col(f"NDVI_{lag}"))).alias(f"ndwi_{lag}"))
    return out.select("object_id", *cols)


@query(
    "region_min_tvdi",
    f"""WITH {INDEX_SQL}, joined AS (SELECT w.*, obs.country FROM w JOIN obs USING (object_id)),
        lows AS (SELECT country, min(lst_30) AS low FROM joined GROUP BY country)
        SELECT object_id, {s6("(lst_30 - low) / nullif(273.15::DOUBLE + 50 * ndvi_30 - low, 0)")} AS tvdi_30
        FROM joined JOIN lows USING (country)""",
)
def region_min_tvdi(spark, sf):
    rows = _indexed(spark, sf)
    lows = rows.groupBy("country").agg(F.min("LST_Day_1km_30").alias("low"))
    value = I.tvdi_region(F.col("LST_Day_1km_30"), F.col("NDVI_30"), F.col("low"))
    return splittable_join(rows, lows, ["country"]).select("object_id", r6(value).alias("tvdi_30"))


@query(
    "band_indices",
    f"""WITH {X.SCENES} SELECT scene_id,
        {s6("(B8 - B4) / nullif(B8 + B4, 0)")} AS ndvi, {s6("(B3 - B8) / nullif(B3 + B8, 0)")} AS ndwi,
        {s6("2.5::DOUBLE * ((B8 - B4) / nullif(B8 + 6 * B4 - 7.5::DOUBLE * B2 + 1, 0))")} AS evi FROM scenes""",
)
def band_indices(spark, sf):
    b = {n: F.col(n) for n in ("B2", "B3", "B4", "B8")}
    return X.scenes(spark, sf).select(
        "scene_id",
        r6(I.normalised_difference(b["B8"], b["B4"])).alias("ndvi"),
        r6(I.normalised_difference(b["B3"], b["B8"])).alias("ndwi"),
        r6(I.evi(b["B8"], b["B4"], b["B2"])).alias("evi"),
    )


@query(
    "temperature_humidity",
    f"""SELECT event_id, {s6("value * 0.02::DOUBLE - 273.15::DOUBLE")} AS celsius,
        {s6("100.0::DOUBLE - (value % 40) * 5.0::DOUBLE")} AS rh_approx,
        CASE WHEN value % 40 < 20 THEN 'overflow' WHEN value % 40 > 25 THEN 'zero' ELSE 'between' END AS rh_literal FROM events""",
)
def temperature_humidity(spark, sf):
    spread = F.col("value") % 40
    literal = I.relative_humidity(spread, F.lit(0.0))
    # the literal form leaves the range of a double on both sides; between 20 and 25 it is finite or not
    kind = (
        F.when((literal == float("inf")) & (spread < 20), "overflow").when((literal == 0.0) & (spread > 25), "zero").otherwise("between")
    )
    return X.table(spark, sf, "events").select(
        "event_id",
        r6(I.lst_celsius(F.col("value"))).alias("celsius"),
        r6(I.relative_humidity(spread, F.lit(0.0), "approx")).alias("rh_approx"),
        kind.alias("rh_literal"),
    )


@query(
    "seasonal_cycle",
    f"""WITH {X.OBS} SELECT object_id, {s6("cos((dayofyear(obs_date) - 1) * 2.0::DOUBLE * pi() / 365.0::DOUBLE)")} AS seasonal_cos,
        {s6("sin((dayofyear(obs_date) - 1) * 2.0::DOUBLE * pi() / 365.0::DOUBLE)")} AS seasonal_sin,
        CASE WHEN month(obs_date) BETWEEN 3 AND 8 THEN 'breeding' ELSE 'migration' END AS season FROM obs""",
)
def seasonal(spark, sf):
    c, s = seasonal_cycle(F.col("obs_date"))
    return X.observations(spark, sf).select(
        "object_id", r6(c).alias("seasonal_cos"), r6(s).alias("seasonal_sin"), season(F.col("obs_date")).alias("season")
    )


WEIGHT_SQL = """CASE WHEN month(obs_date) BETWEEN 3 AND 8 THEN {b}::DOUBLE ELSE {m}::DOUBLE END"""
COARSE, MEDIUM, FINE = (WEIGHT_SQL.format(b=b, m=m) for b, m in ((0.2, 0.5), (0.3, 0.4), (0.5, 0.1)))


@query(
    "scale_weights",
    f"""WITH {X.OBS}, c AS (SELECT *, CAST(site % 17 AS INTEGER) AS cover FROM obs)
        SELECT object_id, {s6(f"CASE WHEN cover = 16 THEN least({COARSE} + 0.2::DOUBLE, 0.6::DOUBLE) ELSE {COARSE} END")} AS coarse,
        {s6(MEDIUM)} AS medium, {s6(f"CASE WHEN cover = 12 THEN least({FINE} + 0.2::DOUBLE, 0.6::DOUBLE) ELSE {FINE} END")} AS fine FROM c""",
)
def scale_weights(spark, sf):
    w = I.scale_weights(season(F.col("obs_date")), (F.col("site") % 17).cast("int"))
    return X.observations(spark, sf).select("object_id", *[r6(c).alias(k) for k, c in w.items()])


@query(
    "suitability",
    f"""WITH {INDEX_SQL}, e AS (SELECT w.*, obs.obs_date, obs.price FROM w JOIN obs USING (object_id))
        SELECT object_id, {s6("least(greatest((ndvi_30 + ndvi_60 + ndvi_90) / 3 * 0.3::DOUBLE * 0.00137193::DOUBLE + (lst_30 + lst_60 + lst_90) / 3 * 0.2::DOUBLE * 0.00137193::DOUBLE + price * 0.0000001::DOUBLE * 0.01::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE)")} AS hsi,
        {s6(f"ndvi_30 * 0.00137193::DOUBLE * {MEDIUM}")} AS "NDVI_30_w" FROM e""",
)
def suitability(spark, sf):
    rows = _indexed(spark, sf)
    scaled = rows.withColumns({c: F.col(c) * 0.00137193 for c in rows.columns if c.startswith(("NDVI_", "LST_"))})
    scaled = scaled.withColumn("elevation", F.col("price") * 0.0000001)
    weights = I.scale_weights(season(F.col("obs_date")), F.lit(0))
    out = I.weighted_groups(scaled.withColumn("hsi", I.suitability(scaled)), weights)
    return out.select("object_id", r6("hsi").alias("hsi"), r6("NDVI_30_w").alias("NDVI_30_w"))
