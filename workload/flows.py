"""The whole flows: training table, composite table, multi-scale table."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsforge.operators.context import COUNT_CLASSES, PERIODS
from obsforge.plans import composite, multiscale, training
from obsforge.sources.catalogue import STATIC, TRAINING_CSV
from workload import fixtures as X
from workload.registry import query, r6, s6
from workload.spatial import CROSSINGS, DISTANCE, levels

LAGS = (30, 60, 90)
# position of each variable's band among the fixture's bands; wind has two sources, NDWI is band 13
KIND = {"NDVI": 0, "EVI": 1, "LST_Day_1km": 2, "precipitation": 3, "u": 4, "v": 5, "u2": 6, "v2": 7, "sm_surface": 8, "ET": 9, "aet": 10, "pet": 11, "NDWI": 13}
SUMMED = ("precipitation", "ET", "aet")
U, V = "u_component_of_wind_10m", "v_component_of_wind_10m"


def _aggregates() -> str:
    out = []
    for name, kind in KIND.items():
        fn = "sum" if name in SUMMED else "avg"
        for lag in LAGS:
            rows = f"FILTER (e.kind = {kind} AND e.day >= o.obs_date - {lag})"
            out.append(f"{fn}(value) {rows} AS {name}_{lag}, count(value) {rows} AS n_{name}_{lag}")
    return ", ".join(out)


def _lagged(lag: int) -> dict[str, str]:
    """SQL of the eleven variables at one lag, over the columns of `w`."""
    zero = {k: f"coalesce({k}_{lag}, 0.0::DOUBLE)" for k in KIND}
    first, second = f"n_u_{lag} + n_v_{lag} > 0", f"n_u2_{lag} + n_v2_{lag} > 0"
    wind = {
        full: f"CASE WHEN {first} THEN {zero[a]} WHEN {second} THEN {zero[b]} ELSE 0.0::DOUBLE END"
        for full, a, b in ((U, "u", "u2"), (V, "v", "v2"))
    }
    ndwi = f"CASE WHEN n_NDWI_{lag} > 0 THEN NDWI_{lag} ELSE ({zero['EVI']} - {zero['NDVI']}) * 0.5::DOUBLE + 0.5::DOUBLE END"
    order = ("NDVI", "EVI", "LST_Day_1km", "precipitation", U, V, "sm_surface", "ET", "aet", "pet", "NDWI")
    values = {**zero, **wind, "NDWI": ndwi}
    return {f"{k}_{lag}": values[k] for k in order}


VARIABLES = {k: v for lag in LAGS for k, v in _lagged(lag).items()}
GATE = " OR ".join(f"n_{v}_{lag} = 0" for v in ("NDVI", "LST_Day_1km") for lag in LAGS)
WINDOWS = f"""{X.VALID}, {X.ENV}, w AS (
  SELECT o.object_id, {_aggregates()} FROM valid o LEFT JOIN env e
    ON e.site = o.site AND e.day >= o.obs_date - 90 AND e.day < o.obs_date GROUP BY o.object_id)"""
LAYERS = f"""layers AS (SELECT cell_x, cell_y, elevation, p_partkey % 30 * 1.5::DOUBLE AS slope, p_partkey % 360 * 1.0::DOUBLE AS aspect,
  landcover, CAST(p_partkey % 12 AS INTEGER) AS soil_texture, p_partkey % 100 * 1.0::DOUBLE AS sand_0_5cm, p_partkey % 90 * 1.0::DOUBLE AS sand_5_15cm,
  p_partkey % 80 * 1.0::DOUBLE AS sand_15_30cm FROM cells)"""
CENTRE = f"""near AS (SELECT a.object_id, {", ".join(
    f"count(*) FILTER (a.obs_date - b.obs_date BETWEEN {lo} AND {hi} AND b.presence = '{p}') AS {k}_{n}"
    for n, lo, hi in PERIODS for k, p in COUNT_CLASSES.items())}
  FROM valid a JOIN valid b ON b.obs_date < a.obs_date AND b.obs_date >= a.obs_date - 90 AND b.lat_m >= a.lat_m - 125 AND b.lat_m < a.lat_m + 125
    AND b.lon_m >= a.lon_m - 125 AND b.lon_m < a.lon_m + 125 GROUP BY a.object_id)"""
COUNTS = [f"{k}_{n}" for n, _, _ in PERIODS for k in COUNT_CLASSES]


def static_layers(spark, sf):
    k = F.col("p_partkey")
    return X.cells(spark, sf).select(
        "cell_x", "cell_y", "elevation", (k % 30 * 1.5).alias("slope"), (k % 360 * 1.0).alias("aspect"), "landcover",
        (k % 12).cast("int").alias("soil_texture"), (k % 100 * 1.0).alias("sand_0_5cm"), (k % 90 * 1.0).alias("sand_5_15cm"),
        (k % 80 * 1.0).alias("sand_15_30cm"),
    )


def _cells_of(df):
    return df.withColumns({"cell_x": F.floor(F.col("lon_m") / 250), "cell_y": F.floor(F.col("lat_m") / 250)})


NAMES = training.Columns(lon="lon_m", lat="lat_m", place=("site",))


def _indices_sql(lag: int) -> str:
    lst, ndvi = f'"LST_Day_1km_{lag}"', f'"NDVI_{lag}"'
    return f"""{s6(f"({lst} - 273.15::DOUBLE) * 0.1::DOUBLE")} AS "TCI_{lag}",
      {s6(f"{ndvi} * 0.5::DOUBLE + ({lst} - 273.15::DOUBLE) * 0.1::DOUBLE * 0.5::DOUBLE")} AS "VHI_{lag}",
      {s6(f"({lst} - 273.15::DOUBLE) / ({ndvi} * 10 + 273.15::DOUBLE)")} AS "TVDI_{lag}" """


@query(
    "training_table",
    f"""WITH {WINDOWS}, {X.CELLS}, {LAYERS}, {CENTRE}, v AS (SELECT object_id, {", ".join(f'{e} AS "{k}"' for k, e in VARIABLES.items())} FROM w WHERE NOT ({GATE}))
        SELECT v.object_id, {", ".join(f'{s6(f"""v."{k}" """)} AS "{k}"' for k in VARIABLES)}, {", ".join(STATIC)}, {", ".join(_indices_sql(lag) for lag in LAGS)},
          {", ".join(f"coalesce({c}, 0) AS {c}" for c in COUNTS)}, CASE WHEN o.presence = 'PRESENT' THEN 1 ELSE 0 END AS label
        FROM v JOIN valid o USING (object_id) LEFT JOIN layers ON cell_x = lon_m // 250 AND cell_y = lat_m // 250 LEFT JOIN near USING (object_id)""",
)
def training_table(spark, sf):
    samples = _cells_of(X.valid(spark, sf))
    out = training.build_training_table(
        samples, X.environment_rows(spark, sf), static_layers(spark, sf), samples, X.GRID_STEP, NAMES, ("cell_x", "cell_y")
    )
    kept = {"object_id", "landcover", "soil_texture", *COUNTS}
    values = [F.col(c) if c in kept or c in STATIC else r6(c).alias(c) for c in out.columns if c != "label"]
    return out.select(*values, F.col("label").cast("int").alias("label"))


@query(
    "training_rejects",
    f"""WITH {WINDOWS}, m AS (SELECT object_id, concat_ws(',', {", ".join(
        f"CASE WHEN n_{v}_{lag} = 0 THEN '{v}_{lag}' END" if v != "Wind" else f"CASE WHEN n_u_{lag} + n_v_{lag} + n_u2_{lag} + n_v2_{lag} = 0 THEN 'Wind_{lag}' END"
        for lag in LAGS for v in ("NDVI", "EVI", "LST_Day_1km", "precipitation", "sm_surface", "ET", "aet", "pet", "Wind"))}) AS missing, {GATE} AS gate FROM w)
        SELECT object_id, missing, CAST(gate AS INTEGER) AS critical FROM m WHERE missing <> ''""",
)
def training_rejects(spark, sf):
    env = training.environment(X.valid(spark, sf), X.environment_rows(spark, sf), NAMES)
    return env.where(F.size("missing") > 0).select(
        "object_id", F.array_join("missing", ",").alias("missing"), F.col("critical_missing").cast("int").alias("critical")
    )


# --- composite table -------------------------------------------------------------------------------------------------


def composite_measurements(spark, sf):
    """Line items as composite bands of part cells; temperatures come in pairs at one time."""
    names = ["sm_surface", "LST_Day_1km", U, V, "precipitation"]
    li = X.table(spark, sf, "lineitem")
    q = F.col("l_quantity")
    single = F.array(
        *[F.struct(F.lit(n).alias("band"), (q + i).alias("value")) for i, n in enumerate(names)],
        F.struct(F.lit("temperature_2m").alias("band"), (q % 7 + 300.0).alias("value")),
        F.struct(F.lit("dewpoint_temperature_2m").alias("band"), (F.lit(300.0) - q % 5).alias("value")),
    )
    k = F.col("l_partkey")
    return li.select(
        (F.lit(132) + k % 60).alias("cell_x"),
        (F.lit(12) + F.floor(k / 60)).alias("cell_y"),
        F.expr("timestampadd(MICROSECOND, l_orderkey * 8 + l_linenumber, l_shipdate)").alias("ts"),
        F.explode(single).alias("b"),
    ).select("cell_x", "cell_y", "ts", "b.band", "b.value")


def composite_scenes(spark, sf):
    """Events as scenes over the cells of the parts, one in each band of rows."""
    s = X.scenes(spark, sf)
    k = F.col("scene_id")
    return s.select(
        (F.lit(132) + k % 60).alias("cell_x"), (F.lit(12) + F.floor(k / 300)).alias("cell_y"), "ts", "cloud", "B2", "B4", "B5"
    )


START, END = "1996-01-01", "2024-02-01"


@query(
    "composite_table",
    f"""WITH {X.OBS}, {X.SCENES}, {X.CELLS}, sc AS (SELECT 132 + scene_id % 60 AS cell_x, 12 + scene_id // 300 AS cell_y,
          CASE WHEN B5 + B4 <> 0 THEN (B5 - B4) / (B5 + B4) END AS ndvi, 2.5::DOUBLE * ((B5 - B4) / nullif(B5 + 6 * B4 - 7.5::DOUBLE * B2 + 1, 0)) AS evi FROM scenes WHERE cloud < 30),
        g AS (SELECT cell_x, cell_y, median(ndvi) AS "NDVI", median(evi) AS "EVI" FROM sc GROUP BY ALL),
        li AS (SELECT 132 + l_partkey % 60 AS cell_x, 12 + l_partkey // 60 AS cell_y, l_quantity AS q, l_shipdate, l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '{START}'),
        h AS (SELECT cell_x, cell_y, 100.0::DOUBLE - (max(q % 7 + 300.0::DOUBLE) - 273.15::DOUBLE - (max(300.0::DOUBLE - q % 5) - 273.15::DOUBLE)) * 5.0::DOUBLE AS rh FROM li GROUP BY cell_x, cell_y, l_shipdate, l_orderkey, l_linenumber),
        hm AS (SELECT cell_x, cell_y, median(rh) AS "Relative_Humidity" FROM h GROUP BY ALL),
        m AS (SELECT cell_x, cell_y, median(q) AS sm_surface, median((q + 1) * 0.02::DOUBLE - 273.15::DOUBLE) AS "LST_Day_1km", median(q + 2) AS "uWindSpeed_10m", median(q + 3) AS "vWindSpeed_10m",
          sum(q + 4) AS precipitation FROM li GROUP BY ALL),
        hit AS (SELECT DISTINCT lon_m // 250 AS cell_x, lat_m // 250 AS cell_y FROM obs WHERE presence = 'PRESENT')
        SELECT object_id, {", ".join(f'{s6(chr(34) + c + chr(34))} AS "{c}"' for c in TRAINING_CSV if c not in ("longitude", "latitude", "label"))},
          (m.cell_x + 0.5::DOUBLE) * 250.0::DOUBLE AS longitude, (m.cell_y + 0.5::DOUBLE) * 250.0::DOUBLE AS latitude, CASE WHEN hit.cell_x IS NULL THEN 0 ELSE 1 END AS label
        FROM obs JOIN g ON g.cell_x = lon_m // 250 AND g.cell_y = lat_m // 250 JOIN m ON m.cell_x = g.cell_x AND m.cell_y = g.cell_y
          JOIN hm ON hm.cell_x = g.cell_x AND hm.cell_y = g.cell_y JOIN cells c ON c.cell_x = g.cell_x AND c.cell_y = g.cell_y
          LEFT JOIN hit ON hit.cell_x = g.cell_x AND hit.cell_y = g.cell_y
        WHERE "NDVI" IS NOT NULL AND "EVI" IS NOT NULL""",
)
def composite_table(spark, sf):
    obs = X.observations(spark, sf)
    rows = composite.composite_cells(
        composite_scenes(spark, sf), composite_measurements(spark, sf), X.cells(spark, sf), START, END, humidity="approx", wanted=_cells_of(obs)
    )
    present = obs.where(F.col("presence") == "PRESENT")
    out = composite.composite_table(rows, present, obs, F.col("lon_m"), F.col("lat_m"), 250.0, ["object_id"])
    plain = ("longitude", "latitude", "label")
    return out.select("object_id", *[F.col(c) if c in plain else r6(c).alias(c) for c in TRAINING_CSV])


# --- multi-scale table -----------------------------------------------------------------------------------------------


def era_rows(spark, sf):
    """Line items as the four climate bands, one band per row."""
    bands = F.array(*[F.lit(b) for b in multiscale.COARSE_BANDS])
    return X.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("site"),
        F.lit(multiscale.COARSE_COLLECTION).alias("source"),
        F.element_at(bands, (F.col("l_partkey") % 4).cast("int") + 1).alias("band"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("value"),
    )


COARSE_SQL = ", ".join(
    f"coalesce(avg(l_quantity) FILTER (l_partkey % 4 = {i} AND l_shipdate >= o.obs_date - {lag}), 0.0::DOUBLE) AS {out}_{lag}"
    for i, out in enumerate(multiscale.COARSE_BANDS.values())
    for lag in multiscale.COARSE_LAGS
)


@query(
    "coarse_features",
    f"""WITH {X.OBS}, {X.EDGES}, w AS (SELECT o.object_id, {COARSE_SQL} FROM obs o LEFT JOIN lineitem ON l_suppkey = o.site AND l_shipdate >= o.obs_date - 90 AND l_shipdate < o.obs_date GROUP BY o.object_id),
        hit AS (SELECT object_id, poly_id, any_value(biome_id) AS biome_id FROM obs JOIN edges ON {CROSSINGS} GROUP BY object_id, poly_id HAVING count(*) % 2 = 1),
        b AS (SELECT object_id, arg_min(biome_id, poly_id) AS biome_id FROM hit GROUP BY object_id)
        SELECT w.object_id, {", ".join(f"{s6(f'{o}_{lag}')} AS {o}_{lag}" for o in multiscale.COARSE_BANDS.values() for lag in multiscale.COARSE_LAGS)},
          {s6("cos((dayofyear(obs_date) - 1) * 2.0::DOUBLE * pi() / 365.0::DOUBLE)")} AS seasonal_cos, biome_id
        FROM w JOIN obs USING (object_id) LEFT JOIN b USING (object_id)""",
)
def coarse_features(spark, sf):
    wide = multiscale.coarse_features(X.observations(spark, sf), era_rows(spark, sf), ["site"], "obs_date", "ts")
    out = multiscale.with_biome(wide, X.edges(spark), "lon_m", "lat_m", X.STRIP)
    names = [f"{o}_{lag}" for o in multiscale.COARSE_BANDS.values() for lag in multiscale.COARSE_LAGS]
    return out.select("object_id", *[r6(c).alias(c) for c in [*names, "seasonal_cos"]], "biome_id")


FINE_SQL = f"""{X.SCENE_OBS}, {X.SCENES}, one AS (SELECT o.object_id, {", ".join(f"median({b}) AS {b}" for b in multiscale.FINE_FIRST.values())} FROM sobs o
    JOIN scenes s ON s.scene_site = o.scene_site AND s.day >= o.obs_date - 30 AND s.day < o.obs_date AND cloud < 20 GROUP BY o.object_id),
  two AS (SELECT o.object_id, {", ".join(f"median({b}) AS {b}" for b in multiscale.FINE_SECOND.values())} FROM sobs o
    JOIN scenes s ON s.scene_site = o.scene_site AND s.day >= o.obs_date - 30 AND s.day < o.obs_date GROUP BY o.object_id)"""


def _nd(a: str, b: str) -> str:
    return f"({a} - {b}) / nullif({a} + {b}, 0)"


@query(
    "fine_indices",
    f"""WITH {FINE_SQL} SELECT sobs.object_id,
        {s6(f"CASE WHEN one.B8 IS NOT NULL THEN {_nd('one.B8', 'one.B4')} WHEN two.SR_B5 IS NOT NULL THEN {_nd('SR_B5', 'SR_B4')} ELSE 0.0::DOUBLE END")} AS fine_ndvi,
        {s6(f"CASE WHEN one.B8 IS NOT NULL THEN {_nd('one.B3', 'one.B8')} WHEN two.SR_B5 IS NOT NULL THEN {_nd('SR_B3', 'SR_B5')} ELSE 0.0::DOUBLE END")} AS fine_ndwi,
        {s6(f"CASE WHEN one.B8 IS NOT NULL THEN {_nd('one.B8', 'one.B5')} ELSE 0.0::DOUBLE END")} AS fine_rededge
        FROM sobs LEFT JOIN one USING (object_id) LEFT JOIN two USING (object_id)""",
)
def fine_indices(spark, sf):
    s = X.scenes(spark, sf)
    out = multiscale.fine_indices(X.scene_samples(spark, sf), s, s, ["scene_site"], "obs_date", "ts")
    return out.select("object_id", *[r6(c).alias(c) for c in ("fine_ndvi", "fine_ndwi", "fine_rededge")])


def _degrees(df):
    """Samples with their metre coordinates as degrees, so that circles of metres are circles of metres."""
    return df.withColumns({"lon_d": F.col("lon_m") / 111000.0, "lat_d": F.col("lat_m") / 111000.0})


def _cover(spark, sf):
    centre = [((F.col(c) + 0.5) * 250.0 / 111000.0).alias(n) for c, n in (("cell_x", "cover_lon"), ("cell_y", "cover_lat"))]
    return X.cells(spark, sf).select(*centre, F.col("landcover").alias("cover"))


COVER = f"""{X.CELLS}, cov AS (SELECT (cell_x + 0.5::DOUBLE) * 250.0::DOUBLE / 111000.0::DOUBLE AS lon, (cell_y + 0.5::DOUBLE) * 250.0::DOUBLE / 111000.0::DOUBLE AS lat, landcover FROM cells),
  spots AS (SELECT DISTINCT lon_m, lat_m, lon_m / 111000.0::DOUBLE AS lon, lat_m / 111000.0::DOUBLE AS lat FROM obs),
  circle AS (SELECT lon_m, lat_m, landcover, count(*) AS n FROM spots a JOIN cov b ON abs(b.lat - a.lat) < 0.02 AND abs(b.lon - a.lon) < 0.02 AND {DISTANCE} <= 2000 GROUP BY ALL),
  parts AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY lon_m, lat_m) AS DOUBLE) AS p FROM circle),
  land AS (SELECT lon_m, lat_m, count(*) / (pi() * 4000000.0::DOUBLE) * 1000000.0::DOUBLE AS patch_density, -sum(p * ln(p)) AS shannon_diversity FROM parts GROUP BY ALL)"""


@query(
    "landscape_around_samples",
    f"""WITH {X.OBS}, {COVER} SELECT object_id, {s6("coalesce(patch_density, 0.0::DOUBLE)")} AS patch_density, {s6("coalesce(shannon_diversity, 0.0::DOUBLE)")} AS shannon_diversity
        FROM obs LEFT JOIN land USING (lon_m, lat_m)""",
)
def landscape_around_samples(spark, sf):
    """Land cover of the cells in a circle of two kilometres around each observation."""
    out = multiscale.landscape_around(_degrees(X.observations(spark, sf)), _cover(spark, sf), "lon_d", "lat_d", "cover_lon", "cover_lat", "cover")
    return out.select("object_id", r6("patch_density").alias("patch_density"), r6("shannon_diversity").alias("shannon_diversity"))


def _scales(spark, sf):
    k = F.col("p_partkey")
    static = X.cells(spark, sf).select(
        "cell_x", "cell_y", *[(F.col("elevation") * i).alias(c) for i, c in enumerate(multiscale.CLIMATE, 1)],
        "elevation", (k % 30 * 1.5).alias("slope"), (k % 360 * 1.0).alias("aspect"), "landcover", (k % 12).cast("int").alias("soil_texture"),
    )
    scenes = X.scenes(spark, sf)
    from obsforge.operators.landscape import glcm

    texture = glcm(levels(spark, sf).where(F.col("band") == 0), ["file_key"], "row", "col", "g").withColumnRenamed("file_key", "scene_site")
    return multiscale.Scales(
        era_rows(spark, sf), X.environment_rows(spark, sf), X.edges(spark), static, _cover(spark, sf), scenes, scenes, texture, X.valid(spark, sf)
    )


def _multiscale(spark, sf):
    moved = X.scene_samples(spark, sf).select("object_id", "scene_site", F.col("obs_date").alias("scene_date"))
    samples = _cells_of(_degrees(X.valid(spark, sf))).drop("scene_site").join(moved, "object_id")
    return multiscale.multiscale_features(samples, _scales(spark, sf), NAMES, ["cell_x", "cell_y"], ["scene_site"], "scene_date", ("lon_d", "lat_d"), X.GRID_STEP, X.STRIP)


COARSE_NAMES = [f"{o}_{lag}" for o in multiscale.COARSE_BANDS.values() for lag in multiscale.COARSE_LAGS]
LOST = " + ".join(
    f"CAST({f'n_{v}_{lag}' if v != 'Wind' else f'n_u_{lag} + n_v_{lag} + n_u2_{lag} + n_v2_{lag}'} = 0 AS INTEGER)" + (" * 2" if v == "Wind" else "")
    for lag in LAGS for v in ("NDVI", "EVI", "LST_Day_1km", "precipitation", "sm_surface", "ET", "aet", "pet", "Wind")
)
MULTI_GATE = f"""n_NDVI_30 = 0 OR n_LST_Day_1km_30 = 0 OR n_sm_surface_30 = 0 OR n_precipitation_30 = 0 OR n_u_30 + n_v_30 + n_u2_30 + n_v2_30 = 0
  OR c.elevation IS NULL OR {LOST} > 5"""


@query(
    "multiscale_features",
    f"""WITH {WINDOWS}, {X.EDGES}, {COVER}, {CENTRE}, {FINE_SQL.removeprefix(X.OBS + ",")},
        coarse AS (SELECT o.object_id, {COARSE_SQL} FROM valid o LEFT JOIN lineitem ON l_suppkey = o.site AND l_shipdate >= o.obs_date - 90 AND l_shipdate < o.obs_date GROUP BY o.object_id),
        hit AS (SELECT object_id, poly_id, any_value(biome_id) AS biome_id FROM valid JOIN edges ON {CROSSINGS} GROUP BY object_id, poly_id HAVING count(*) % 2 = 1),
        b AS (SELECT object_id, arg_min(biome_id, poly_id) AS biome_id FROM hit GROUP BY object_id),
        v AS (SELECT w.object_id, {", ".join(f'{e} AS "{k}"' for k, e in VARIABLES.items())}, c.* FROM w JOIN valid o USING (object_id)
          LEFT JOIN cells c ON c.cell_x = o.lon_m // 250 AND c.cell_y = o.lat_m // 250 WHERE NOT ({MULTI_GATE}))
        SELECT v.object_id, {", ".join(f"{s6(n)} AS {n}" for n in COARSE_NAMES)}, biome_id, {", ".join(f'{s6(f"""v."{k}" """)} AS "{k}"' for k in VARIABLES)},
          {", ".join(f"{s6(f'elevation * {i}.0::DOUBLE')} AS {n}" for i, n in enumerate(multiscale.CLIMATE, 1))}, p_partkey % 30 * 1.5::DOUBLE AS slope, landcover,
          {", ".join(_indices_sql(lag) for lag in LAGS)},
          {s6(f"CASE WHEN one.B8 IS NOT NULL THEN {_nd('one.B8', 'one.B4')} WHEN two.SR_B5 IS NOT NULL THEN {_nd('SR_B5', 'SR_B4')} ELSE 0.0::DOUBLE END")} AS fine_ndvi,
          {s6("coalesce(patch_density, 0.0::DOUBLE)")} AS patch_density, {s6("coalesce(shannon_diversity, 0.0::DOUBLE)")} AS shannon_diversity,
          {", ".join(f"coalesce({c}, 0) AS {c}" for c in COUNTS)}
        FROM v JOIN valid o USING (object_id) JOIN coarse USING (object_id) LEFT JOIN b USING (object_id) LEFT JOIN one USING (object_id) LEFT JOIN two USING (object_id)
          LEFT JOIN land ON land.lon_m = o.lon_m AND land.lat_m = o.lat_m LEFT JOIN near USING (object_id)""",
)
def multiscale_features(spark, sf):
    """The features of all scales behind the documented gate; texture has SQL of its own."""
    out = _multiscale(spark, sf)
    indices = [f"{v}_{lag}" for lag in LAGS for v in ("TCI", "VHI", "TVDI")]
    rounded = [*COARSE_NAMES, *VARIABLES, *multiscale.CLIMATE, *indices, "fine_ndvi", "patch_density", "shannon_diversity"]
    return out.select("object_id", *[r6(c).alias(c) for c in rounded], "biome_id", "slope", "landcover", *COUNTS)


@query("multiscale_table")
def multiscale_table(spark, sf):
    """The features with weighted copies, index and label; the features and the weights have SQL of their own."""
    return multiscale.integrate(_multiscale(spark, sf), "obs_date", "landcover", "presence")
