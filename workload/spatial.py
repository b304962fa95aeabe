"""Grids, polygons, distances, cells, land cover, texture and terrain."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsforge.functions.geo import EARTH_RADIUS_M, bounds_of_buffer
from obsforge.operators import context as K
from obsforge.operators import landscape as S
from obsforge.operators import spatial as P
from obsforge.session import shared_dir
from obsforge.sources import readers
from workload import fixtures as X
from workload.registry import query, r6, s6


@query(
    "context_counts",
    f"""WITH {X.VALID} SELECT a.object_id,
        CAST(floor((b.lat_m - a.lat_m) / {X.GRID_STEP}.0::DOUBLE + 3.5::DOUBLE) AS INTEGER) AS "row",
        CAST(floor((b.lon_m - a.lon_m) / {X.GRID_STEP}.0::DOUBLE + 3.5::DOUBLE) AS INTEGER) AS col,
        {", ".join(f"count(*) FILTER (a.obs_date - b.obs_date BETWEEN {lo} AND {hi} AND b.presence = '{p}') AS {k}_{n}"
          for n, lo, hi in K.PERIODS for k, p in K.COUNT_CLASSES.items())}
        FROM obs a JOIN valid b ON b.obs_date < a.obs_date AND b.obs_date >= a.obs_date - 90
          AND b.lat_m >= a.lat_m - 875 AND b.lat_m < a.lat_m + 875 AND b.lon_m >= a.lon_m - 875 AND b.lon_m < a.lon_m + 875
        GROUP BY ALL""",
)
def context_counts(spark, sf):
    obs = X.observations(spark, sf)
    return K.context_counts(obs, obs, "object_id", "lon_m", "lat_m", "obs_date", "presence", X.GRID_STEP)


@query(
    "context_grid_dense",
    f"""WITH {X.VALID}, met AS (SELECT a.object_id,
        CAST(floor((b.lat_m - a.lat_m) / {X.GRID_STEP}.0::DOUBLE + 3.5::DOUBLE) AS INTEGER) AS "row",
        CAST(floor((b.lon_m - a.lon_m) / {X.GRID_STEP}.0::DOUBLE + 3.5::DOUBLE) AS INTEGER) AS col, a.obs_date - b.obs_date AS back, b.presence
        FROM obs a JOIN valid b ON b.obs_date < a.obs_date AND b.obs_date >= a.obs_date - 90
          AND b.lat_m >= a.lat_m - 875 AND b.lat_m < a.lat_m + 875 AND b.lon_m >= a.lon_m - 875 AND b.lon_m < a.lon_m + 875)
        SELECT o.object_id, CAST(i AS INTEGER) AS "row", CAST(j AS INTEGER) AS col,
        {", ".join(f"count(*) FILTER (back BETWEEN {lo} AND {hi} AND m.presence = '{p}') AS {k}_{n}"
          for n, lo, hi in K.PERIODS for k, p in K.COUNT_CLASSES.items())}
        FROM obs o CROSS JOIN range(7) r(i) CROSS JOIN range(7) c(j)
        LEFT JOIN met m ON m.object_id = o.object_id AND m."row" = i AND m.col = j GROUP BY ALL""",
)
def context_grid_dense(spark, sf):
    """All 49 cells of every sample, with zeros where nothing was reported."""
    obs = X.observations(spark, sf)
    return K.dense_counts(obs, obs, "object_id", "lon_m", "lat_m", "obs_date", "presence", X.GRID_STEP)


DISTANCE = "2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
MERIDIAN = """c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 179.9 - c_custkey % 40 / 500.0::DOUBLE ELSE c_custkey % 40 / 500.0::DOUBLE - 179.9 END::DOUBLE AS lon,
  (c_custkey % 97 / 100.0::DOUBLE - 0.4)::DOUBLE AS lat FROM customer),
  s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 180.0 - s_suppkey % 7 / 100.0::DOUBLE ELSE s_suppkey % 7 / 100.0::DOUBLE - 180.0 END::DOUBLE AS lon,
  (s_suppkey % 89 / 100.0::DOUBLE - 0.4)::DOUBLE AS lat FROM supplier)"""


def _meridian(spark, sf, name, key, far, modulo, share, lat):
    k = F.col(key)
    near = (k % modulo).cast("double") / share
    lon = F.when(k % 2 == 0, F.lit(far) - near).otherwise(near - F.lit(far))
    return X.table(spark, sf, name).select(k, lon.alias("lon"), ((k % lat).cast("double") / 100.0 - 0.4).alias("lat"))


@query("pairs_across_meridian", f"WITH {MERIDIAN} SELECT a.c_custkey, b.s_suppkey FROM c a JOIN s b ON {DISTANCE} <= 9000")
def pairs_across_meridian(spark, sf):
    """Customers and suppliers on both sides of the 180th meridian."""
    centres = _meridian(spark, sf, "customer", "c_custkey", 179.9, 40, 500.0, 97).toDF("c_custkey", "c_lon", "c_lat")
    points = _meridian(spark, sf, "supplier", "s_suppkey", 180.0, 7, 100.0, 89)
    return P.within_distance(centres, points, 9000.0, "c_lon", "c_lat", "lon", "lat").select("c_custkey", "s_suppkey")


@query(
    "absence_across_meridian",
    f"WITH {MERIDIAN} SELECT c_custkey FROM c a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE {DISTANCE} <= 9000)",
)
def absence_across_meridian(spark, sf):
    centres = _meridian(spark, sf, "customer", "c_custkey", 179.9, 40, 500.0, 97)
    points = _meridian(spark, sf, "supplier", "s_suppkey", 180.0, 7, 100.0, 89)
    return P.drop_near(centres, points, 9000.0, "lon", "lat").select("c_custkey")


@query(
    "grid_cells",
    """SELECT c_custkey, CAST(i + 3 AS INTEGER) AS "row", CAST(j + 3 AS INTEGER) AS col, c_custkey % 15000 + j * 250.0::DOUBLE AS center_lon,
       c_custkey % 12000 + i * 250.0::DOUBLE AS center_lat, c_custkey % 15000 + j * 250.0::DOUBLE - 125.0::DOUBLE AS min_lon,
       c_custkey % 12000 + i * 250.0::DOUBLE + 125.0::DOUBLE AS max_lat
       FROM customer, range(-3, 4) t(i), range(-3, 4) u(j)""",
)
def grid_cells(spark, sf):
    k = F.col("c_custkey")
    points = X.table(spark, sf, "customer").select(k, (k % 15000).alias("lon"), (k % 12000).alias("lat"))
    return K.grid_cells(points, "lon", "lat", 250.0).select(
        "c_custkey", "row", "col", "center_lon", "center_lat", "min_lon", "max_lat"
    )


CROSSINGS = """(y1 > lat_m) <> (y2 > lat_m) AND lon_m < (x2 - x1) * (lat_m - y1) / nullif(y2 - y1, 0) + x1"""


@query(
    "points_in_polygon",
    f"""WITH {X.OBS}, {X.EDGES} SELECT object_id, country FROM obs
        WHERE (SELECT count(*) FROM edges WHERE country_na = 'west' AND {CROSSINGS}) % 2 = 1""",
)
def points_in_polygon(spark, sf):
    west = X.edges(spark).where(F.col("country_na") == "west")
    inside = P.points_in_polygons(X.observations(spark, sf), west, "lon_m", "lat_m", "poly_id", X.STRIP)
    return inside.select("object_id", "country")


@query(
    "polygon_biome",
    f"""WITH {X.OBS}, {X.EDGES}, hit AS (
        SELECT object_id, poly_id, any_value(biome_id) AS biome_id FROM obs JOIN edges ON {CROSSINGS}
        GROUP BY object_id, poly_id HAVING count(*) % 2 = 1)
        SELECT obs.object_id, (SELECT arg_min(biome_id, poly_id) FROM hit WHERE hit.object_id = obs.object_id) AS biome_id FROM obs""",
)
def polygon_biome(spark, sf):
    out = P.polygon_attribute(X.observations(spark, sf), X.edges(spark), "lon_m", "lat_m", "poly_id", "biome_id", X.STRIP)
    return out.select("object_id", "biome_id")


AREA_HITS = f"""hit AS (
        SELECT s.lon_m, s.lat_m, poly_id, any_value(nation) AS nation FROM (SELECT DISTINCT lon_m, lat_m FROM obs) s JOIN areas ON {CROSSINGS}
        GROUP BY s.lon_m, s.lat_m, poly_id HAVING count(*) % 2 = 1)"""


@query(
    "area_of_supplier",
    f"""WITH {X.OBS}, {X.AREAS}, {AREA_HITS}, first AS (SELECT lon_m, lat_m, arg_min(nation, poly_id) AS nation, count(*) AS n FROM hit GROUP BY ALL)
        SELECT object_id, nation FROM obs LEFT JOIN first USING (lon_m, lat_m)""",
)
def area_of_supplier(spark, sf):
    """J2 with as many polygons as suppliers: the nation of the first area around each observation."""
    edges = P.polygon_edges(X.areas(spark, sf), "poly_id", "ring", ["nation"])
    out = P.polygon_attribute(X.observations(spark, sf), edges, "lon_m", "lat_m", "poly_id", "nation", X.AREA_CELL)
    return out.select("object_id", "nation")


@query(
    "boundary_areas",
    f"""WITH {X.OBS}, {X.AREAS}, {AREA_HITS} SELECT object_id, country FROM obs SEMI JOIN (SELECT * FROM hit WHERE nation IN (3, 8)) h
        ON obs.lon_m = h.lon_m AND obs.lat_m = h.lat_m""",
)
def boundary_areas(spark, sf):
    """Areas written as a boundary table, those of two nations read back, observations inside any of them."""
    path = shared_dir(spark, "areas")
    X.areas(spark, sf).write.parquet(path)
    chosen = [readers.read_boundary(spark, path, "nation", value) for value in ("3", "8")]
    edges = P.polygon_edges(chosen[0].unionByName(chosen[1]), "poly_id", "ring")
    inside = P.points_in_polygons(X.observations(spark, sf), edges, "lon_m", "lat_m", "poly_id", X.AREA_CELL)
    return inside.select("object_id", "country")


def _haversine(lon1, lat1, lon2, lat2):
    a = f"""pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"""
    return f"2 * {EARTH_RADIUS_M}::DOUBLE * asin(sqrt({a}))"


PRESENT = """spots AS (SELECT DISTINCT lon_m / 1000.0::DOUBLE AS lon, lat_m / 1000.0::DOUBLE AS lat FROM obs WHERE presence = 'PRESENT')"""


def _present(spark, sf):
    return X.observations(spark, sf).where(F.col("presence") == "PRESENT").select((F.col("lon_m") / 1000.0).alias("lon"), (F.col("lat_m") / 1000.0).alias("lat"))


@query(
    "pseudo_absence",
    f"""WITH {X.OBS}, {X.CANDIDATES}, {PRESENT} SELECT id, lon, lat FROM cand
        WHERE NOT EXISTS (SELECT 1 FROM spots WHERE {_haversine("cand.lon", "cand.lat", "spots.lon", "spots.lat")} <= 10000)""",
)
def pseudo_absence(spark, sf):
    return P.drop_near(X.candidates(spark, sf), _present(spark, sf), 10000.0, "lon", "lat")


@query(
    "presence_with_pseudo_absence",
    f"""WITH {X.OBS}, {X.CANDIDATES}, {PRESENT} SELECT object_id, lon_m / 1000.0::DOUBLE AS lon, obs_date AS day, 1 AS label FROM obs WHERE presence = 'PRESENT'
        UNION ALL SELECT id, lon, DATE '2020-01-01', 0 FROM cand
        WHERE NOT EXISTS (SELECT 1 FROM spots WHERE {_haversine("cand.lon", "cand.lat", "spots.lon", "spots.lat")} <= 10000)""",
)
def presence_with_pseudo_absence(spark, sf):
    present = X.observations(spark, sf).where(F.col("presence") == "PRESENT").select(
        "object_id", (F.col("lon_m") / 1000.0).alias("lon"), F.col("obs_date").alias("day"), F.lit(1).alias("label")
    )
    absent = P.drop_near(X.candidates(spark, sf), _present(spark, sf), 10000.0, "lon", "lat").select(
        F.col("id").alias("object_id"), "lon", F.lit("2020-01-01").cast("date").alias("day"), F.lit(0).alias("label")
    )
    return present.unionByName(absent, allowMissingColumns=True)


@query(
    "within_distance",
    f"""WITH {X.CANDIDATES}, spots AS (SELECT p_partkey, (132 + p_partkey % 60 + 0.5::DOUBLE) * 0.25::DOUBLE AS p_lon, (12 + p_partkey // 60 + 0.5::DOUBLE) * 0.25::DOUBLE AS p_lat FROM part)
        SELECT id, p_partkey, round({_haversine("lon", "lat", "p_lon", "p_lat")}, 3) AS distance_m FROM cand JOIN spots
          ON abs(lat - p_lat) < 0.1 AND {_haversine("lon", "lat", "p_lon", "p_lat")} <= 5000""",
)
def within_distance(spark, sf):
    spots = P.pixel_coordinates(X.cells(spark, sf), 0.25).select(
        "p_partkey", F.col("longitude").alias("p_lon"), F.col("latitude").alias("p_lat")
    )
    out = P.within_distance(X.candidates(spark, sf), spots, 5000.0, "lon", "lat", "p_lon", "p_lat")
    return out.select("id", "p_partkey", F.round("distance_m", 3).alias("distance_m"))


@query(
    "bounding_box",
    f"WITH {X.OBS} SELECT min(lon_m) AS min_lon, max(lon_m) AS max_lon, min(lat_m) AS min_lat, max(lat_m) AS max_lat FROM obs WHERE presence = 'PRESENT'",
)
def bounding_box(spark, sf):
    return P.bounding_box(X.observations(spark, sf).where(F.col("presence") == "PRESENT"), "lon_m", "lat_m")


@query(
    "buffer_bounds",
    f"""WITH {X.CANDIDATES} SELECT id, {s6("lon - 1120 / 111000.0::DOUBLE / cos(radians(lat))")} AS min_lon,
        {s6("lon + 1120 / 111000.0::DOUBLE / cos(radians(lat))")} AS max_lon, {s6("lat - 1120 / 111000.0::DOUBLE")} AS min_lat,
        {s6("lat + 1120 / 111000.0::DOUBLE")} AS max_lat FROM cand""",
)
def buffer_bounds(spark, sf):
    box = bounds_of_buffer(F.col("lon"), F.col("lat"), 1120.0)
    return X.candidates(spark, sf).select("id", *[r6(c).alias(k) for k, c in box.items()])


@query(
    "random_points",
    f"""WITH {X.OBS}, box AS (SELECT min(lon_m) AS a, max(lon_m) AS b, min(lat_m) AS c, max(lat_m) AS d FROM obs WHERE presence = 'PRESENT'),
        n AS (SELECT range AS id FROM range(3300)),
        u AS (SELECT id, ('0x' || substr(md5('84:' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS x,
                     ('0x' || substr(md5('85:' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS y FROM n)
        SELECT id, {s6("a + x * (b - a)")} AS lon, {s6("c + y * (d - c)")} AS lat FROM u, box""",
)
def random_points(spark, sf):
    box = P.bounding_box(X.observations(spark, sf).where(F.col("presence") == "PRESENT"), "lon_m", "lat_m")
    return P.random_points(box, 3300, 42).select("id", r6("lon").alias("lon"), r6("lat").alias("lat"))


@query(
    "sample_cells",
    f"""WITH {X.OBS}, {X.CELLS} SELECT object_id, elevation, landcover FROM obs JOIN cells
        ON cell_x = lon_m // 250 AND cell_y = lat_m // 250""",
)
def sample_cells(spark, sf):
    out = P.sample_cells(X.observations(spark, sf), X.cells(spark, sf), F.col("lon_m"), F.col("lat_m"), 250.0, ["elevation", "landcover"])
    return out.select("object_id", "elevation", "landcover")


@query(
    "rasterise_presence",
    f"""WITH {X.OBS}, {X.CELLS}, hit AS (SELECT DISTINCT lon_m // 250 AS cell_x, lat_m // 250 AS cell_y FROM obs WHERE presence = 'PRESENT')
        SELECT p_partkey, (cells.cell_x + 0.5::DOUBLE) * 250.0::DOUBLE AS longitude, (cells.cell_y + 0.5::DOUBLE) * 250.0::DOUBLE AS latitude,
          CASE WHEN hit.cell_x IS NULL THEN 0 ELSE 1 END AS label FROM cells LEFT JOIN hit USING (cell_x, cell_y)""",
)
def rasterise_presence(spark, sf):
    present = X.observations(spark, sf).where(F.col("presence") == "PRESENT")
    out = P.pixel_coordinates(P.rasterise(X.cells(spark, sf), present, F.col("lon_m"), F.col("lat_m"), 250.0), 250.0)
    return out.select("p_partkey", "longitude", "latitude", "label")


@query(
    "class_histogram",
    """SELECT c_nationkey, c_mktsegment, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY c_nationkey) AS BIGINT) AS total
       FROM customer GROUP BY c_nationkey, c_mktsegment""",
)
def class_histogram(spark, sf):
    return S.class_histogram(X.table(spark, sf, "customer"), ["c_nationkey"], "c_mktsegment").drop("share")


@query(
    "histogram_map",
    """WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)
       SELECT c_nationkey, string_agg(c_mktsegment || '=' || n, ';' ORDER BY c_mktsegment) AS histogram FROM c GROUP BY c_nationkey""",
)
def histogram_map(spark, sf):
    h = S.histogram_map(X.table(spark, sf, "customer"), ["c_nationkey"], "c_mktsegment")
    text = F.transform(F.map_entries("histogram"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return h.select("c_nationkey", F.array_join(F.array_sort(text), ";").alias("histogram"))


@query(
    "landscape_metrics",
    f"""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL),
        p AS (SELECT c_nationkey, n / CAST(sum(n) OVER (PARTITION BY c_nationkey) AS DOUBLE) AS p FROM c)
        SELECT c_nationkey, {s6("count(*) / (pi() * 2000.0::DOUBLE * 2000.0::DOUBLE) * 1000000")} AS patch_density,
          {s6("-sum(p * ln(p))")} AS shannon_diversity FROM p GROUP BY c_nationkey""",
)
def landscape_metrics(spark, sf):
    m = S.landscape_metrics(X.table(spark, sf, "customer"), ["c_nationkey"], "c_mktsegment")
    return m.select("c_nationkey", *[r6(c).alias(c) for c in ("patch_density", "shannon_diversity")])


LEVELS = """lev AS (SELECT file_key, band, "row", col, CAST(floor((value + 1) * 4) AS INTEGER) AS g FROM pix)"""
PAIRS = " UNION ALL ".join(
    f"""SELECT a.file_key, a.band, {x}.g AS i, {y}.g AS j FROM lev a JOIN lev b ON b.file_key = a.file_key AND b.band = a.band AND b.col = a.col + {dx} AND b."row" = a."row" + {dy}"""
    for dx, dy in S.TEXTURE_OFFSETS.values()
    for x, y in (("a", "b"), ("b", "a"))
)


def levels(spark, sf):
    from obsforge.operators.pixels import clean_pixels

    pix = clean_pixels(X.pixels(spark, sf))
    return pix.withColumn("g", F.floor((F.col("value") + 1) * 4).cast("int"))


@query(
    "glcm_texture",
    f"""WITH {X.PIX}, {LEVELS}, pairs AS ({PAIRS}), q AS (SELECT file_key, band, i, j, count(*) AS n FROM pairs GROUP BY ALL),
        t AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY file_key, band) AS DOUBLE) AS p FROM q),
        m AS (SELECT *, sum(p * i) OVER (PARTITION BY file_key, band) AS mu FROM t),
        s AS (SELECT file_key, band, sum(p * (i - j) * (i - j)) AS contrast, sum(p * (i - mu) * (j - mu)) AS cov,
              -sum(p * ln(p)) AS entropy, sum(p * (i - mu) * (i - mu)) AS var FROM m GROUP BY file_key, band)
        SELECT file_key, band, {s6("contrast")} AS texture_contrast, {s6("CASE WHEN var > 1e-12 THEN cov / var END")} AS texture_correlation,
          {s6("entropy")} AS texture_entropy, {s6("var")} AS texture_variance FROM s""",
)
def glcm_texture(spark, sf):
    t = S.glcm(levels(spark, sf), ["file_key", "band"], "row", "col", "g")
    return t.select("file_key", "band", *[r6(c).alias(c) for c in t.columns if c not in ("file_key", "band")])


NEAR_PAIRS = " UNION ALL ".join(
    f"""SELECT a.file_key, a.band, a.y, a.x, {p}.g AS i, {q}.g AS j FROM win a JOIN win b ON b.file_key = a.file_key AND b.band = a.band AND b.y = a.y AND b.x = a.x
        AND b.col = a.col + {dx} AND b."row" = a."row" + {dy}"""
    for dx, dy in S.TEXTURE_OFFSETS.values()
    for p, q in (("a", "b"), ("b", "a"))
)


@query(
    "glcm_pixels",
    f"""WITH {X.PIX}, {LEVELS}, win AS (SELECT l.*, "row" + dy AS y, col + dx AS x FROM lev l, range(-1, 2) r(dy), range(-1, 2) c(dx)
          WHERE "row" + dy BETWEEN 0 AND 7 AND col + dx BETWEEN 0 AND 7),
        pairs AS ({NEAR_PAIRS}), q AS (SELECT file_key, band, y, x, i, j, count(*) AS n FROM pairs GROUP BY ALL),
        t AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY file_key, band, y, x) AS DOUBLE) AS p FROM q),
        m AS (SELECT *, sum(p * i) OVER (PARTITION BY file_key, band, y, x) AS mu FROM t),
        s AS (SELECT file_key, band, y, x, sum(p * (i - j) * (i - j)) AS contrast, sum(p * (i - mu) * (j - mu)) AS cov,
              -sum(p * ln(p)) AS entropy, sum(p * (i - mu) * (i - mu)) AS var FROM m GROUP BY ALL)
        SELECT file_key, band, CAST(y AS INTEGER) AS "row", CAST(x AS INTEGER) AS col, {s6("contrast")} AS texture_contrast,
          {s6("CASE WHEN var > 1e-9 THEN cov / var END")} AS texture_correlation, {s6("entropy")} AS texture_entropy, {s6("var")} AS texture_variance FROM s""",
)
def glcm_pixels(spark, sf):
    """Texture in a 3 x 3 window around every pixel."""
    t = S.glcm_pixels(levels(spark, sf), ["file_key", "band"], "row", "col", "g")
    return t.select("file_key", "band", "row", "col", *[r6(c).alias(c) for c in t.columns if c.startswith("texture_")])


@query(
    "terrain",
    f"""WITH {X.CELLS}, g AS (SELECT c.cell_x, c.cell_y, (e.elevation - w.elevation) / 500.0::DOUBLE AS dx, (n.elevation - s.elevation) / 500.0::DOUBLE AS dy
          FROM cells c LEFT JOIN cells e ON e.cell_x = c.cell_x + 1 AND e.cell_y = c.cell_y
          LEFT JOIN cells w ON w.cell_x = c.cell_x - 1 AND w.cell_y = c.cell_y
          LEFT JOIN cells n ON n.cell_x = c.cell_x AND n.cell_y = c.cell_y + 1
          LEFT JOIN cells s ON s.cell_x = c.cell_x AND s.cell_y = c.cell_y - 1),
        h AS (SELECT *, degrees(atan2(-dx, -dy)) AS a FROM g)
        SELECT cell_x, cell_y, {s6("degrees(atan(sqrt(dx * dx + dy * dy)))")} AS slope,
          {s6("CASE WHEN dx = 0 AND dy = 0 THEN 0.0::DOUBLE WHEN a < 0 THEN a + 360 ELSE a END")} AS aspect FROM h""",
)
def terrain(spark, sf):
    t = S.terrain(X.cells(spark, sf), [], "cell_x", "cell_y", "elevation", 250.0)
    return t.select("cell_x", "cell_y", r6("slope").alias("slope"), r6("aspect").alias("aspect"))
