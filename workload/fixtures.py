"""The shared tables in the shape the operators expect: DataFrames and the same as SQL.

Every view covers its whole table. Positions are whole milli-degrees, so both
engines put them into the same cell. The number of places grows with the tables.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsforge.sources.catalogue import SOURCES

GRID_STEP = 250  # milli-degrees
MEASURED = 13  # bands dealt out over the measurements
# the catalogue's bands in its order, with the reflectance pair as one at the end
BANDS = tuple((s.collection, s.band) for s in SOURCES if s.variable != "NDWI_pair") + tuple(
    sorted({(s.collection, "sur_refl") for s in SOURCES if s.variable == "NDWI_pair"})
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as observations; `site` and `scene_site` name the place of the measurements and scenes."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    presence = F.when(F.col("o_orderstatus") == "F", "PRESENT").when(F.col("o_orderstatus") == "O", "ABSENT").otherwise("UNKNOWN")
    k = F.col("o_custkey")
    j = k % 12000  # same latitude as with k, and no overflow for large keys
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .select(
            F.col("o_orderkey").alias("object_id"),
            F.to_date("o_orderdate").alias("obs_date"),
            presence.alias("presence"),
            F.col("n_name").alias("country"),
            (F.lit(33000) + (k * 7919) % 15000).cast("bigint").alias("lon_m"),
            (F.lit(3000) + (j * j * 17 + j * 29) % 12000).cast("bigint").alias("lat_m"),
            F.floor(k / 15).alias("site"),
            F.floor(k / 10).alias("scene_site"),
            F.col("o_totalprice").alias("price"),
        )
    )


OBS = """obs AS (
  SELECT o_orderkey AS object_id, CAST(o_orderdate AS DATE) AS obs_date,
         CASE o_orderstatus WHEN 'F' THEN 'PRESENT' WHEN 'O' THEN 'ABSENT' ELSE 'UNKNOWN' END AS presence,
         n_name AS country,
         CAST(33000 + (o_custkey * 7919) % 15000 AS BIGINT) AS lon_m,
         CAST(3000 + ((o_custkey % 12000) * (o_custkey % 12000) * 17 + (o_custkey % 12000) * 29) % 12000 AS BIGINT) AS lat_m,
         o_custkey // 15 AS site, o_custkey // 10 AS scene_site, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).where(F.col("presence").isin("PRESENT", "ABSENT"))


VALID = OBS + ",\nvalid AS (SELECT * FROM obs WHERE presence IN ('PRESENT', 'ABSENT'))"


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as one source per return flag; whole-number values, so that sums are exact."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("site"),
        F.concat(F.lit("src_"), "l_returnflag").alias("source"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("value"),
        F.col("l_extendedprice").alias("price"),
    )


MEAS = """meas AS (
  SELECT l_suppkey AS site, 'src_' || l_returnflag AS source, CAST(l_shipdate AS DATE) AS ts,
         l_quantity AS value, l_extendedprice AS price
  FROM lineitem)"""


def environment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as measurements of thirteen bands; reflectance comes as a pair of bands."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.pmod(F.col("l_partkey"), F.lit(MEASURED)).cast("int")
    source = F.element_at(F.array(*[F.lit(s) for s, _ in BANDS]), kind + 1)
    band = F.element_at(F.array(*[F.lit(b) for _, b in BANDS]), kind + 1)
    pair = F.array(
        F.struct(F.lit("sur_refl_b02").alias("band"), F.col("l_quantity").alias("value")),
        F.struct(F.lit("sur_refl_b06").alias("band"), F.floor(F.col("l_extendedprice") / 1000).cast("double").alias("value")),
    )
    single = F.array(F.struct(band.alias("band"), F.col("l_quantity").alias("value")))
    return li.select(
        F.col("l_suppkey").alias("site"),
        source.alias("source"),
        # the line's own time of day keeps two reflectance pairs of one day apart
        F.expr("timestampadd(MICROSECOND, l_orderkey * 8 + l_linenumber, l_shipdate)").alias("ts"),
        F.explode(F.when(kind == MEASURED - 1, pair).otherwise(single)).alias("b"),
    ).select("site", "source", "ts", "b.band", "b.value")


ENV = """env AS (
  SELECT l_suppkey AS site, l_partkey % 13 AS kind, CAST(l_shipdate AS DATE) AS day, l_quantity AS value
  FROM lineitem
  UNION ALL
  SELECT site, 13, day, (a - b) / (a + b) FROM (
    SELECT l_suppkey AS site, CAST(l_shipdate AS DATE) AS day, max(l_quantity) AS a, max(floor(l_extendedprice / 1000)) AS b
    FROM lineitem WHERE l_partkey % 13 = 12 GROUP BY l_suppkey, l_shipdate, l_orderkey * 8 + l_linenumber))"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as static cells; the grid goes north as the table grows."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        (F.lit(132) + k % 60).alias("cell_x"),
        (F.lit(12) + F.floor(k / 60)).alias("cell_y"),
        F.col("p_retailprice").alias("elevation"),
        F.col("p_size").alias("landcover"),
        k.alias("p_partkey"),
    )


CELLS = """cells AS (
  SELECT 132 + p_partkey % 60 AS cell_x, 12 + p_partkey // 60 AS cell_y, p_retailprice AS elevation,
         p_size AS landcover, p_partkey
  FROM part)"""


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("scene_id"),
        F.col("user_id").alias("scene_site"),
        "ts",
        F.floor(F.col("value")).alias("whole"),
        F.floor(F.col("value") % 100).cast("double").alias("cloud"),
        *[F.floor(F.col("value") * m % 997).cast("double").alias(b) for b, m in SCENE_BANDS.items()],
    )


SCENE_BANDS = {"B2": 3, "B3": 5, "B4": 7, "B5": 11, "B8": 13, "SR_B3": 17, "SR_B4": 19, "SR_B5": 23}
SCENES = (
    "scenes AS (\n  SELECT event_id AS scene_id, user_id AS scene_site, ts, CAST(ts AS DATE) AS day,\n"
    "         CAST(floor(value) AS BIGINT) AS whole, CAST(floor(value % 100) AS DOUBLE) AS cloud,\n         "
    + ", ".join(f"CAST(floor(value * {m} % 997) AS DOUBLE) AS {b}" for b, m in SCENE_BANDS.items())
    + "\n  FROM events)"
)


def scene_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All observations moved into the month the scenes cover."""
    return observations(spark, sf_dir).withColumn(
        "obs_date", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("object_id") % 30).cast("int"))
    )


SCENE_OBS = OBS + """,
sobs AS (SELECT * REPLACE (CAST(DATE '2024-01-01' + CAST(object_id % 30 AS INTEGER) AS DATE) AS obs_date) FROM obs)"""


# corners of two polygons in milli-degrees: a concave one and a box that overlaps it
POLYGONS = {
    1: (14, "west", ((36000, 5000), (46000, 5000), (46000, 14000), (41000, 8000), (36000, 14000))),
    2: (7, "east", ((43000, 4000), (47500, 4000), (47500, 9000), (43000, 9000))),
}
STRIP = 500.0  # side of the cells of large polygons and of small ones
AREA_CELL = 100.0


def edges(spark: SparkSession) -> DataFrame:
    rows = [
        (poly, biome, name, float(x1), float(y1), float(x2), float(y2))
        for poly, (biome, name, ring) in POLYGONS.items()
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])
    ]
    return spark.createDataFrame(
        rows, "poly_id INT, biome_id INT, country_na STRING, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
    )


EDGES = (
    "edges(poly_id, biome_id, country_na, x1, y1, x2, y2) AS (VALUES "
    + ", ".join(
        f"({poly}, {biome}, '{name}', {x1}.0::DOUBLE, {y1}.0::DOUBLE, {x2}.0::DOUBLE, {y2}.0::DOUBLE)"
        for poly, (biome, name, ring) in POLYGONS.items()
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])
    )
    + ")"
)


CORNERS = 32
# directions of a polygon's corners from its centre, in thousandths
DIRECTIONS = [(round(1000 * math.cos(2 * math.pi * i / CORNERS)), round(1000 * math.sin(2 * math.pi * i / CORNERS))) for i in range(CORNERS)]


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One polygon per supplier, with corners at uneven distances around a centre; more suppliers have smaller and more polygons."""
    k = F.col("s_suppkey")
    east, north = (F.array(*[F.lit(d[axis]) for d in DIRECTIONS]) for axis in (0, 1))

    def corner(i):
        reach = F.lit(200) + ((k * 37 + i * 53) % 9) * 60
        x = F.lit(33000) + (k * 6133) % 15000 + F.get(east, i) * reach / F.lit(1000.0)
        y = F.lit(3000) + (k * 4099) % 12000 + F.get(north, i) * reach / F.lit(1000.0)
        return F.struct(x.alias("x"), y.alias("y"))

    ring = F.transform(F.sequence(F.lit(0), F.lit(CORNERS - 1)), corner).alias("ring")
    return table(spark, sf_dir, "supplier").select(k.alias("poly_id"), F.col("s_nationkey").alias("nation"), ring)


AREAS = f"""dirs(i, dx, dy) AS (VALUES {", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(DIRECTIONS))}),
corner AS (
  SELECT s_suppkey AS poly_id, s_nationkey AS nation, i,
         33000 + (s_suppkey * 6133) % 15000 + dx * (200 + ((s_suppkey * 37 + i * 53) % 9) * 60) / 1000.0::DOUBLE AS x,
         3000 + (s_suppkey * 4099) % 12000 + dy * (200 + ((s_suppkey * 37 + i * 53) % 9) * 60) / 1000.0::DOUBLE AS y
  FROM supplier, dirs),
areas AS (
  SELECT a.poly_id, a.nation, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM corner a JOIN corner b ON a.poly_id = b.poly_id AND b.i = (a.i + 1) % {CORNERS})"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    j = k % 12000
    return table(spark, sf_dir, "customer").select(
        k.alias("id"),
        ((F.lit(33000) + (k * 6133 + 17) % 15000) / 1000.0).alias("lon"),
        ((F.lit(3000) + (j * j * 7 + j * 101) % 12000) / 1000.0).alias("lat"),
    )


CANDIDATES = """cand AS (
  SELECT c_custkey AS id, (33000 + (c_custkey * 6133 + 17) % 15000) / 1000.0::DOUBLE AS lon,
         (3000 + ((c_custkey % 12000) * (c_custkey % 12000) * 7 + (c_custkey % 12000) * 101) % 12000) / 1000.0::DOUBLE AS lat
  FROM customer)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as predictions, with ties among the scores."""
    p = ((F.col("doc_id") * 37 + F.col("quality") * 350) % 1000) / 1000.0
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("y_true"), (p > 0.5).cast("int").alias("y_pred"), p.alias("y_prob")
    )


PRED = """pred AS (
  SELECT doc_id AS id, quality AS y_true,
         CASE WHEN ((doc_id * 37 + quality * 350) % 1000) / 1000.0::DOUBLE > 0.5 THEN 1 ELSE 0 END AS y_pred,
         ((doc_id * 37 + quality * 350) % 1000) / 1000.0::DOUBLE AS y_prob
  FROM labels)"""

PIX_SIDE = 8
LABEL_BAND = 59


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as tiles of one input band and a label band; the last input pixels hold NaN and NULL."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    value = F.col("v").cast("double")
    at = [F.floor(F.col("i") / PIX_SIDE).cast("int").alias("row"), (F.col("i") % PIX_SIDE).cast("int").alias("col")]
    dirty = F.when(F.col("i") == 61, F.lit(float("nan"))).when(F.col("i") == 62, F.lit(float("inf"))).when(F.col("i") == 63, F.lit(None)).otherwise(value)
    bands = F.array(
        F.struct(F.lit(0).alias("band"), dirty.alias("value")),
        F.struct(F.lit(LABEL_BAND).alias("band"), ((F.col("label") > 4) & (F.col("v") > -2)).cast("double").alias("value")),
    )
    return e.select(F.col("vec_id").alias("file_key"), *at, F.explode(bands).alias("b")).select(
        "file_key", "b.band", "row", "col", "b.value"
    )


PIX = """raw AS (
  SELECT vec_id AS file_key, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
pix AS (
  SELECT file_key, 0 AS band, CAST(i // 8 AS INTEGER) AS "row", CAST(i % 8 AS INTEGER) AS col,
         CASE WHEN i IN (61, 62, 63) THEN 0.0::DOUBLE ELSE CAST(v AS DOUBLE) END AS value, label FROM raw
  UNION ALL
  SELECT file_key, 59, CAST(i // 8 AS INTEGER), CAST(i % 8 AS INTEGER),
         CASE WHEN label > 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, label FROM raw)"""


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per supplier, of uneven sides around the usual 41, with three input bands and a label band."""
    k, band, row, col = F.col("s_suppkey"), F.col("band"), F.col("row"), F.col("col")
    files = table(spark, sf_dir, "supplier").select(k, F.explode(F.array(*[F.lit(b) for b in (0, 1, 2, LABEL_BAND)])).alias("band"))
    rows = files.withColumn("row", F.explode(F.sequence(F.lit(0), (F.lit(29) + k % 23).cast("int"))))
    cells = rows.withColumn("col", F.explode(F.sequence(F.lit(0), (F.lit(32) + k % 17).cast("int"))))
    dirty = (row == 3) & (col == 4)
    value = ((k * 31 + band * 17 + row * 7 + col * 3 + row * col % 13) % 101) / F.lit(10.0)
    mask = ((k + F.floor(row / 5) + F.floor(col / 7)) % 2).cast("double")
    kept = F.when(band == LABEL_BAND, mask).when(dirty, F.lit(float("nan"))).otherwise(value)
    return cells.select(k.alias("file_key"), "band", "row", "col", kept.alias("value"))


TILES = """files AS (SELECT s_suppkey AS k, 30 + s_suppkey % 23 AS h, 33 + s_suppkey % 17 AS w FROM supplier),
tile AS MATERIALIZED (
  SELECT k AS file_key, h, w, band, r AS y, c AS x,
         CASE WHEN r = 3 AND c = 4 THEN 0.0::DOUBLE ELSE ((k * 31 + band * 17 + r * 7 + c * 3 + r * c % 13) % 101) / 10.0::DOUBLE END AS value
  FROM (SELECT *, unnest(range(w)) AS c FROM (SELECT *, unnest(range(h)) AS r FROM (SELECT *, unnest([0, 1, 2]) AS band FROM files))))"""


def raw_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with their date as free text; every seventh text is broken in one of five ways."""
    obs = observations(spark, sf_dir)
    good = F.concat_ws("/", F.month("obs_date"), F.dayofmonth("obs_date"), F.year("obs_date"))
    k = F.col("object_id")
    text = (
        F.when(k % 35 == 0, F.lit(""))
        .when(k % 35 == 7, F.lit("13/40/2019"))
        .when(k % 35 == 14, F.date_format("obs_date", "yyyy-MM-dd"))
        .when(k % 35 == 21, F.lit("1/2"))
        .when(k % 35 == 28, F.lit(None).cast("string"))
        .when(k % 3 == 0, F.concat(good, F.lit(" 12:00:00 AM")))
        .otherwise(good)
    )
    return obs.withColumn("obs_text", text)


RAW = OBS + """,
texts AS (
  SELECT *, CASE WHEN object_id % 35 = 0 THEN '' WHEN object_id % 35 = 7 THEN '13/40/2019'
                 WHEN object_id % 35 = 14 THEN strftime(obs_date, '%Y-%m-%d') WHEN object_id % 35 = 21 THEN '1/2'
                 WHEN object_id % 35 = 28 THEN NULL
                 WHEN object_id % 3 = 0 THEN month(obs_date) || '/' || day(obs_date) || '/' || year(obs_date) || ' 12:00:00 AM'
                 ELSE month(obs_date) || '/' || day(obs_date) || '/' || year(obs_date) END AS obs_text
  FROM obs),
dated AS (
  SELECT *, CASE WHEN regexp_matches(split_part(obs_text, ' ', 1), '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$')
                 THEN CAST(try_strptime(split_part(obs_text, ' ', 1), '%m/%d/%Y') AS DATE) END AS day
  FROM texts)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as attempts: an order's lines are its attempts, their flag the outcome."""
    li = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "A", "completed").when(F.col("l_returnflag") == "N", "failed").otherwise("skipped")
    return li.groupBy(F.col("l_orderkey").alias("object_id"), F.col("l_linenumber").alias("attempt")).agg(
        F.min(status).alias("status"), F.lit(None).cast("string").alias("reason"), F.max("l_shipdate").alias("ts")
    )


MANIFEST = """manifest AS (
  SELECT l_orderkey AS object_id, l_linenumber AS attempt,
         min(CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'N' THEN 'failed' ELSE 'skipped' END) AS status,
         max(l_shipdate) AS ts
  FROM lineitem GROUP BY ALL),
last AS (
  SELECT object_id, status FROM manifest QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY attempt DESC, ts DESC) = 1)"""
