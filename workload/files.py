"""Readers and sinks: each query writes a given table to the session's shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsforge.operators import lags as L
from obsforge.operators import manifest as M
from obsforge.session import shared_dir
from obsforge.sources import readers, writers
from workload import fixtures as X
from workload.registry import query, r6, s6


@query("csv_round_trip", f"WITH {X.OBS} SELECT object_id, country, CAST(lon_m AS DOUBLE) AS lon_m, CAST(obs_date AS VARCHAR) AS day FROM obs")
def csv_round_trip(spark, sf):
    """Observations as CSV with a header, read with a declared schema and without inference."""
    path = shared_dir(spark, "observations")
    obs = X.observations(spark, sf).select("object_id", "country", F.col("lon_m").cast("double"), F.col("obs_date").cast("string").alias("day"))
    writers.write_csv(obs, path)
    return readers.read_csv(spark, path, "object_id BIGINT, country STRING, lon_m DOUBLE, day STRING")


@query("csv_named_columns", f"WITH {X.OBS} SELECT object_id, presence FROM obs")
def csv_named_columns(spark, sf):
    """Two columns of a CSV that holds more, by name."""
    path = shared_dir(spark, "observations")
    writers.write_csv(X.observations(spark, sf).select("country", "presence", "object_id"), path)
    return readers.read_csv_columns(spark, path, {"object_id": "bigint", "presence": "string"})


@query(
    "pruned_measurements",
    f"""WITH {X.MEAS} SELECT source, site, {s6("sum(value)")} AS total, count(*) AS n FROM meas
        WHERE source IN ('src_A', 'src_R') AND ts >= DATE '1994-02-10' AND ts < DATE '1994-05-20' GROUP BY source, site""",
)
def pruned_measurements(spark, sf):
    """S3: measurements in folders by source and month, of which few are read."""
    path = shared_dir(spark, "measurements")
    writers.write_measurements(X.measurements(spark, sf).withColumn("band", F.lit("value")), path)
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("1994-02-10", "1994-05-20"))
    found = readers.read_measurements(spark, path, ["src_A", "src_R"], start, end, ["value"])
    return found.groupBy("source", "site").agg(r6(F.sum("value")).alias("total"), F.count(F.lit(1)).alias("n"))


@query("static_layers", f"WITH {X.CELLS} SELECT cell_x, cell_y, elevation, CAST(landcover AS DOUBLE) AS landcover FROM cells")
def static_layers(spark, sf):
    """Long layer rows as one row per cell."""
    path = shared_dir(spark, "layers")
    cells = X.cells(spark, sf)
    layers = F.array(*[F.struct(F.lit(n).alias("layer"), F.col(n).cast("double").alias("value")) for n in ("elevation", "landcover")])
    cells.select("cell_x", "cell_y", F.inline(layers)).write.parquet(path)
    return readers.read_static(spark, path, ["elevation", "landcover"])


@query("boundary_of_nation", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def boundary_of_nation(spark, sf):
    """Rows of a boundary table whose attribute has a value."""
    path = shared_dir(spark, "boundary")
    X.table(spark, sf, "nation").write.parquet(path)
    return readers.read_boundary(spark, path, "n_regionkey", "1").select("n_nationkey", "n_name")


@query(
    "csv_batches",
    f"""WITH {X.OBS}, p AS (SELECT object_id, presence, CAST((row_number() OVER (ORDER BY obs_date, object_id) - 1) // 825 AS INTEGER) AS batch FROM obs)
        SELECT object_id, presence, batch FROM p""",
)
def csv_batches(spark, sf):
    """Pages of 825 rows, a folder each, with the columns in a given order."""
    from obsforge.operators.sampling import page

    path = shared_dir(spark, "batches")
    writers.write_batches(page(X.observations(spark, sf), "obs_date", "object_id", 825), path, ["object_id", "presence"])
    back = spark.read.option("header", True).schema("object_id BIGINT, presence STRING, batch INT").csv(path)
    return back.select("object_id", "presence", "batch")


@query("feature_folders", f"WITH {X.OBS} SELECT object_id, CAST(lon_m AS FLOAT) AS east, CAST(lat_m AS FLOAT) AS north, presence FROM obs")
def feature_folders(spark, sf):
    """Features as 32-bit numbers, a folder for each label."""
    path = shared_dir(spark, "features")
    rows = X.observations(spark, sf).select("object_id", F.col("lon_m").cast("double").alias("east"), F.col("lat_m").cast("double").alias("north"), "presence")
    writers.write_features(rows, path, ["east", "north"], "presence")
    return spark.read.parquet(path).select("object_id", "east", "north", "presence")


@query(
    "manifest_append",
    """SELECT count(*) AS total_processed, count(*) FILTER (o_orderkey % 4 <> 0) AS completed_count, count(*) FILTER (o_orderkey % 4 = 0) AS failed_count
       FROM orders""",
)
def manifest_append(spark, sf):
    """Two appends, the second of which completes a part of what failed; read back as progress."""
    path = shared_dir(spark, "manifest")
    key = F.col("o_orderkey")
    tasks = X.table(spark, sf, "orders").select(key, F.when(key % 3 == 0, "failed").otherwise("completed").alias("status"))
    M.append_manifest(M.manifest_rows(tasks, key, F.col("status"), F.lit("2020-01-01")), path)
    again = tasks.withColumn("status", F.when(key % 4 == 0, "failed").otherwise("completed"))
    M.append_manifest(M.manifest_rows(again, key, F.col("status"), F.lit("2020-01-02"), attempt=2), path)
    return M.progress_summary(spark.read.parquet(path)).select("total_processed", "completed_count", "failed_count")


@query(
    "tile_cache",
    """SELECT 'tile_' || vec_id AS file_key, CASE WHEN vec_id % 5 = 0 THEN 'new' ELSE 'old' END AS md5, CAST(count(*) AS BIGINT) AS n,
       CAST(max(CASE WHEN vec_id % 5 = 0 THEN 2 ELSE 1 END) AS INTEGER) AS version FROM embeddings, range(4) GROUP BY vec_id""",
)
def tile_cache(spark, sf):
    """A cache of tiles; every fifth file changes, is added again, and its new version is read."""
    path = shared_dir(spark, "tiles")
    tiles = X.table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("tile_"), "vec_id").alias("file_key"))
    pixels = tiles.withColumn("pixel", F.explode(F.sequence(F.lit(0), F.lit(3))))
    changed = F.col("vec_id") % 5 == 0
    for version, name in ((1, F.lit("old")), (2, F.when(changed, "new").otherwise("old"))):
        files = tiles.select("file_key", name.alias("md5"))
        writers.update_tile_cache(pixels.select("file_key", "pixel", F.lit(version).alias("version")), files, path)
    found = readers_of_tiles(spark, path, files)
    return found.groupBy("file_key", "md5").agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("version"))


def readers_of_tiles(spark, path, files):
    return writers.read_tile_cache(spark, path, files)


@query("metrics_json", "SELECT 'model_' || o_orderpriority AS model, o_orderstatus AS metric, count(*)::DOUBLE AS value FROM orders GROUP BY ALL")
def metrics_json(spark, sf):
    """Metrics as JSON lines."""
    path = shared_dir(spark, "metrics")
    long = X.table(spark, sf, "orders").groupBy(F.concat(F.lit("model_"), "o_orderpriority").alias("model"), F.col("o_orderstatus").alias("metric"))
    writers.write_metrics(long.agg(F.count(F.lit(1)).cast("double").alias("value")), path)
    return spark.read.schema("model STRING, metric STRING, value DOUBLE").json(path)


@query("listed_files", "SELECT n_name AS file_key FROM nation UNION ALL SELECT r_name FROM region")
def listed_files(spark, sf):
    """Names below a folder, here one folder for each row of two tables."""
    path = shared_dir(spark, "listing")
    names = X.table(spark, sf, "nation").select(F.col("n_name").alias("name")).unionByName(X.table(spark, sf, "region").select(F.col("r_name").alias("name")))
    names.withColumn("value", F.col("name")).write.partitionBy("name").text(path)
    found = readers.list_files(spark, path, "part-*").select(F.regexp_extract("path", "name=([^/]*)/", 1).alias("file_key"))
    return found.select(F.url_decode("file_key").alias("file_key"))


@query(
    "hashed_months",
    """WITH l AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey, o_orderkey || ' ' || o_orderstatus AS line FROM orders)
       SELECT month, md5(string_agg(line, chr(10) ORDER BY o_orderkey) || chr(10)) AS md5 FROM l GROUP BY month""",
)
def hashed_months(spark, sf):
    """One file per month of orders, listed and told apart by the hash of its content."""
    path = shared_dir(spark, "months")
    orders = X.table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey", F.concat_ws(" ", "o_orderkey", "o_orderstatus").alias("value")
    )
    sorted_ = orders.repartition("month").sortWithinPartitions("month", "o_orderkey")
    sorted_.select("month", "value").write.partitionBy("month").text(path)
    found = readers.hash_files(spark, path, "part-*").join(readers.list_files(spark, path, "part-*").select("path", "length"), "path")
    return found.where("length > 0").select(F.regexp_extract("path", "month=([^/]*)/", 1).alias("month"), "md5")


@query(
    "lag_of_own_months",
    f"""WITH {X.OBS}, {X.MEAS}, s AS (SELECT * FROM obs WHERE obs_date >= DATE '1995-03-01' AND obs_date < DATE '1995-06-01')
        SELECT s.object_id, coalesce(sum(m.value), 0.0::DOUBLE) AS quantity_30 FROM s LEFT JOIN meas m
          ON m.site = s.site AND m.ts >= s.obs_date - 30 AND m.ts < s.obs_date GROUP BY s.object_id""",
)
def lag_of_own_months(spark, sf):
    """A season's samples read the folders of the months that their own windows reach, and no others."""
    path = shared_dir(spark, "measurements")
    writers.write_measurements(X.measurements(spark, sf), path)
    season = (F.col("obs_date") >= "1995-03-01") & (F.col("obs_date") < "1995-06-01")
    samples = X.observations(spark, sf).where(season).drop("price")
    near = readers.near_samples(spark.read.parquet(path), samples, "obs_date", (-30, -1))
    out = L.lag_features(samples, near, ["site"], "obs_date", "ts", [L.Band("quantity", F.lit(True), F.col("value"), "sum")], (30,))
    return out.select("object_id", "quantity_30")
