"""Tiles against NumPy; readers, writers, the tile cache, manifests and incremental ingest on real folders."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsforge.functions.dates import parse_obs_date
from obsforge.functions.indices import relative_humidity, scale_weights
from obsforge.operators import manifest as M
from obsforge.operators import pixels as P
from obsforge.sources import readers, writers
from obsforge.streaming.ingest import ingest_exports, ingest_new_files, ingested, merge_batches

PIX = "file_key STRING, band INT, row INT, col INT, value DOUBLE"


def table(spark, arrays):
    rows = [(k, b, r, c, float(a[r, c])) for k, bands in arrays.items() for b, a in bands.items() for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, PIX)


def array(df, key, band, h, w):
    out = np.full((h, w), np.nan)
    for r in df.where((F.col("file_key") == key) & (F.col("band") == band)).collect():
        out[r["row"], r["col"]] = r["value"]
    return out


@pytest.fixture(scope="module")
def tile():
    return np.random.default_rng(2).normal(size=(5, 9))


def test_crop_and_pad(spark, tile):
    out = P.crop_pad(table(spark, {"t": {0: tile}}), 7, 4)
    expected = np.zeros((7, 4))
    expected[:5] = tile[:, :4]
    assert np.array_equal(array(out, "t", 0, 7, 4), expected)


def test_bilinear_with_half_pixel_centres(spark, tile):
    h, w = 8, 6
    out = array(P.bilinear_resize(table(spark, {"t": {0: tile}}), h, w), "t", 0, h, w)

    def axis(n, size):
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, None)
        lo = np.minimum(np.floor(at).astype(int), n - 1)
        return lo, np.minimum(lo + 1, n - 1), at - lo

    r0, r1, fr = axis(5, h)
    c0, c1, fc = axis(9, w)
    top = tile[r0][:, c0] * (1 - fc) + tile[r0][:, c1] * fc
    low = tile[r1][:, c0] * (1 - fc) + tile[r1][:, c1] * fc
    assert np.allclose(out, top * (1 - fr)[:, None] + low * fr[:, None], atol=1e-12)


def test_time_to_resample_grows_with_the_pixels_not_their_square(spark):
    import time

    side = 200
    pixels = spark.range(side * side).selectExpr("'t' AS file_key", "0 AS band", f"CAST(id DIV {side} AS INT) AS row", f"CAST(id % {side} AS INT) AS col", "CAST(id AS DOUBLE) AS value")
    start = time.time()
    out = array(P.bilinear_resize(pixels, 2, 2), "t", 0, 2, 2)
    assert time.time() - start < 20
    assert np.allclose(out, [[49.5 * 201, 49.5 * 200 + 149.5], [149.5 * 200 + 49.5, 149.5 * 201]])


def test_patches_are_padded_with_zeros(spark, tile):
    out = {r["patch"]: r["values"] for r in P.patch_vectors(table(spark, {"t": {0: tile}}), 4).collect()}
    padded = np.zeros((8, 12))
    padded[:5, :9] = tile
    assert len(out) == 6
    for patch, values in out.items():
        r, c = divmod(patch, 3)
        assert np.array_equal(values, padded[r * 4 : r * 4 + 4, c * 4 : c * 4 + 4].ravel())


def test_centre_label_and_dirty_pixels(spark):
    label = np.zeros((4, 5))
    label[2, 2] = 0.6
    df = table(spark, {"a": {59: label}, "b": {59: np.zeros((4, 5))}})
    assert {r["file_key"]: r["label"] for r in P.centre_label(df).collect()} == {"a": 1, "b": 0}
    dirty = spark.createDataFrame([("a", 0, 0, i, v) for i, v in enumerate([float("nan"), float("inf"), float("-inf"), None, 2.0])], PIX)
    assert sorted(r["value"] for r in P.clean_pixels(dirty).collect()) == [0.0, 0.0, 0.0, 0.0, 2.0]


def test_flip_moves_all_bands_alike(spark, tile):
    out = P.flip(table(spark, {f"t{i}": {0: tile, 59: tile} for i in range(12)}), 42)
    seen = set()
    for i in range(12):
        a = array(out, f"t{i}", 0, 5, 9)
        assert np.array_equal(a, array(out, f"t{i}", 59, 5, 9))
        seen |= {n for n, t in (("none", tile), ("lr", tile[:, ::-1]), ("ud", tile[::-1]), ("both", tile[::-1, ::-1])) if np.array_equal(a, t)}
    assert len(seen) > 1


@pytest.mark.parametrize("raw, day", [
    ("3/7/2019", dt.date(2019, 3, 7)), ("03/07/2019 12:00:00 AM", dt.date(2019, 3, 7)), ("13/40/2019", None), ("2/30/2019", None),
    ("2019-01-02", None), ("1/2", None), ("", None), (None, None), ("3/7/2019x", None), ("3/7/19", None),
])
def test_dates(spark, raw, day):
    assert spark.createDataFrame([(raw,)], "t STRING").select(parse_obs_date(F.col("t")).alias("d")).first()["d"] == day


@pytest.mark.parametrize("season, cover, weights", [
    ("breeding", 1, (0.2, 0.3, 0.5)), ("breeding", 12, (0.2, 0.3, 0.6)), ("breeding", 16, (0.4, 0.3, 0.5)),
    ("migration", 1, (0.5, 0.4, 0.1)), ("migration", 12, (0.5, 0.4, 0.3)), ("migration", 16, (0.6, 0.4, 0.1)),
])
def test_scale_weights(spark, season, cover, weights):
    row = spark.range(1).select(*[c.alias(k) for k, c in scale_weights(F.lit(season), F.lit(cover)).items()]).first()
    assert tuple(round(row[k], 9) for k in ("coarse", "medium", "fine")) == weights


def test_humidity_literal_overflows(spark):
    row = spark.range(1).select(
        relative_humidity(F.lit(25.0), F.lit(0.0)).alias("dry"), relative_humidity(F.lit(2.0), F.lit(0.0)).alias("wet"),
        relative_humidity(F.lit(20.0), F.lit(16.0), "approx").alias("a"),
    ).first()
    assert row["dry"] == 0.0 and row["wet"] == float("inf") and row["a"] == 80.0


def test_observation_files(spark, tmp_path):
    obs = spark.createDataFrame([(1, "3/7/2019", 2019, "PRESENT", 9.5, 40.25, "Kenya")], readers.CSV_SCHEMA)
    path = str(tmp_path / "obs")
    writers.write_csv(obs, path)
    back = readers.read_csv(spark, path, columns=["OBJECTID", "Obs Date", "Longitude"])
    assert [tuple(r) for r in back.collect()] == [(1, "3/7/2019", 40.25)]
    picked = readers.read_csv_columns(spark, path, {"Country": "string", "OBJECTID": "bigint"})
    assert [tuple(r) for r in picked.collect()] == [("Kenya", 1)]
    other = str(tmp_path / "swarm")
    spark.createDataFrame([(dt.date(2020, 1, 2), 1, 40.0, 9.0)], "FINISHDATE DATE, LOCPRESENT INT, lon DOUBLE, lat DOUBLE").write.parquet(other)
    row = readers.read_observations(spark, other).first()
    assert (row["Obs Date"], row["Locust Presence"], row["Longitude"], row["OBJECTID"]) == ("2020-01-02", "1", 40.0, None)


def test_measurement_layout_is_pruned(spark, tmp_path):
    path = str(tmp_path / "meas")
    rows = [(s, "NDVI", 0, 0, dt.datetime(2020, m, 5), float(m)) for s in ("a/b", "c") for m in range(1, 7)]
    writers.write_measurements(spark.createDataFrame(rows, "source STRING, band STRING, cell_x INT, cell_y INT, ts TIMESTAMP, value DOUBLE"), path)
    df = readers.read_measurements(spark, path, ["a/b"], F.lit("2020-02-05").cast("timestamp"), F.lit("2020-04-05").cast("timestamp"), ["NDVI"])
    assert sorted(r["value"] for r in df.collect()) == [2.0, 3.0]
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "source" in text.split("PartitionFilters: [")[1].split("]")[0]


def test_static_boundary_features_and_batches(spark, tmp_path):
    long = spark.createDataFrame([("elevation", 0, 0, 5.0), ("slope", 0, 0, 2.0), ("x", 0, 0, 1.0)], "layer STRING, cell_x INT, cell_y INT, value DOUBLE")
    long.write.parquet(str(tmp_path / "layers"))
    assert readers.read_static(spark, str(tmp_path / "layers"), ["elevation", "slope"]).first().asDict() == {"cell_x": 0, "cell_y": 0, "elevation": 5.0, "slope": 2.0}
    spark.createDataFrame([(1, "A"), (2, "B")], "poly_id INT, country_na STRING").write.parquet(str(tmp_path / "edges"))
    assert readers.read_boundary(spark, str(tmp_path / "edges"), "country_na", "B").first()["poly_id"] == 2
    feats = spark.createDataFrame([(1, 0.5, 1), (2, 0.25, 0)], "object_id BIGINT, NDVI_30 DOUBLE, label INT")
    writers.write_features(feats, str(tmp_path / "features"), ["NDVI_30"])
    back = spark.read.parquet(str(tmp_path / "features"))
    assert dict(back.dtypes)["NDVI_30"] == "float" and back.where("label = 1").count() == 1
    writers.write_batches(feats.withColumn("batch", F.lit(3)), str(tmp_path / "csv"), ["label", "NDVI_30"])
    text = next((tmp_path / "csv" / "batch=3").glob("*.csv")).read_text().splitlines()
    assert text[0] == "label,NDVI_30"
    writers.write_metrics(spark.createDataFrame([("m", "f1", 0.5)], "model STRING, metric STRING, value DOUBLE"), str(tmp_path / "scores"))
    assert spark.read.json(str(tmp_path / "scores")).first()["value"] == 0.5


def test_file_listing_and_tile_cache(spark, tmp_path):
    folder = tmp_path / "tiles"
    folder.mkdir()
    for name, content in (("a.tif", b"1"), ("b.tiff", b"22"), ("c.txt", b"3")):
        (folder / name).write_bytes(content)
    assert {r["file_key"]: r["length"] for r in readers.list_files(spark, str(folder)).collect()} == {"a.tif": 1, "b.tiff": 2}
    cache = str(tmp_path / "cache")

    def pixels(v):
        return spark.createDataFrame([("a.tif", 0, 0, 0, v), ("b.tiff", 0, 0, 0, 5.0)], PIX)

    files = readers.hash_files(spark, str(folder))
    assert writers.update_tile_cache(pixels(1.0), files, cache).count() == 2
    (folder / "a.tif").write_bytes(b"changed")
    files = readers.hash_files(spark, str(folder))
    known = writers.known_tiles(spark, cache)
    assert [r["file_key"] for r in M.new_or_changed(files, known).collect()] == ["a.tif"]
    writers.update_tile_cache(pixels(9.0), files, cache)
    assert {r["file_key"]: r["value"] for r in writers.read_tile_cache(spark, cache, files).collect()} == {"a.tif": 9.0, "b.tiff": 5.0}


def test_manifest_of_ten_tasks(spark, tmp_path):
    """Every fourth of ten tasks fails: seven complete, three fail, all ten ids are kept."""
    tasks = spark.range(10).withColumn("status", F.when(F.col("id") % 4 != 0, "completed").otherwise("failed"))
    path = str(tmp_path / "manifest")
    M.append_manifest(M.manifest_rows(tasks, F.col("id"), F.col("status"), F.lit("2020-01-01")), path)
    kept = spark.read.parquet(path)
    s = M.progress_summary(kept).first()
    assert (s["total_processed"], s["completed_count"], s["failed_count"], s["skipped_count"], s["completion_percentage"]) == (10, 7, 3, 0, 70.0)
    ids = spark.range(12).withColumnRenamed("id", "object_id")
    assert sorted(r[0] for r in M.pending(ids, kept).collect()) == [10, 11]
    assert sorted(r[0] for r in M.pending(ids, kept, statuses=("completed", "skipped")).collect()) == [0, 4, 8, 10, 11]
    assert M.reconcile(tasks.selectExpr("id AS object_id"), kept).count() == 0
    retry = M.manifest_rows(tasks.where("id = 4").withColumn("status", F.lit("completed")), F.col("id"), F.col("status"), F.lit("2020-01-02"), attempt=2)
    M.append_manifest(retry, path)
    assert M.progress_summary(spark.read.parquet(path)).first()["completed_count"] == 8


def test_new_files_are_read_once(spark, tmp_path):
    folder, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))

    def add(n):
        spark.createDataFrame([(n,)], "v BIGINT").write.mode("append").parquet(folder)

    def run():
        ingest_new_files(spark, folder, target, checkpoint, "v BIGINT")
        return sorted(r["v"] for r in ingested(spark, target).collect())

    add(1)
    assert run() == [1]
    add(2)
    assert run() == [1, 2] and run() == [1, 2]


def test_exports_are_registered_by_name(spark, tmp_path):
    folder = tmp_path / "exports"
    folder.mkdir()
    for name in ("locust_2020-01-05_label_1_Kenya_idx_7.tif", "locust_2020-02-05_label_0_idx_8.tif", "notes.tif"):
        (folder / name).write_bytes(b"x")
    ingest_exports(spark, str(folder), str(tmp_path / "reg"), str(tmp_path / "ck"))
    out = {r["id"]: (r["label"], r["country"]) for r in ingested(spark, str(tmp_path / "reg")).collect()}
    assert out == {7: (1, "Kenya"), 8: (0, None)}


def test_tiles_with_repeated_absent_and_null_pixels(spark):
    rows = [("a", 0, 0, 0, 1.0), ("a", 0, 0, 0, 1.0), ("a", 0, 1, 2, 5.0), ("a", 0, 9, 9, 7.0), ("b", 1, 0, 1, None), ("b", 1, 2, 0, float("nan")), ("c", 0, 8, 8, 3.0)]
    df = spark.createDataFrame(rows, "file_key STRING, band INT, row INT, col INT, value DOUBLE")
    out = {(r["file_key"], r["band"], r["row"], r["col"]): r["value"] for r in P.crop_pad(df, 2, 3).collect()}
    assert len(out) == 3 * 6 and {k: v for k, v in out.items() if v} == {("a", 0, 0, 0): 1.0, ("a", 0, 1, 2): 5.0}
    assert P.crop_pad(df.where("false"), 2, 3).count() == 0
    small = P.bilinear_resize(df.where("file_key = 'a'"), 1, 1).collect()
    assert [(r["row"], r["col"]) for r in small] == [(0, 0)] and small[0]["value"] == 0.0
    vectors = {(r["file_key"], r["patch"]): r["values"] for r in P.patch_vectors(P.clean_pixels(df.where("file_key = 'a'")), 5).collect()}
    assert vectors["a", 0][0] == 1.0 and vectors["a", 0][7] == 5.0 and len(vectors["a", 0]) == 25 and vectors["a", 3][24] == 7.0


@pytest.mark.parametrize("name", ["crop_pad", "bilinear_resize", "centre_label", "patchify", "patch_vectors", "patch_means", "flip"])
def test_tile_operators_shuffle_once(spark, tile, name):
    df = table(spark, {"t": {0: tile, 59: tile}})
    out = getattr(P, name)(df, *([3] if name.startswith("patch") else []))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_ingest_in_bounded_batches_and_merging(spark, tmp_path):
    folder, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))

    def add(numbers, files):
        spark.createDataFrame([(n,) for n in numbers], "v BIGINT").repartition(files).write.mode("append").parquet(folder)
        ingest_new_files(spark, folder, target, checkpoint, "v BIGINT", max_files=2)

    def taken():
        return sorted(r["v"] for r in ingested(spark, target).collect())

    add(range(50), 7)
    batches = {int(p.name.removeprefix("batch=")) for p in (tmp_path / "out").glob("batch=*")}
    assert len(batches) == 4 and taken() == list(range(50))
    assert merge_batches(spark, target) == max(batches) and taken() == list(range(50))
    assert len(list((tmp_path / f"out-merged/{max(batches)}").glob("part-*"))) <= 2
    assert merge_batches(spark, target) == max(batches)
    add(range(50, 70), 3)
    assert taken() == list(range(70))
    # a merge that broke off before its row was written changes nothing
    spark.createDataFrame([(999,)], "v BIGINT").write.parquet(f"{target}-merged/99")
    assert taken() == list(range(70))
    assert merge_batches(spark, target) == max(batches) + 2 and taken() == list(range(70))
    with pytest.raises(Exception, match="maxFilesPerTrigger|positive"):
        ingest_new_files(spark, folder, target, checkpoint, "v BIGINT", max_files=0)


def test_only_folders_of_the_samples_own_months_are_read(spark, tmp_path):
    path = str(tmp_path / "measured")
    days = spark.range(730).select(F.expr("date_add(DATE'2020-01-01', CAST(id AS INT))").alias("ts"), F.lit("s").alias("source"), F.col("id").alias("value"))
    writers.write_measurements(days, path)
    samples = spark.createDataFrame([(1, dt.date(2020, 6, 20)), (2, dt.date(2021, 1, 5)), (3, None)], "id INT, day DATE")
    near = readers.near_samples(spark.read.parquet(path), samples, "day", (-30, -1))
    assert {r["month"] for r in near.select(F.col("month").cast("string").alias("month")).distinct().collect()} == {"2020-05", "2020-06", "2020-12", "2021-01"}
    near.collect()
    text = near._jdf.queryExecution().executedPlan().toString()
    assert "array_contains" in text[text.index("PartitionFilters") :].split("]")[0]
    scan = next(n for n in nodes(near) if n.nodeName().startswith("Scan"))
    assert scan.metrics().apply("numPartitions").value() == 4
    assert readers.near_samples(spark.read.parquet(path), samples.where("false"), "day", (-30, -1)).count() == 0


def nodes(df):
    def walk(node):
        yield node
        name = node.nodeName()
        below = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else [node.children().apply(i) for i in range(node.children().size())]
        for child in below:
            yield from walk(child)

    return walk(df._jdf.queryExecution().executedPlan())
