"""Distances, polygons, grids and rasters against brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsforge.functions.geo import EARTH_RADIUS_M
from obsforge.operators import context as K
from obsforge.operators import landscape as S
from obsforge.operators import spatial as P


def metres(a, b):
    (lon1, lat1), (lon2, lat2) = a, b
    h = math.sin(math.radians(lat2 - lat1) / 2) ** 2
    h += math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(h))


@pytest.fixture(scope="module")
def points():
    rng = random.Random(5)
    return [(i, rng.uniform(-2, 2), rng.uniform(58, 62)) for i in range(300)]


def test_within_distance_at_high_latitude(spark, points):
    a = spark.createDataFrame(points, "id INT, lon DOUBLE, lat DOUBLE")
    b = a.selectExpr("id AS p", "lon AS p_lon", "lat AS p_lat")
    ours = {(r["id"], r["p"]) for r in P.within_distance(a, b, 25000.0, "lon", "lat", "p_lon", "p_lat").collect()}
    brute = {(i, j) for i, *x in points for j, *y in points if metres(x, y) <= 25000}
    assert ours == brute


def test_distances_are_taken_once_per_pair_of_positions(spark, monkeypatch):
    """Rows of one position share its distances; the copies come back in full."""
    asked = []
    real = P.near_places

    def seen(centres, points, *more):
        asked.append((centres.count(), points.count()))
        return real(centres, points, *more)

    monkeypatch.setattr(P, "near_places", seen)
    centres = spark.range(60).selectExpr("id AS c", "179.99 + id % 3 * 0.004 AS c_lon", "0.01D * (id % 2) AS c_lat")
    points = spark.range(50).selectExpr("id AS p", "-179.99D - id % 2 * 0.5 AS lon", "0.0D AS lat")
    out = P.within_distance(centres, points, 2400.0, "c_lon", "c_lat", "lon", "lat")
    assert asked == [(6, 2)] and out.columns == ["c", "c_lon", "c_lat", "p", "lon", "lat", "distance_m"]
    assert {r["p"] % 2 for r in out.collect()} == {0}
    brute = centres.crossJoin(points).where(f"2 * {EARTH_RADIUS_M}D * asin(sqrt(pow(sin(radians(lat - c_lat) / 2), 2) + cos(radians(c_lat)) * cos(radians(lat)) * pow(sin(radians(lon - c_lon) / 2), 2))) <= 2400")
    assert sorted((r["c"], r["p"]) for r in out.collect()) == sorted((r["c"], r["p"]) for r in brute.collect()) and out.count() == 1250


def test_drop_near_with_a_hot_position(spark, points):
    obstacles = [(100 + i, 0.0, 60.0) for i in range(500)] + [(i, x + 0.5, y) for i, x, y in points[:40]]
    a = spark.createDataFrame(points, "id INT, lon DOUBLE, lat DOUBLE")
    o = spark.createDataFrame(obstacles, "id INT, lon DOUBLE, lat DOUBLE")
    ours = {r["id"] for r in P.drop_near(a, o, 10000.0, "lon", "lat").collect()}
    brute = {i for i, *x in points if all(metres(x, y) > 10000 for _, *y in obstacles)}
    assert ours == brute and len(brute) < len(points)


RING = [(0, 0), (10, 0), (10, 9), (5, 3), (0, 9)]


def inside(x, y):
    hit = False
    for (x1, y1), (x2, y2) in zip(RING, RING[1:] + RING[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


def test_polygons_from_rings(spark):
    rng = random.Random(1)
    pts = [(i, rng.uniform(-2, 12), rng.uniform(-2, 11)) for i in range(400)]
    polygons = spark.createDataFrame([(1, [(float(x), float(y)) for x, y in RING])], "poly_id INT, ring ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>")
    edges = P.polygon_edges(polygons, "poly_id", "ring")
    df = spark.createDataFrame(pts, "id INT, lon DOUBLE, lat DOUBLE")
    ours = {r["id"] for r in P.points_in_polygons(df, edges, "lon", "lat", "poly_id", 0.7).collect()}
    assert ours == {i for i, x, y in pts if inside(x, y)}


def inside_ring(x, y, ring):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


@pytest.mark.parametrize("cell", [0.3, 1.0, 2.5, 40.0])
def test_cells_of_many_polygons_match_the_ray_rule(spark, cell):
    """Jagged, flat, overlapping and self-crossing rings; points on corners, edges and borders of cells."""
    rng = random.Random(7)
    rings = {0: RING, 1: [(2, 2), (8, 2), (8, 6), (2, 6)], 2: [(0, 0), (6, 6), (6, 0), (0, 6)], 3: [(-3, 1), (12, 1), (12, 1.0001), (-3, 1.0001)], 4: [(4, 4), (5, 5)]}
    for k in range(5, 9):
        cx, cy = rng.uniform(0, 10), rng.uniform(0, 10)
        rings[k] = [(cx + rng.uniform(0.5, 4) * math.cos(a / 100), cy + rng.uniform(0.5, 4) * math.sin(a / 100)) for a in range(0, 628, 2)]
    spots = [(rng.uniform(-4, 14), rng.uniform(-4, 14)) for _ in range(300)] + [(float(rng.randint(-1, 11)), float(rng.randint(-1, 11))) for _ in range(100)]
    spots += [p for ring in (RING, rings[2], rings[5][:20]) for p in ring] + [(cell * a, cell * b) for a in range(4) for b in range(4)]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(spots)] + [(9000, None, 1.0), (9001, spots[0][0], spots[0][1])]
    table = [(k, [(float(x), float(y)) for x, y in ring]) for k, ring in rings.items()]
    edges = P.polygon_edges(spark.createDataFrame(table, "poly_id INT, ring ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"), "poly_id", "ring")
    df = spark.createDataFrame(points, "id INT, lon DOUBLE, lat DOUBLE")
    found = {(r["lon"], r["lat"], r["poly_id"]) for r in P.point_polygon_hits(df, edges, "lon", "lat", "poly_id", cell).collect()}
    want = {(x, y, k) for _, x, y in points if x is not None for k, ring in rings.items() if inside_ring(x, y, ring)}
    assert found == want


def test_no_edge_is_looked_at_in_cells_wholly_inside(spark):
    ring = [(1000 * math.cos(a / 500), 1000 * math.sin(a / 500)) for a in range(3141)]
    edges = P.polygon_edges(spark.createDataFrame([(1, ring)], "poly_id INT, ring ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"), "poly_id", "ring")
    kinds = {r["cut"]: r["count"] for r in P.polygon_cells(edges, "poly_id", 20.0).groupBy("cut").count().collect()}
    assert kinds[False] > 7000 and kinds[True] < 500
    points = spark.range(2000).select(F.col("id"), (F.col("id") % 50 * 40.0 - 1000).alias("lon"), (F.floor(F.col("id") / 50) * 50.0 - 1000).alias("lat"))
    found = {r["id"] for r in P.points_in_polygons(points, edges, "lon", "lat", "poly_id", 20.0).collect()}
    assert found == {r["id"] for r in points.collect() if inside_ring(r["lon"], r["lat"], ring)}


def test_grid_has_49_cells_around_the_point(spark):
    df = spark.createDataFrame([(1, 40.0, 9.0)], "id INT, lon DOUBLE, lat DOUBLE")
    cells = K.grid_cells(df, "lon", "lat", 1000 / 111000).collect()
    assert len(cells) == 49
    middle = next(c for c in cells if c["row"] == 3 and c["col"] == 3)
    assert (middle["center_lon"], middle["center_lat"]) == (40.0, 9.0)


def test_context_counts_against_brute_force_with_a_hot_bin(spark):
    import datetime as dt

    rng = random.Random(3)
    base = dt.date(2020, 1, 1)
    reports = []
    for i in range(900):
        hot = i % 3 == 0
        x, y = (500, 500) if hot and i % 2 else (rng.randrange(400, 600), rng.randrange(400, 600)) if hot else (rng.randrange(9000), rng.randrange(9000))
        reports.append((i, x, y, base + dt.timedelta(days=rng.randrange(200)), rng.choice(["PRESENT", "ABSENT", "UNKNOWN"])))
    df = spark.createDataFrame(reports, "id INT, lon INT, lat INT, day DATE, presence STRING")
    step = 40.0
    ours = {
        (r["id"], r["row"], r["col"]): tuple(r[c] for c in K.count_columns())
        for r in K.context_counts(df, df, "id", "lon", "lat", "day", "presence", step).collect()
    }
    brute = {}
    for i, x, y, d, _ in reports:
        for _, x2, y2, d2, p in reports:
            row, col, ago = math.floor((y2 - y) / step + 3.5), math.floor((x2 - x) / step + 3.5), (d - d2).days
            if p == "UNKNOWN" or not (0 <= row < 7 and 0 <= col < 7 and 1 <= ago <= 90):
                continue
            cell = brute.setdefault((i, row, col), [0] * 6)
            cell[(ago - 1) // 30 * 2 + (p == "ABSENT")] += 1
    assert ours == {k: tuple(v) for k, v in brute.items()}


@pytest.mark.parametrize("few, rows", [(0, 1 << 16), (1 << 30, 1 << 16), (0, 7), (4, 7)])
def test_context_grids_with_many_samples_of_few_places(spark, monkeypatch, few, rows):
    """Both ways of counting, in bins that are divided; a report is never paired with every sample near it."""
    import datetime as dt

    monkeypatch.setattr(K, "FEW_SAMPLES", few)
    monkeypatch.setattr(K, "GROUP_ROWS", rows)
    rng = random.Random(7)
    places = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(12)]
    base = dt.date(2020, 1, 1)
    rows_ = [(i, *rng.choice(places), base + dt.timedelta(days=rng.randrange(250)), rng.choice(["PRESENT", "ABSENT", "UNKNOWN"])) for i in range(250)]
    lost = [(900, None, 5, base, "PRESENT"), (901, 5, 5, None, "ABSENT")]
    df = spark.createDataFrame(rows_ + lost, "id INT, lon INT, lat INT, day DATE, presence STRING")
    for size in (7, 1):
        args = (df, df, "id", "lon", "lat", "day", "presence", 40.0, size)
        brute = {}
        for i, x, y, d, _ in rows_:
            for _, x2, y2, d2, p in rows_:
                row, col, ago = math.floor((y2 - y) / 40 + size / 2), math.floor((x2 - x) / 40 + size / 2), (d - d2).days
                if p != "UNKNOWN" and 0 <= row < size and 0 <= col < size and 1 <= ago <= 90:
                    brute.setdefault((i, row, col), [0] * 6)[(ago - 1) // 30 * 2 + (p == "ABSENT")] += 1
        sparse = K.context_counts(*args)
        assert "Join" not in re.sub("BroadcastHashJoin", "", sparse._jdf.queryExecution().executedPlan().toString())
        assert {(r["id"], r["row"], r["col"]): [r[c] for c in K.count_columns()] for r in sparse.collect()} == brute
        dense = K.dense_counts(*args).collect()
        assert len(dense) == len({(r["id"], r["row"], r["col"]) for r in dense}) == (len(rows_) + 2) * size * size
        assert all([r[c] for c in K.count_columns()] == brute.get((r["id"], r["row"], r["col"]), [0] * 6) for r in dense)


def test_terrain_of_planes(spark):
    rows = [(x, y, 3.0 * x) for x in range(4) for y in range(4)]
    df = spark.createDataFrame(rows, "x INT, y INT, z DOUBLE")
    out = [r for r in S.terrain(df, [], "x", "y", "z", 1.0).collect() if r["slope"] is not None]
    assert len(out) == 4
    for r in out:  # rises to the east, so it faces west
        assert math.isclose(r["slope"], math.degrees(math.atan(3.0))) and math.isclose(r["aspect"], 270.0)


def test_texture_of_flat_and_striped_tiles(spark):
    rows = [(0, r, c, 2) for r in range(5) for c in range(5)] + [(1, r, c, r % 2) for r in range(5) for c in range(5)]
    out = {r["k"]: r for r in S.glcm(spark.createDataFrame(rows, "k INT, row INT, col INT, g INT"), ["k"], "row", "col", "g").collect()}
    assert out[0]["texture_contrast"] == 0 and out[0]["texture_correlation"] is None and out[0]["texture_entropy"] == 0
    pairs = []
    grid = np.array([[r % 2] * 5 for r in range(5)])
    for dx, dy in S.TEXTURE_OFFSETS.values():
        for r in range(5):
            for c in range(5):
                if 0 <= r + dy < 5 and 0 <= c + dx < 5:
                    pairs.append((grid[r, c] - grid[r + dy, c + dx]) ** 2)
    assert math.isclose(out[1]["texture_contrast"], float(np.mean(pairs)))


def test_random_points_repeat_and_stay_inside(spark):
    box = spark.createDataFrame([(1.0, 2.0, 5.0, 9.0)], "min_lon DOUBLE, max_lon DOUBLE, min_lat DOUBLE, max_lat DOUBLE")
    a, b = (sorted(map(tuple, P.random_points(box, 200, 42).collect())) for _ in range(2))
    assert a == b and len(a) == 200
    assert all(1 <= lon < 2 and 5 <= lat < 9 for _, lon, lat in a)


def test_sample_cells_drops_points_with_a_missing_band(spark):
    cells = spark.createDataFrame([(0, 0, 1.0, 5), (1, 0, None, 6)], "cell_x INT, cell_y INT, a DOUBLE, b INT")
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.5), (3, 9.5, 0.5)], "id INT, lon DOUBLE, lat DOUBLE")
    args = (pts, cells, F.col("lon"), F.col("lat"), 1.0, ["a", "b"])
    assert [r["id"] for r in P.sample_cells(*args).collect()] == [1]
    assert sorted(r["id"] for r in P.sample_cells(*args, drop_null=False).collect()) == [1, 2, 3]


@pytest.mark.parametrize("size", [3, 5])
def test_texture_around_each_pixel_against_counting(spark, size):
    rng = random.Random(size)
    cells = {("t", r, c): rng.choice([-2, 0, 1, 7, 100_000, None]) for r in range(3, 9) for c in range(-2, 5) if rng.random() < 0.9}
    cells |= {("flat", r, c): 4 for r in range(4) for c in range(4)} | {("one", 0, 0): 5, ("none", 0, 0): None, ("none", 0, 1): 3}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "tile STRING, r INT, c INT, g INT")
    out = S.glcm_pixels(df, ["tile"], "r", "c", "g", size)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    found = {(x["tile"], x["r"], x["c"]): tuple(x[f"texture_{n}"] for n in ("contrast", "correlation", "entropy", "variance")) for x in out.collect()}
    want = {}
    for tile, r, c in cells:
        inside = {(y, x): v for (t, y, x), v in cells.items() if t == tile and v is not None and abs(y - r) <= size // 2 and abs(x - c) <= size // 2}
        pairs = [p for (y, x), v in inside.items() for dx, dy in S.TEXTURE_OFFSETS.values() if (y + dy, x + dx) in inside for p in ((v, inside[y + dy, x + dx]), (inside[y + dy, x + dx], v))]
        if pairs:
            i, j = (np.array([p[k] for p in pairs], float) for k in (0, 1))
            share = np.unique([f"{a},{b}" for a, b in pairs], return_counts=True)[1] / len(pairs)
            variance = (i * i).mean() - i.mean() ** 2
            want[tile, r, c] = (((i - j) ** 2).mean(), ((i * j).mean() - i.mean() ** 2) / variance if variance > 1e-12 else None, -(share * np.log(share)).sum(), variance)
    assert found.keys() == want.keys() and len(want) > 30
    for k, values in want.items():
        assert all(a is b is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(found[k], values)), (k, found[k], values)


def test_first_polygon_needs_no_polygon_behind_one_that_holds_the_cell(spark):
    from obsforge.operators.spatial import point_polygon_hits, polygon_attribute

    boxes = [(k, k * 10, 0.0 - k, 10.0 + k) for k in range(1, 40)]  # each lies inside the next
    edges = spark.createDataFrame(
        [(k, v, *a, *b) for k, v, lo, hi in boxes for a, b in (((lo, lo), (hi, lo)), ((hi, lo), (hi, hi)), ((hi, hi), (lo, hi)), ((lo, hi), (lo, lo)))],
        "poly_id INT, v INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE",
    )
    points = spark.createDataFrame([(1, 5.5, 5.5), (2, -3.5, 2.0), (3, 90.0, 0.0)], "id INT, lon DOUBLE, lat DOUBLE")
    out = polygon_attribute(points, edges, "lon", "lat", "poly_id", "v", 1.0)
    assert {r["id"]: r["v"] for r in out.collect()} == {1: 10, 2: 40, 3: None}
    assert point_polygon_hits(points, edges, "lon", "lat", "poly_id", 1.0, first=True).where("lon = 5.5").count() == 1
