"""Points, cells, polygons and distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsforge.functions.geo import cell_centre, cell_index, haversine, reach_lat, reach_lon
from obsforge.functions.hashing import uniform
from obsforge.operators.skew import fan_out, salted_join, splittable_join


def bounding_box(df: DataFrame, lon: str, lat: str) -> DataFrame:
    return df.agg(
        F.min(lon).alias("min_lon"), F.max(lon).alias("max_lon"), F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat")
    )


# --- distances -------------------------------------------------------------------------------------------------------


def _reached_bins(points: DataFrame, lon: str, lat: str, metres: float, size: float) -> DataFrame:
    """Each point once per bin that its circle touches."""
    dy, dx = F.lit(reach_lat(metres)), F.least(reach_lon(metres, F.col(lat)), F.lit(180.0))
    east = _around(F.col(lon))

    def bins(low: Column, high: Column) -> Column:
        return F.sequence(F.floor(low / size), F.floor(high / size))

    inside = bins(F.greatest(east - dx, F.lit(0.0)), F.least(east + dx, F.lit(360.0)))
    west = F.when(east - dx < 0, bins(east - dx + 360.0, F.lit(360.0)))
    over = F.when(east + dx > 360, bins(F.lit(0.0), east + dx - 360.0))
    none = F.slice(inside, 1, 0)
    return points.withColumn("by", F.explode(bins(F.col(lat) - dy, F.col(lat) + dy))).withColumn(
        "bx", F.explode(F.array_distinct(F.concat(inside, F.coalesce(west, none), F.coalesce(over, none))))
    )


def _around(lon: Column) -> Column:
    """Degrees east of the 180th meridian, from 0 up to 360: one number for each meridian."""
    return F.pmod(lon + F.lit(180.0), F.lit(360.0))


def _with_bin(points: DataFrame, lon: str, lat: str, size: float) -> DataFrame:
    return points.withColumn("bx", F.floor(_around(F.col(lon)) / size)).withColumn("by", F.floor(F.col(lat) / size))


def within_distance(
    centres: DataFrame, points: DataFrame, metres: float, centre_lon: str, centre_lat: str, lon: str, lat: str
) -> DataFrame:
    """Pairs of a centre and a point at most `metres` apart, with `distance_m`.

    The column names of the two tables must differ. Circles may cross the 180th
    meridian and hold a pole. Distances are taken between positions, once each; rows
    at one position share them.
    """
    one, other = {"__c_lon": F.col(centre_lon), "__c_lat": F.col(centre_lat)}, {"__p_lon": F.col(lon), "__p_lat": F.col(lat)}
    places, spots = (df.select(*[c.alias(k) for k, c in at.items()]).distinct() for df, at in ((centres, one), (points, other)))
    near = near_places(places, spots, metres, *one, *other)
    met = splittable_join(centres.withColumns(one), near, list(one), "inner").drop(*one)
    # each row is about to become as many as the position has points
    pairs = splittable_join(fan_out(met, *met.columns), points.withColumns(other), list(other), "inner").drop(*other)
    return pairs.select(*centres.columns, *points.columns, "distance_m")


def near_places(
    centres: DataFrame, points: DataFrame, metres: float, centre_lon: str, centre_lat: str, lon: str, lat: str
) -> DataFrame:
    """within_distance for tables whose positions hardly repeat: a distance for every pair of rows that share a bin."""
    size = reach_lat(metres) * 2
    distance = haversine(F.col(f"l.{centre_lon}"), F.col(f"l.{centre_lat}"), F.col(f"r.{lon}"), F.col(f"r.{lat}"))
    met = salted_join(
        _reached_bins(centres, centre_lon, centre_lat, metres, size),
        _with_bin(points, lon, lat, size),
        ["bx", "by"],
        "inner",
        distance <= metres,
    ).drop("bx", "by")
    return met.withColumn("distance_m", haversine(F.col(centre_lon), F.col(centre_lat), F.col(lon), F.col(lat)))


def drop_near(candidates: DataFrame, obstacles: DataFrame, metres: float, lon: str, lat: str) -> DataFrame:
    """Candidates farther than `metres` from every obstacle; both tables use the same column names.

    Obstacles count once per position. Two passes: a candidate that shares a
    small cell (diagonal under `metres`) with an obstacle goes without any
    distance; the rest look for one obstacle in their bin and stop at the first.
    """
    places = obstacles.select(F.col(lon).alias("o_lon"), F.col(lat).alias("o_lat")).distinct()
    small = reach_lat(metres) / 1.000001 * 0.7  # a square of this side has a diagonal of 0.99 metres at most
    cell = [F.floor(F.col("o_lon") / small).alias("cx"), F.floor(F.col("o_lat") / small).alias("cy")]
    taken = places.select(*cell).distinct()
    open_ = salted_join(
        candidates.withColumns({"cx": F.floor(F.col(lon) / small), "cy": F.floor(F.col(lat) / small)}),
        taken,
        ["cx", "cy"],
        "left_anti",
    ).drop("cx", "cy")
    size = reach_lat(metres) * 2
    distance = haversine(F.col(f"l.{lon}"), F.col(f"l.{lat}"), F.col("r.o_lon"), F.col("r.o_lat"))
    return salted_join(
        _with_bin(open_, lon, lat, size),
        _reached_bins(places, "o_lon", "o_lat", metres, size),
        ["bx", "by"],
        "left_anti",
        distance <= metres,
    ).drop("bx", "by")


def random_points(box: DataFrame, n: int, seed: int, row_id: str = "id") -> DataFrame:
    """`n` points spread evenly over a one-row bounding box, the same ones for the same seed."""
    spark = box.sparkSession
    corner = box.select(F.struct("min_lon", "max_lon", "min_lat", "max_lat")).scalar()
    at = {
        axis: corner[f"min_{axis}"] + uniform(F.col(row_id), s) * (corner[f"max_{axis}"] - corner[f"min_{axis}"])
        for axis, s in (("lon", 2 * seed), ("lat", 2 * seed + 1))
    }
    return spark.range(n).withColumnRenamed("id", row_id).withColumns(at)


# --- polygons --------------------------------------------------------------------------------------------------------


def polygon_edges(polygons: DataFrame, poly_id: str, ring: str, attributes: list[str] | None = None) -> DataFrame:
    """One row per edge from a column of corner structs (x, y); the last corner joins the first."""
    corners = F.col(ring)
    following = F.concat(F.slice(corners, 2, F.greatest(F.size(corners) - 1, F.lit(0))), F.slice(corners, 1, 1))
    return polygons.withColumn("e", F.explode(F.arrays_zip(corners.alias("a"), following.alias("b")))).select(
        poly_id,
        *(attributes or []),
        F.col("e.a.x").alias("x1"),
        F.col("e.a.y").alias("y1"),
        F.col("e.b.x").alias("x2"),
        F.col("e.b.y").alias("y2"),
    )


def _touched_rows(edges: DataFrame, cell: float, slack: float) -> DataFrame:
    """Each edge once per row of cells that it touches, as `cy`."""
    low, high = F.least("y1", "y2") - slack, F.greatest("y1", "y2") + slack
    return edges.withColumn("cy", F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))))


def polygon_cells(edges: DataFrame, poly_id: str, cell: float) -> DataFrame:
    """(poly_id, cx, cy, cut): the cells that a polygon covers, `cut` where an edge touches them, else wholly inside.

    Cells are squares of side `cell`; all others lie outside. A cell that no edge touches is inside if its centre is, which the
    crossings of the polygon with the row's centre line tell.
    """
    slack = cell * 1e-9
    touched = _touched_rows(edges, cell, slack)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")

    def x_at(y: Column) -> Column:
        inside = F.least(F.greatest(y, low), high)
        return F.when(F.col("y1") == F.col("y2"), F.lit(None)).otherwise((F.col("x2") - F.col("x1")) * (inside - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))

    one, two = x_at(F.col("cy") * cell - slack), x_at((F.col("cy") + 1) * cell + slack)
    west = F.coalesce(F.least(one, two), F.least("x1", "x2")) - slack
    east = F.coalesce(F.greatest(one, two), F.greatest("x1", "x2")) + slack
    cut = touched.select(poly_id, "cy", F.explode(F.sequence(F.floor(west / cell), F.floor(east / cell))).alias("cx")).distinct()

    centre = (F.col("cy") + 0.5) * cell
    crossing = (F.col("x2") - F.col("x1")) * (centre - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1")
    lines = touched.where((F.col("y1") > centre) != (F.col("y2") > centre)).groupBy(poly_id, "cy").agg(F.sort_array(F.collect_list(crossing)).alias("xs"))
    spans = F.transform(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)), lambda i: F.struct(F.get("xs", i).alias("a"), F.get("xs", i + 1).alias("b")))
    first, last = F.ceil(F.col("s.a") / cell - 0.5), F.floor(F.col("s.b") / cell - 0.5)
    runs = lines.where(F.size("xs") > 1).select(poly_id, "cy", F.explode(spans).alias("s")).where(first <= last)
    inner = runs.select(poly_id, F.explode(F.sequence(first, last)).alias("cx"), "cy").distinct()
    return inner.join(cut, [poly_id, "cx", "cy"], "left_anti").withColumn("cut", F.lit(False)).unionByName(cut.withColumn("cut", F.lit(True)))


def first_cells(cells: DataFrame, poly_id: str) -> DataFrame:
    """The cells of polygon_cells that can tell the smallest polygon around a point: none of a polygon with a larger id than one that holds the whole cell."""
    whole = cells.where(~F.col("cut")).groupBy("cx", "cy").agg(F.min(poly_id).alias("__first"))
    known = splittable_join(cells, whole, ["cx", "cy"])
    return known.where(F.col("__first").isNull() | (F.col(poly_id) <= F.col("__first"))).drop("__first")


def point_polygon_hits(points: DataFrame, edges: DataFrame, lon: str, lat: str, poly_id: str, cell: float, first: bool = False) -> DataFrame:
    """Distinct (lon, lat, poly_id) for points inside polygons; with `first`, the smallest poly_id and perhaps some others.

    A position meets the polygons whose cells it shares. In a cell that lies wholly inside, no edge is looked at. In one that an edge
    cuts, the parity of a ray to the east decides, over the edges of that polygon that pass through the row of cells.
    `cell` is their side, in the unit of the coordinates: small enough that few cells are cut, large enough that a
    polygon has thousands of them at most.
    """
    spots = points.select(lon, lat).distinct().withColumns({"cx": F.floor(F.col(lon) / cell), "cy": F.floor(F.col(lat) / cell)})
    cells = polygon_cells(edges, poly_id, cell)
    near = splittable_join(spots, first_cells(cells, poly_id) if first else cells, ["cx", "cy"], "inner")
    rows = _touched_rows(edges.where(F.col("y1") != F.col("y2")).select(poly_id, "x1", "y1", "x2", "y2"), cell, cell * 1e-9)
    px, py = F.col(f"l.{lon}"), F.col(f"l.{lat}")
    x1, y1, x2, y2 = (F.col(f"r.{c}") for c in ("x1", "y1", "x2", "y2"))
    spans = (y1 > py) != (y2 > py)
    crosses = spans & (px < (x2 - x1) * (py - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)
    met = splittable_join(near.where("cut").select(lon, lat, poly_id, "cy"), rows, [poly_id, "cy"], "inner", crosses)
    odd = met.groupBy(lon, lat, poly_id).agg(F.count(F.lit(1)).alias("crossings")).where(F.col("crossings") % 2 == 1)
    return near.where(~F.col("cut")).select(lon, lat, poly_id).unionByName(odd.select(lon, lat, poly_id))


def points_in_polygons(points: DataFrame, edges: DataFrame, lon: str, lat: str, poly_id: str, cell: float) -> DataFrame:
    """Points that lie in any of the polygons."""
    inside = point_polygon_hits(points, edges, lon, lat, poly_id, cell).select(lon, lat).distinct()
    return splittable_join(points, inside, [lon, lat], "left_semi")


def polygon_attribute(
    points: DataFrame, edges: DataFrame, lon: str, lat: str, poly_id: str, attribute: str, cell: float,
    base: DataFrame | None = None,
) -> DataFrame:
    """Append the attribute of the first polygon (smallest id) around each point; NULL outside all of them.

    `base` is a table with the positions of all points, for points that already went through costly steps.
    """
    source = points if base is None else base
    inside = point_polygon_hits(source, edges, lon, lat, poly_id, cell, first=True)
    known = edges.groupBy(poly_id).agg(F.min(attribute).alias(attribute))
    first = inside.join(known, poly_id).groupBy(lon, lat).agg(F.min_by(attribute, poly_id).alias(attribute))
    return splittable_join(points, first, [lon, lat])


# --- cells -----------------------------------------------------------------------------------------------------------


def sample_cells(
    points: DataFrame, cells: DataFrame, lon: Column, lat: Column, step: float, bands: list[str], drop_null: bool = True
) -> DataFrame:
    """Values of the cell each point lies in. With `drop_null`, only points with every band."""
    placed = points.withColumns({"cell_x": cell_index(lon, step), "cell_y": cell_index(lat, step)})
    wanted = cells.select(F.col("cell_x").cast("bigint"), F.col("cell_y").cast("bigint"), *bands)
    if drop_null:
        wanted = wanted.dropna(subset=bands)
    return splittable_join(placed, wanted, ["cell_x", "cell_y"], "inner" if drop_null else "left")


def rasterise(cells: DataFrame, points: DataFrame, lon: Column, lat: Column, step: float, name: str = "label") -> DataFrame:
    """1 for cells with any point, 0 for the others."""
    hit = points.select(cell_index(lon, step).alias("cell_x"), cell_index(lat, step).alias("cell_y")).distinct()
    marked = hit.withColumn(name, F.lit(1))
    return cells.join(marked, ["cell_x", "cell_y"], "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def pixel_coordinates(cells: DataFrame, step: float) -> DataFrame:
    return cells.withColumns(
        {"longitude": cell_centre(F.col("cell_x"), step), "latitude": cell_centre(F.col("cell_y"), step)}
    )
