"""Long pixel tables: (file_key, band, row, col, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsforge.functions.hashing import coin
from obsforge.functions.values import binarise, finite_or_zero
from obsforge.operators.skew import gather

TARGET = 41  # fixed values: side of a sample tile and number of input bands (the label band follows them)
INPUT_BANDS = 59

# Feature groups and the name prefixes that put a band into them.
FEATURE_GROUPS = {
    "vegetation": ["NDVI", "EVI", "NDWI", "TCI", "VHI"],
    "climate": ["LST_Day", "precipitation", "ET", "aet", "pet", "TVDI"],
    "wind": ["u_component_of_wind", "v_component_of_wind"],
    "soil": ["sm_surface", "sand_0_5cm", "sand_5_15cm", "soil_texture"],
    "topography": ["elevation", "slope", "aspect"],
    "static": ["landcover"],
}


def clean_pixels(pixels: DataFrame, value: str = "value") -> DataFrame:
    return pixels.withColumn(value, finite_or_zero(F.col(value)))


def with_dimensions(pixels: DataFrame) -> DataFrame:
    """Each pixel with the height and width of its file. One shuffle brings a file together; all that follows by file needs none."""
    file = Window.partitionBy("file_key")
    return gather(pixels, "file_key").withColumns({"h": (F.max("row").over(file) + 1).cast("int"), "w": (F.max("col").over(file) + 1).cast("int")})


def kept(tiles: DataFrame, name: str, value: Column) -> DataFrame:
    """tiles with one more column that is computed once per row.

    Exploding a single array keeps it from being planned into the functions that look at it, which would work it out for
    each of their elements again.
    """
    return tiles.select("*", F.explode(F.array(value)).alias(name))


def filled(tiles: DataFrame, name: str, cells: str, size: int | Column, absent_value: float | None = 0.0) -> DataFrame:
    """tiles with the values of the structs (k, v) of `cells` in the order of k, absent_value for each k below `size` that has none.

    Of several one is taken; a v that is NULL stays.
    """
    places = F.sequence(F.lit(0), F.lit(size) - 1)
    nothing = F.lit(absent_value).cast("double")
    lacking = F.transform(F.array_except(places, F.col(cells)["k"]), lambda k: F.struct(k.alias("k"), nothing.alias("v")))
    every = kept(tiles, "__every", F.sort_array(F.concat(cells, lacking)))
    # Pixels that repeat, or lie at no place: place by place.
    slow = F.transform(places, lambda k: F.coalesce(F.get(F.filter("__every", lambda c: c["k"] == k), 0)["v"], nothing))
    return kept(every, name, F.when(F.col("__every")["k"] == places, F.col("__every")["v"]).otherwise(slow)).drop("__every")


def _cell(place: Column) -> Column:
    return F.struct(place.cast("int").alias("k"), F.col("value").cast("double").alias("v"))


def _places(tiles: DataFrame, name: str, size: int) -> DataFrame:
    return tiles.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(name))


def crop_pad(pixels: DataFrame, height: int = TARGET, width: int = TARGET) -> DataFrame:
    """Every (file, band) as a full height x width tile: cut at the bottom right, zeros where it is short.

    One shuffle brings the pixels of a (file, band) into one array; absent places are added there. Of pixels that repeat
    one is kept.
    """
    inside = (F.col("row") < height) & (F.col("col") < width)
    cell = F.when(inside, _cell(F.col("row") * width + F.col("col")))  # collecting leaves out NULL
    tiles = gather(clean_pixels(pixels), "file_key", "band").groupBy("file_key", "band").agg(F.collect_list(cell).alias("cells"))
    values = filled(tiles, "values", "cells", height * width).drop("cells")
    placed = _places(_places(values, "row", height), "col", width)
    return placed.select("file_key", "band", "row", "col", F.get("values", F.col("row") * width + F.col("col")).alias("value"))


def binary_label(pixels: DataFrame, label_band: int = INPUT_BANDS) -> DataFrame:
    """The label band as 0/1 per pixel."""
    return pixels.where(F.col("band") == label_band).select(
        "file_key", "row", "col", binarise(F.col("value")).alias("label")
    )


def centre_label(pixels: DataFrame, label_band: int = INPUT_BANDS) -> DataFrame:
    """The 0/1 label of each file from the middle pixel (h // 2, w // 2) of its label band."""
    sized = with_dimensions(pixels.where(F.col("band") == label_band))
    centred = sized.where((F.col("row") == F.floor(F.col("h") / 2)) & (F.col("col") == F.floor(F.col("w") / 2)))
    return centred.select("file_key", "h", "w", binarise(F.col("value")).alias("label"))


def _axis(target: str, source_size: str, size: int) -> dict[str, Column]:
    """Lower and higher index, and the higher one's weight, of a half-pixel-centred linear interpolation, clamped at the rim."""
    n = F.col(source_size)
    at = F.greatest((F.col(target) + 0.5) * n / F.lit(float(size)) - 0.5, F.lit(0.0))
    low = F.least(F.floor(at), n - 1).cast("int")
    return {f"{target}_low": low, f"{target}_high": F.least(low + 1, n - 1).cast("int"), f"{target}_part": at - low}


def bilinear_resize(pixels: DataFrame, height: int = TARGET, width: int = TARGET) -> DataFrame:
    """Every (file, band) resampled to height x width.

    One shuffle brings the pixels of a (file, band) into one sorted array; a target pixel mixes four of its entries. Absent
    source pixels count as 0.
    """
    cell = F.struct("row", "col", F.col("value").cast("double").alias("value"))
    tiles = gather(pixels, "file_key", "band").groupBy("file_key", "band").agg(
        (F.max("row") + 1).cast("int").alias("h"), (F.max("col") + 1).cast("int").alias("w"), F.collect_list(cell).alias("cells")
    )
    flat = F.transform("cells", lambda c: F.struct((c["row"] * F.col("w") + c["col"]).cast("int").alias("k"), c["value"].alias("v")))
    sorted_ = filled(kept(tiles, "flat", flat).drop("cells"), "source", "flat", F.col("h") * F.col("w")).drop("flat")
    rows = _places(sorted_, "row", height).withColumns(_axis("row", "h", height))
    cells = _places(rows, "col", width).withColumns(_axis("col", "w", width))

    def part(r: str, c: str) -> Column:
        weight = {"low": lambda axis: 1.0 - F.col(f"{axis}_part"), "high": lambda axis: F.col(f"{axis}_part")}
        value = F.coalesce(F.get("source", F.col(f"row_{r}") * F.col("w") + F.col(f"col_{c}")), F.lit(0.0))
        return weight[r]("row") * weight[c]("col") * value

    mixed = part("low", "low") + part("low", "high") + part("high", "low") + part("high", "high")
    return cells.select("file_key", "band", "row", "col", mixed.alias("value"))


def patchify(pixels: DataFrame, size: int) -> DataFrame:
    """Each pixel with its patch number (row-major) and its place in the patch."""
    across = F.ceil(F.col("w") / size)
    return with_dimensions(pixels).withColumns(
        {
            "patch": (F.floor(F.col("row") / size) * across + F.floor(F.col("col") / size)).cast("int"),
            "in_row": (F.col("row") % size).cast("int"),
            "in_col": (F.col("col") % size).cast("int"),
        }
    ).drop("h", "w")


def patch_vectors(pixels: DataFrame, size: int) -> DataFrame:
    """One row per (file, patch) with its values ordered by band, row and column; short patches get zeros.

    A patch holds bands x size x size values, a number that does not grow with the table. The shuffle by file that finds
    the widths serves the grouping by band and by patch too.
    """
    cells = F.collect_list(_cell(F.col("in_row") * size + F.col("in_col"))).alias("cells")
    present = pixels.withColumn("value", F.coalesce(F.col("value").cast("double"), F.lit(0.0)))
    bands = filled(patchify(present, size).groupBy("file_key", "patch", "band").agg(cells), "values", "cells", size * size)
    return bands.groupBy("file_key", "patch").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("band", "values"))), lambda c: c["values"])).alias("values")
    )


def patch_means(pixels: DataFrame, size: int) -> DataFrame:
    """Mean per (file, band, patch); the zeros that pad short patches count."""
    return (
        patchify(pixels, size)
        .groupBy("file_key", "band", "patch")
        .agg((F.sum("value") / F.lit(float(size * size))).alias("value"))
    )


def flip(pixels: DataFrame, seed: int = 42) -> DataFrame:
    """Mirror each file left-right and top-bottom, each by a coin the file key decides; all bands alike."""
    across, down = coin(F.col("file_key"), seed), coin(F.col("file_key"), seed + 1)
    return with_dimensions(pixels).withColumns(
        {
            "col": F.when(across, F.col("w") - 1 - F.col("col")).otherwise(F.col("col")),
            "row": F.when(down, F.col("h") - 1 - F.col("row")).otherwise(F.col("row")),
        }
    ).drop("h", "w")


def band_stats(pixels: DataFrame) -> DataFrame:
    """Minimum, maximum, mean, population deviation and count per file and band."""
    return pixels.groupBy("file_key", "band").agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.count("value").alias("n"),
    )


def standardise(pixels: DataFrame, value: str = "value", epsilon: float = 1e-8) -> DataFrame:
    """Subtract the mean of the whole table and divide by its sample deviation."""
    moments = pixels.agg(F.struct(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))).scalar()
    return pixels.withColumn(value, (F.col(value) - moments["m"]) / (moments["s"] + epsilon))


def feature_group(band: Column, groups: dict[str, list[str]] = FEATURE_GROUPS) -> Column:
    """Group of a band by its longest matching prefix; NULL when none matches."""
    chosen = F.lit(None).cast("string")
    by_length = sorted(((p, g) for g, ps in groups.items() for p in ps), key=lambda pair: len(pair[0]))
    for prefix, group in by_length:
        chosen = F.when(band.startswith(prefix), group).otherwise(chosen)
    return chosen
