"""Land-cover composition, texture and terrain."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsforge.operators.pixels import filled, kept
from obsforge.operators.skew import gather

LANDSCAPE_RADIUS_M = 2000.0  # fixed value: radius of the circle whose area patch density refers to


def class_histogram(df: DataFrame, keys: list[str], class_col: str) -> DataFrame:
    """Rows per key and class, with the key's total and the class share."""
    counts = df.groupBy(*keys, class_col).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))  # a key has as many rows here as it has classes
    return counts.withColumn("total", total).withColumn("share", F.col("n") / F.col("total"))


def histogram_map(df: DataFrame, keys: list[str], class_col: str) -> DataFrame:
    """One row per key with a map of class to count; classes are a small closed set."""
    counts = df.groupBy(*keys, class_col).agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(class_col, "n")))
    return counts.groupBy(*keys).agg(F.map_from_entries(entries).alias("histogram"))


def shannon_of(shares: Column) -> Column:
    return F.sum(-shares * F.ln(shares))


def landscape_metrics(df: DataFrame, keys: list[str], class_col: str, radius_m: float = LANDSCAPE_RADIUS_M) -> DataFrame:
    """Patch density (classes per square kilometre of the circle) and Shannon diversity per key."""
    area = math.pi * radius_m * radius_m
    return (
        class_histogram(df, keys, class_col)
        .groupBy(*keys)
        .agg(
            (F.count(F.lit(1)) / F.lit(area) * F.lit(1000000.0)).alias("patch_density"),
            shannon_of(F.col("share")).alias("shannon_diversity"),
        )
    )


def neighbours(
    df: DataFrame, keys: list[str], x: str, y: str, value: str, offsets: dict[str, tuple[int, int]]
) -> DataFrame:
    """Each cell with its own value and those of the cells at the given (dx, dy); NULL where there is none.

    A cell sends its value to every cell it neighbours and one aggregation on
    the cell itself brings them together: one shuffle, no join, and no key
    larger than a cell.
    """
    sent = {"__own": (0, 0), **offsets}
    targets = F.array(
        *[
            F.struct(F.lit(name).alias("slot"), (F.col(x) - dx).alias("x"), (F.col(y) - dy).alias("y"))
            for name, (dx, dy) in sent.items()
        ]
    )
    spread = df.select(*keys, F.explode(targets).alias("t"), F.col(value).alias("v")).select(
        *keys, F.col("t.x").alias(x), F.col("t.y").alias(y), "t.slot", "v"
    )
    slots = [F.max(F.when(F.col("slot") == s, F.col("v"))).alias(s) for s in sent]
    own = F.max(F.when(F.col("slot") == "__own", F.lit(True))).alias("__there")
    return (
        spread.groupBy(*keys, x, y).agg(own, *slots).where("__there").drop("__there").withColumnRenamed("__own", value)
    )


# The four directions a texture matrix pools.
TEXTURE_OFFSETS = {"east": (1, 0), "south": (0, 1), "south_east": (1, 1), "south_west": (-1, 1)}


def glcm(df: DataFrame, keys: list[str], row: str, col: str, level: str) -> DataFrame:
    """Texture of each tile: contrast, correlation, entropy and variance of grey-level co-occurrence.

    `level` is an integer grey level. Pairs in the four directions are counted
    in both orders, so the matrix is symmetric. A flat tile has NULL correlation.
    """
    cells = neighbours(df, keys, col, row, level, TEXTURE_OFFSETS)
    pairs = cells.select(
        *keys, F.col(level).alias("g"), F.explode(F.array(*TEXTURE_OFFSETS)).alias("h")
    ).where(F.col("h").isNotNull() & F.col("g").isNotNull())
    both = F.explode(
        F.array(
            F.struct(F.col("g").alias("i"), F.col("h").alias("j")), F.struct(F.col("h").alias("i"), F.col("g").alias("j"))
        )
    )
    matrix = pairs.select(*keys, both.alias("p")).groupBy(*keys, "p.i", "p.j").agg(F.count(F.lit(1)).alias("n"))
    i, j, n = F.col("i").cast("double"), F.col("j").cast("double"), F.col("n")
    sums = matrix.groupBy(*keys).agg(
        F.sum("n").alias("total"),
        F.sum(n * i).alias("s_i"),
        F.sum(n * i * i).alias("s_ii"),
        F.sum(n * i * j).alias("s_ij"),
        F.sum(n * (i - j) * (i - j)).alias("s_d"),
        F.sum(n * F.ln(n.cast("double"))).alias("s_nln"),
    )
    total = F.col("total").cast("double")
    mean = F.col("s_i") / total
    variance = F.col("s_ii") / total - mean * mean
    return sums.select(
        *keys,
        (F.col("s_d") / total).alias("texture_contrast"),
        F.when(variance > 1e-12, (F.col("s_ij") / total - mean * mean) / variance).alias("texture_correlation"),
        (F.ln(total) - F.col("s_nln") / total).alias("texture_entropy"),
        variance.alias("texture_variance"),
    )


def glcm_pixels(df: DataFrame, keys: list[str], row: str, col: str, level: str, size: int = 3) -> DataFrame:
    """Texture of the size x size window around each pixel, as `glcm` defines it; windows are cut off at the tile's edge.

    One shuffle brings a tile together as an array of levels, row by row. Each pixel then looks at the pairs of its own window
    there; pairs are put in order, so that equal ones are counted as they pass. A window of one level has NULL
    correlation, one without a pair has no row.
    """
    shift, half = 1 << 32, size // 2
    cell = F.struct(F.col(row).cast("int").alias("r"), F.col(col).cast("int").alias("c"), F.col(level).cast("int").alias("v"))
    tiles = gather(df, *keys).groupBy(*keys).agg(
        F.min(row).cast("int").alias("__top"), F.max(row).cast("int").alias("__bottom"), F.min(col).cast("int").alias("__left"), F.max(col).cast("int").alias("__right"),
        F.collect_list(cell).alias("__cells"),
    )
    height, width = F.col("__bottom") - F.col("__top") + 1, F.col("__right") - F.col("__left") + 1
    placed = F.transform("__cells", lambda x: F.struct(((x["r"] - F.col("__top")) * width + x["c"] - F.col("__left")).cast("int").alias("k"), x["v"].cast("double").alias("v")))
    pixels = filled(kept(tiles.withColumns({"__h": height, "__w": width}), "__placed", placed), "__levels", "__placed", F.col("__h") * F.col("__w"), None)
    each = pixels.select(*keys, "__top", "__left", "__h", "__w", "__levels", F.explode("__cells").alias("__x"))

    def at(dy: int, dx: int) -> Column:
        r, c = F.col("__x.r") - F.col("__top") + dy, F.col("__x.c") - F.col("__left") + dx
        inside = (r >= 0) & (r < F.col("__h")) & (c >= 0) & (c < F.col("__w"))
        return F.when(inside, F.get("__levels", r * F.col("__w") + c)).cast("bigint")

    reach = range(-half, half + 1)
    seen = each.select(*keys, F.col("__x.r").alias(row), F.col("__x.c").alias(col), F.array(*[at(dy, dx) for dy in reach for dx in reach]).alias("__window"))
    pairs = [
        (y * size + x, (y + dy) * size + x + dx)
        for y in range(size) for x in range(size) for dx, dy in TEXTURE_OFFSETS.values() if y + dy < size and 0 <= x + dx < size
    ]

    def code(i: int, j: int) -> Column:
        one, two = F.get("__window", F.lit(i)), F.get("__window", F.lit(j))
        return F.when(one.isNotNull() & two.isNotNull(), F.least(one, two) * shift + (F.greatest(one, two) + (1 << 31)))

    codes = seen.select(*keys, row, col, F.explode(F.array(F.sort_array(F.array_compact(F.array(*[code(i, j) for i, j in pairs]))))).alias("__codes"))

    def spread(n: Column, same: Column) -> Column:
        """n ln n of both orders of a pair, or of the one of a pair of equal levels, that has come n times."""
        times = F.when(same, 2.0 * n).otherwise(n)
        return F.when(n > 0, 2.0 * n * F.ln(times)).otherwise(F.lit(0.0))

    kind = "struct<last: bigint, run: double, n: double, i: double, ii: double, ij: double, d: double, e: double>"
    start = F.struct(F.lit(-1), *[F.lit(0.0)] * 7).cast(kind)

    def add(seen: Column, pair: Column) -> Column:
        i, j = F.shiftright(pair, 32).cast("double"), (pair.bitwiseAND(F.lit(shift - 1)) - (1 << 31)).cast("double")
        before = F.when(pair == seen["last"], seen["run"]).otherwise(F.lit(0.0))
        return F.struct(
            pair, before + 1.0, seen["n"] + 2.0, seen["i"] + i + j, seen["ii"] + i * i + j * j, seen["ij"] + 2.0 * i * j,
            seen["d"] + 2.0 * (i - j) * (i - j), seen["e"] + spread(before + 1.0, i == j) - spread(before, i == j),
        ).cast(kind)

    sums = codes.where(F.size("__codes") > 0).select(*keys, row, col, F.explode(F.array(F.aggregate("__codes", start, add))).alias("__s"))
    total, mean = F.col("__s.n"), F.col("__s.i") / F.col("__s.n")
    variance = F.col("__s.ii") / total - mean * mean
    return sums.select(
        *keys,
        row,
        col,
        (F.col("__s.d") / total).alias("texture_contrast"),
        F.when(variance > 1e-12, (F.col("__s.ij") / total - mean * mean) / variance).alias("texture_correlation"),
        (F.ln(total) - F.col("__s.e") / total).alias("texture_entropy"),
        variance.alias("texture_variance"),
    )


def terrain(df: DataFrame, keys: list[str], x: str, y: str, elevation: str, cell_m: float) -> DataFrame:
    """Slope and aspect in degrees from the four neighbours; NULL at the rim.

    x grows to the east and y to the north. Aspect is clockwise from north, the
    direction the slope faces.
    """
    sides = {"east": (1, 0), "west": (-1, 0), "north": (0, 1), "south": (0, -1)}
    cells = neighbours(df, keys, x, y, elevation, sides)
    dx = (F.col("east") - F.col("west")) / F.lit(2.0 * cell_m)
    dy = (F.col("north") - F.col("south")) / F.lit(2.0 * cell_m)
    facing = F.degrees(F.atan2(-dx, -dy))
    return cells.select(
        *keys,
        x,
        y,
        elevation,
        F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))).alias("slope"),
        F.when((dx == 0) & (dy == 0), F.lit(0.0))
        .when(facing < 0, facing + 360.0)
        .otherwise(facing)
        .alias("aspect"),
    )
