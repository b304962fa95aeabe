"""Tiles: cropping, resampling, patches, flips, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsforge.operators import pixels as P
from obsforge.plans import scoring
from workload import fixtures as X
from workload.registry import query, r6, s6


def _input(spark, sf):
    return P.clean_pixels(X.pixels(spark, sf))


@query(
    "crop_pad",
    f"""WITH {X.PIX}, f AS (SELECT DISTINCT file_key, band FROM pix),
        g AS (SELECT file_key, band, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col FROM f, range(10) a(r), range(6) b(c))
        SELECT g.file_key, g.band, g."row", g.col, {s6("coalesce(value, 0.0::DOUBLE)")} AS value FROM g LEFT JOIN pix
          ON pix.file_key = g.file_key AND pix.band = g.band AND pix."row" = g."row" AND pix.col = g.col""",
)
def crop_pad(spark, sf):
    out = P.crop_pad(X.pixels(spark, sf), 10, 6)
    return out.select("file_key", "band", "row", "col", r6("value").alias("value"))


@query(
    "crop_pad_full",
    f"""WITH {X.PIX} SELECT file_key, band, CAST(41 * 41 AS BIGINT) AS n, {s6("sum(value)")} AS total FROM pix GROUP BY file_key, band""",
)
def crop_pad_full(spark, sf):
    out = P.crop_pad(X.pixels(spark, sf)).groupBy("file_key", "band")
    return out.agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


@query(
    "centre_label",
    """SELECT vec_id AS file_key, 8 AS h, 8 AS w, CASE WHEN label > 4 THEN 1 ELSE 0 END AS label FROM embeddings""",
)
def centre_label(spark, sf):
    return P.centre_label(X.pixels(spark, sf))


@query(
    "label_mask",
    f"""WITH {X.PIX} SELECT file_key, "row", col, CASE WHEN value > 0.5 THEN 1 ELSE 0 END AS label FROM pix WHERE band = 59""",
)
def label_mask(spark, sf):
    return P.binary_label(X.pixels(spark, sf))


@query(
    "bilinear_resize",
    f"""WITH {X.PIX}, axis AS (SELECT t, greatest((t + 0.5::DOUBLE) * 8 / 5.0::DOUBLE - 0.5::DOUBLE, 0.0::DOUBLE) AS pos FROM range(5) r(t)),
        ends AS (SELECT t, CAST(least(floor(pos), 7) AS INTEGER) AS lo, CAST(least(least(floor(pos), 7) + 1, 7) AS INTEGER) AS hi, pos - least(floor(pos), 7) AS part FROM axis),
        w AS (SELECT t, lo AS i, 1 - part AS w FROM ends UNION ALL SELECT t, hi, part FROM ends)
        SELECT file_key, band, CAST(r.t AS INTEGER) AS "row", CAST(c.t AS INTEGER) AS col, {s6("sum(r.w * c.w * value)")} AS value
        FROM pix JOIN w r ON r.i = pix."row" JOIN w c ON c.i = pix.col GROUP BY file_key, band, r.t, c.t""",
)
def bilinear_resize(spark, sf):
    out = P.bilinear_resize(_input(spark, sf), 5, 5)
    return out.select("file_key", "band", "row", "col", r6("value").alias("value"))


@query(
    "patchify",
    f"""WITH {X.PIX} SELECT file_key, band, "row", col, CAST("row" // 3 * 3 + col // 3 AS INTEGER) AS patch, CAST("row" % 3 AS INTEGER) AS in_row,
        CAST(col % 3 AS INTEGER) AS in_col FROM pix""",
)
def patchify(spark, sf):
    return P.patchify(_input(spark, sf), 3).select("file_key", "band", "row", "col", "patch", "in_row", "in_col")


@query(
    "patch_means",
    f"""WITH {X.PIX} SELECT file_key, band, CAST("row" // 3 * 3 + col // 3 AS INTEGER) AS patch, {s6("sum(value) / 9.0::DOUBLE")} AS value
        FROM pix GROUP BY ALL""",
)
def patch_means(spark, sf):
    out = P.patch_means(P.clean_pixels(X.pixels(spark, sf)), 3)
    return out.select("file_key", "band", "patch", r6("value").alias("value"))


@query(
    "patch_vectors",
    f"""WITH {X.PIX}, f AS (SELECT DISTINCT file_key, band FROM pix), g AS (SELECT file_key, band, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col FROM f, range(9) a(r), range(9) b(c)),
        v AS (SELECT g.file_key, g.band, g."row" // 3 * 3 + g.col // 3 AS patch, g."row", g.col, coalesce(value, 0.0::DOUBLE) AS value FROM g LEFT JOIN pix
          ON pix.file_key = g.file_key AND pix.band = g.band AND pix."row" = g."row" AND pix.col = g.col)
        SELECT file_key, CAST(patch AS INTEGER) AS patch, string_agg(CAST(CAST(round(value * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY band, "row", col) AS milli FROM v GROUP BY file_key, patch""",
)
def patch_vectors(spark, sf):
    out = P.patch_vectors(_input(spark, sf), 3)
    milli = F.transform("values", lambda v: F.round(v * 1000).cast("bigint").cast("string"))
    return out.select("file_key", "patch", F.array_join(milli, ",").alias("milli"))


@query(
    "flip",
    f"""WITH {X.PIX}, c AS (SELECT *, ('0x' || substr(md5('42:' || file_key), 1, 1))::INTEGER % 2 = 0 AS a, ('0x' || substr(md5('43:' || file_key), 1, 1))::INTEGER % 2 = 0 AS d FROM pix)
        SELECT file_key, band, CASE WHEN d THEN 7 - "row" ELSE "row" END AS "row", CASE WHEN a THEN 7 - col ELSE col END AS col, {s6("value")} AS value FROM c""",
)
def flip(spark, sf):
    out = P.flip(P.clean_pixels(X.pixels(spark, sf)))
    return out.select("file_key", "band", "row", "col", r6("value").alias("value"))


@query(
    "band_stats",
    f"""WITH {X.PIX} SELECT file_key, band, {s6("min(value)")} AS "min", {s6("max(value)")} AS "max", {s6("avg(value)")} AS mean,
        {s6("stddev_pop(value)")} AS std, count(value) AS n FROM pix GROUP BY file_key, band""",
)
def band_stats(spark, sf):
    out = P.band_stats(P.clean_pixels(X.pixels(spark, sf)))
    return out.select("file_key", "band", *[r6(c).alias(c) for c in ("min", "max", "mean", "std")], "n")


@query(
    "standardise",
    f"""WITH {X.PIX}, m AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM pix)
        SELECT file_key, band, "row", col, {s6("(value - m) / (s + 1e-8)")} AS value FROM pix, m""",
)
def standardise(spark, sf):
    out = P.standardise(_input(spark, sf))
    return out.select("file_key", "band", "row", "col", r6("value").alias("value"))


@query(
    "feature_groups",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'vegetation' WHEN '2-HIGH' THEN 'climate' WHEN '3-MEDIUM' THEN 'wind'
       WHEN '4-NOT SPECIFIED' THEN 'soil' END AS feature_group FROM orders""",
)
def feature_groups(spark, sf):
    name = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "EVI_30")
        .when(F.col("o_orderpriority") == "2-HIGH", "ET_90")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "v_component_of_wind_10m_60")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "sand_5_15cm")
        .otherwise("presence_30")
    )
    return X.table(spark, sf, "orders").select("o_orderkey", P.feature_group(name).alias("feature_group"))


@query(
    "prepared_tiles",
    f"""WITH {X.PIX}, keys AS MATERIALIZED (SELECT DISTINCT file_key FROM pix),
        frame AS MATERIALIZED (SELECT file_key, y, unnest(range(9)) AS x FROM (SELECT file_key, unnest(range(9)) AS y FROM keys)),
        input AS MATERIALIZED (SELECT file_key, "row" AS y, col AS x, value AS v FROM pix WHERE band = 0),
        tile AS MATERIALIZED (SELECT file_key, y, x, coalesce(v, 0.0::DOUBLE) AS v FROM frame LEFT JOIN input USING (file_key, y, x))
        SELECT file_key, CAST(y AS INTEGER) AS "row", CAST(x AS INTEGER) AS col,
               {s6("(v - (SELECT avg(v) FROM tile)) / ((SELECT stddev_samp(v) FROM tile) + 1e-8)")} AS value FROM tile""",
)
def prepared_tiles(spark, sf):
    out = scoring.prepare_tiles(X.pixels(spark, sf), 9)
    return out.select("file_key", "row", "col", r6("value").alias("value"))


def _row_sums(tiles):
    """Whole thousandths per row of a tile: exact, whatever the order of addition."""
    milli = F.round(F.col("value") * 1000).cast("bigint")
    top = (F.max(milli * 100 + F.col("col")) % 100 + 100) % 100  # the column of the highest value, of several the last
    return tiles.groupBy("file_key", "band", "row").agg(F.sum(milli).alias("total"), F.count("value").alias("n"), top.cast("int").alias("top"))


def _standard_rows(values: str) -> str:
    """Row sums of a table (file_key, band, y, x, v), standardised over all of it."""
    return f"""values_of AS MATERIALIZED ({values}),
        m AS (SELECT avg(v) AS m, stddev_samp(v) AS s FROM values_of),
        milli AS (SELECT file_key, band, y, x, CAST(round((v - m) / (s + 1e-8) * 1000) AS BIGINT) AS v FROM values_of, m)
        SELECT file_key, band, CAST(y AS INTEGER) AS "row", CAST(sum(v) AS BIGINT) AS total, count(*) AS n,
               CAST(arg_max(x, v * 100 + x) AS INTEGER) AS top FROM milli GROUP BY file_key, band, y"""


CROPPED = """SELECT f.file_key, f.band, f.y, f.x, coalesce(value, 0.0::DOUBLE) AS v FROM frame f
            LEFT JOIN tile t ON t.file_key = f.file_key AND t.band = f.band AND t.y = f.y AND t.x = f.x"""
RESAMPLED = """SELECT file_key, band, r.t AS y, c.t AS x, sum(r.share * c.share * value) AS v FROM tile
            JOIN axis r ON r.n = h AND r.i = tile.y JOIN axis c ON c.n = w AND c.i = tile.x GROUP BY file_key, band, r.t, c.t"""


@query(
    "tiles_41_crop",
    f"""WITH {X.TILES}, frame AS MATERIALIZED (SELECT file_key, band, y, unnest(range(41)) AS x
            FROM (SELECT file_key, band, unnest(range(41)) AS y FROM (SELECT DISTINCT file_key, band FROM tile))),
        {_standard_rows(CROPPED)}""",
)
def tiles_41_crop(spark, sf):
    """Tiles of 41 x 41 with three bands, from files of uneven sides, cut and padded."""
    return _row_sums(scoring.prepare_tiles(X.tiles(spark, sf), 41))


@query(
    "tiles_41_bilinear",
    f"""WITH {X.TILES}, sizes AS (SELECT DISTINCT unnest([h, w]) AS n FROM files),
        places AS (SELECT n, t, greatest((t + 0.5::DOUBLE) * n / 41.0::DOUBLE - 0.5::DOUBLE, 0.0::DOUBLE) AS p FROM (SELECT n, unnest(range(41)) AS t FROM sizes)),
        ends AS (SELECT n, t, least(floor(p), n - 1) AS low, p - least(floor(p), n - 1) AS part FROM places),
        axis AS MATERIALIZED (SELECT n, t, CAST(low AS BIGINT) AS i, 1 - part AS share FROM ends UNION ALL SELECT n, t, CAST(least(low + 1, n - 1) AS BIGINT), part FROM ends),
        {_standard_rows(RESAMPLED)}""",
)
def tiles_41_bilinear(spark, sf):
    """The same files resampled to 41 x 41."""
    return _row_sums(scoring.prepare_tiles(X.tiles(spark, sf), 41, "bilinear"))


@query(
    "tiles_patches",
    f"""WITH {X.TILES}, p AS (SELECT file_key, band, y, x, value, (y // 16) * CAST(ceil(w / 16.0) AS BIGINT) + x // 16 AS patch FROM tile)
        SELECT file_key, CAST(patch AS INTEGER) AS patch, CAST(3 * 256 AS INTEGER) AS n, CAST(sum(round(value * 10)) AS BIGINT) AS total,
               CAST(sum(round(value * 10) * (band * 256 + (y % 16) * 16 + x % 16)) AS BIGINT) AS placed FROM p GROUP BY file_key, patch""",
)
def tiles_patches(spark, sf):
    """Patches of 16 x 16 over three bands, the short ones at the rim filled with zeros."""
    inputs = X.tiles(spark, sf).where(F.col("band") < X.LABEL_BAND)
    out = P.patch_vectors(P.clean_pixels(inputs), 16)
    tenth = F.transform("values", lambda v: F.round(v * 10).cast("bigint"))

    def total(a):
        return F.aggregate(a, F.lit(0).cast("bigint"), lambda s, v: s + v)

    return out.select("file_key", "patch", F.size("values").alias("n"), total(tenth).alias("total"), total(F.transform(tenth, lambda v, i: v * i)).alias("placed"))


@query(
    "labelled_tiles",
    """WITH r AS (SELECT vec_id AS file_key, CASE WHEN label > 4 THEN 1 ELSE 0 END AS label, row_number() OVER (ORDER BY md5('42:' || vec_id)) AS k, count(*) OVER () AS n FROM embeddings)
       SELECT file_key, label, CASE WHEN k <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r""",
)
def labelled_tiles(spark, sf):
    return scoring.labelled_tiles(X.pixels(spark, sf)).select("file_key", "label", "split")
