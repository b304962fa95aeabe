"""Exact medians of measured values in a frame of days around each sample, without copying all values of a frame.

Rows are shuffled once, and each place goes one of two ways. A place of up to BUCKET_ROWS of each value is cut into blocks of days
that overlap by a frame: each wanted day lies in one block, which holds its whole frame, so the median is taken there from an array.

Values of a place with more of them are cut into buckets at approximate quantiles of the place. Counts per (place, bucket,
day) are summed over the frame of each sample's day, which tells the bucket that holds the middle and where in it the
middle lies. Only the values of that bucket are then looked at. Any cuts give the right result; good ones keep buckets even.

Which way a place goes is told by a hash of it: a bounded set of hashes of the places with many values is broadcast. A
place with few values that shares such a hash goes the longer way, to the same result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsforge.functions.dates import day_number
from obsforge.operators.skew import SALTS, SIEVE, splittable_join

BUCKET_ROWS = 1024
MOST_BUCKETS = 256  # of a place
BLOCK_FRAMES = 4  # frames in a block of days: longer ones repeat fewer rows, shorter ones hold fewer rows outside a frame

_WHICH, _DAY, _BIN, _BUCKET, _CUTS = "__which", "__day", "__bin", "__bucket", "__cuts"
_PART, _HASH, _MANY = "__part", "__hash", "__many"


def _present(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without NULL there. Joins would add these filters to some uses of a table and not to others, which then share no exchange."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))


def _hashes_of_many(rows: DataFrame, place: list[str], values: list[str], most: int) -> DataFrame:
    """Hashes of the places with more than `most` of a value: SIEVE rows at most."""
    sizes = rows.groupBy(*place).agg(*[F.count(v).alias(f"__n{i}") for i, v in enumerate(values)])
    many = sizes.where(F.greatest(*[F.col(f"__n{i}") for i in range(len(values))], F.lit(0)) > most)
    return many.select(_hash(place).alias(_HASH)).distinct().withColumn(_MANY, F.lit(True))


def _part_of_days(width: int) -> Column:
    return F.floor(F.col(_DAY) / width)


def _hash(place: list[str]) -> Column:
    return F.xxhash64(*place).bitwiseAND(F.lit(SIEVE - 1))  # never NULL, so joins add no filter


def _marked(df: DataFrame, hashes: DataFrame, place: list[str]) -> DataFrame:
    """Column __many: True where the place goes the way of many values, else NULL."""
    return df.join(F.broadcast(hashes), _hash(place) == F.col(_HASH), "left").drop(_HASH)


def _parted(rows: DataFrame, hashes: DataFrame, place: list[str], values: list[str], frame: tuple[int, int]) -> DataFrame:
    """Rows by (place, part), the one shuffle of all rows: parts are blocks of days, or shares of a place with many values.

    Rows are marked again behind it, because a filter on an earlier mark would go below the shuffle and make it two. Every use
    must name every column, for the same reason.
    """
    first, last = frame
    width = BLOCK_FRAMES * (last - first + 1)
    share = F.pmod(F.xxhash64(_DAY, *values), F.lit(SALTS)).cast("bigint")
    blocks = F.sequence(F.floor((F.col(_DAY) - last) / width), F.floor((F.col(_DAY) - first) / width))
    part = F.explode(F.when(F.col(_MANY), F.array(share)).otherwise(blocks)).alias(_PART)
    parted = _present(_marked(rows, hashes, place).select(*place, part, _DAY, *values), [_PART])
    return _marked(parted.repartition(*place, _PART), hashes, place)


def _medians_of_blocks(wanted: DataFrame, parted: DataFrame, place: list[str], values: list[str], frame: tuple[int, int]) -> DataFrame:
    first, last = frame
    row = F.struct(_DAY, *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    blocks = parted.where(F.col(_MANY).isNull()).groupBy(*place, _PART).agg(F.collect_list(row).alias("__held"))
    asked = wanted.where(F.col(_MANY).isNull()).select(*place, _DAY, _part_of_days(BLOCK_FRAMES * (last - first + 1)).alias(_PART))
    # Short rows that meet long ones: shuffled even where they would fit a broadcast, so that all cores take part.
    met = asked.hint("merge").join(blocks, [*place, _PART])
    inside = F.filter("__held", lambda r: (r[_DAY] >= F.col(_DAY) + first) & (r[_DAY] <= F.col(_DAY) + last))
    met = met.select(*place, _DAY, inside.alias("__inside"))

    def ordered(i: int) -> Column:
        return F.sort_array(F.array_compact(F.transform("__inside", lambda r: r[f"v{i}"]))).alias(f"__s{i}")

    def middle(i: int) -> Column:
        n = F.size(f"__s{i}")
        return (F.get(f"__s{i}", F.floor((n - 1) / 2).cast("int")) + F.get(f"__s{i}", F.floor(n / 2).cast("int"))) / 2.0

    sorts = [ordered(i) for i in range(len(values))]
    return met.select(*place, _DAY, *sorts).select(*place, _DAY, *[middle(i).alias(f"{v}_median") for i, v in enumerate(values)])


def place_cuts(dense: DataFrame, place: list[str], values: list[str], rows: int) -> DataFrame:
    """(place, cuts): of each value the cuts between buckets of about `rows` of the place, ascending; none where it has no more than that."""
    shares = F.array(*[F.lit(i / MOST_BUCKETS) for i in range(1, MOST_BUCKETS)])

    def thinned(v: str) -> Column:
        n = F.count(v)
        step = F.greatest(F.ceil(F.try_divide(F.lit(MOST_BUCKETS * rows), n)), F.lit(1))
        # names the day, as every use of the shuffled rows must
        found = F.percentile_approx(F.when(F.col(_DAY).isNotNull(), F.col(v)), shares, 4 * MOST_BUCKETS)
        kept = F.array_distinct(F.filter(found, lambda c, k: (k + 1) % step == 0))
        return F.when(n > rows, kept).otherwise(F.array().cast("array<double>"))

    return dense.groupBy(*place).agg(F.array(*[thinned(v) for v in values]).alias(_CUTS))


def in_buckets(dense: DataFrame, cuts: DataFrame, place: list[str], values: list[str], width: int) -> DataFrame:
    """(place, which value, bucket, bin, day, value, times), by all but day and value: equal values of a day once."""
    copies = cuts.select(*place, _CUTS, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias(_PART))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(v).alias("v")) for i, v in enumerate(values)])).alias("__c")
    flat = dense.join(copies, [*place, _PART]).select(*place, _PART, _DAY, _CUTS, cells).where(F.col("__c.v").isNotNull())
    flat = flat.select(*place, _PART, _DAY, F.get(_CUTS, F.col("__c.i")).alias(_CUTS), F.col("__c.i").alias(_WHICH), F.col("__c.v").alias("__value"))
    flat = flat.withColumn(_BUCKET, F.lit(0))
    step = MOST_BUCKETS
    while step > 1:  # binary search for the number of cuts up to the value; beyond the last one `get` is NULL
        step //= 2
        up = F.get(_CUTS, F.col(_BUCKET) + (step - 1)) <= F.col("__value")
        flat = flat.withColumn(_BUCKET, F.col(_BUCKET) + F.when(up, F.lit(step)).otherwise(F.lit(0)))
    keys = [*place, _WHICH, _BUCKET, _BIN]
    once = flat.withColumn(_BIN, _part_of_days(width)).groupBy(_PART, *keys, _DAY, "__value").agg(F.count(F.lit(1)).alias("__times"))
    return once.drop(_PART).repartition(*keys)


def window_medians(
    wanted: DataFrame, measurements: DataFrame, place: list[str], measured_day: str, values: list[str], frame: tuple[int, int], bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """(place, __day, <value>_median) of the distinct (place, __day) in `wanted`; NULL, or no row, where nothing is in the frame."""
    kinds = wanted.select(*place).union(measurements.select(*place)).schema  # equal places need equal hashes
    keys = [F.col(p).cast(kinds[p].dataType).alias(p) for p in place]
    rows = measurements.select(*keys, day_number(F.col(measured_day)).alias(_DAY), *[F.col(v).cast("double").alias(v) for v in values])
    width = frame[1] - frame[0] + 1
    rows = _present(rows, [*place, _DAY]).where(F.coalesce(*values).isNotNull() & _part_of_days(width).isNotNull())
    hashes = _hashes_of_many(rows, place, values, bucket_rows)
    wanted = _present(wanted.select(*keys, _DAY), [*place, _DAY]).where(_part_of_days(BLOCK_FRAMES * width).isNotNull())
    wanted = _marked(wanted, hashes, place)
    parted = _parted(rows, hashes, place, values, frame)
    few = _medians_of_blocks(wanted, parted, place, values, frame)
    return few.unionByName(_medians_of_buckets(wanted, parted, place, values, frame, bucket_rows))


def _medians_of_buckets(wanted: DataFrame, parted: DataFrame, place: list[str], values: list[str], frame: tuple[int, int], bucket_rows: int) -> DataFrame:
    first, last = frame
    width = last - first + 1
    day = F.col(_DAY)
    dense = parted.where(F.col(_MANY).isNotNull()).drop(_MANY)
    cuts = place_cuts(dense, place, values, bucket_rows)
    stored = in_buckets(dense, cuts, place, values, width)
    times = F.when(F.col("__value").isNotNull(), F.col("__times"))  # names the value, so that this shares the shuffle
    counts = stored.groupBy(*place, _WHICH, _BUCKET, _BIN, _DAY).agg(F.sum(times).alias("__n")).drop(_BIN)
    asked = splittable_join(wanted.where(F.col(_MANY).isNotNull()).drop(_MANY), cuts, place, "inner")
    held = _middle_buckets(asked, len(values), counts, place, frame)

    reach = F.explode(F.sequence(F.floor((day + first) / width), F.floor((day + last) / width)))
    near = (F.col("r." + _DAY) >= F.col("l." + _DAY) + first) & (F.col("r." + _DAY) <= F.col("l." + _DAY) + last)
    for k in (*place, _WHICH, _BUCKET, _BIN):
        near = (F.col(f"l.{k}") == F.col(f"r.{k}")) & near
    # Few samples meet many values: shuffled even where a side would fit a broadcast, so that all cores take part.
    met = held.withColumn(_BIN, reach).alias("l").join(stored.hint("merge").alias("r"), near)
    met = met.select(*[F.col(f"l.{c}") for c in [*place, _DAY, _WHICH, "__start", "__total"]], "__value", "__times")

    # Both buckets that can hold the middle are neighbours, so ranks go on from the first one's start.
    group = Window.partitionBy(*place, _DAY, _WHICH)
    run = group.orderBy("__value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = met.repartition(*place, _DAY).withColumn("__run", F.sum("__times").over(run))  # its order serves the next window too
    ranked = ranked.withColumn("__end", F.min("__start").over(group) + F.col("__run"))
    begin, end, n = F.col("__end") - F.col("__times"), F.col("__end"), F.col("__total")
    lower, upper = F.floor((n + 1) / 2), F.floor(n / 2) + 1

    def at(rank: Column, i: int) -> Column:
        return F.max(F.when((F.col(_WHICH) == i) & (rank > begin) & (rank <= end), F.col("__value")))

    middle = [((at(lower, i) + at(upper, i)) / 2.0).alias(f"{v}_median") for i, v in enumerate(values)]
    return ranked.where((upper > begin) & (lower <= end)).groupBy(*place, _DAY).agg(*middle)


def _middle_buckets(asked: DataFrame, n_values: int, counts: DataFrame, place: list[str], frame: tuple[int, int]) -> DataFrame:
    """Samples with the cuts of their places: the one or two buckets that hold the middle of the frame, the values before, and all of them."""
    probes = asked.select(*place, _DAY, F.explode(F.array(*[F.lit(i) for i in range(n_values)])).alias(_WHICH), _CUTS)
    buckets = F.explode(F.sequence(F.lit(0), F.size(F.get(_CUTS, F.col(_WHICH))))).alias(_BUCKET)
    probes = probes.select(*place, _WHICH, _DAY, buckets, F.lit(True).alias("__probe"))
    inside = Window.partitionBy(*place, _WHICH, _BUCKET).orderBy(_DAY).rangeBetween(*frame)
    summed = probes.unionByName(counts, allowMissingColumns=True).withColumn("__in", F.sum("__n").over(inside))
    one = Window.partitionBy(*place, _DAY, _WHICH)
    before = one.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, 0)
    placed = summed.where("__probe AND __in IS NOT NULL").withColumns(
        {"__start": F.sum("__in").over(before) - F.col("__in"), "__total": F.sum("__in").over(one)}
    )
    lower, upper = F.floor((F.col("__total") + 1) / 2), F.floor(F.col("__total") / 2) + 1
    holding = placed.where((upper > F.col("__start")) & (lower <= F.col("__start") + F.col("__in")))
    return holding.select(*place, _WHICH, _DAY, _BUCKET, "__start", "__total")
