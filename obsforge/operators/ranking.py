"""Global order without a single-partition window.

An un-partitioned window sends every row to one task. Here rows are first cut
into buckets that respect the order; totals per bucket are small, their running
sum gives each bucket its start, and rows are then numbered inside buckets only.
Any cut points give the right answer; good ones keep buckets even.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 50_000
SAMPLED = 65_536  # values from which cuts are taken
MOST_PARTS = 4_096
BLOCK = 64  # cuts that are compared at once
FOLDED = 256  # rows of a block of a running fold

_BUCKET = "__bucket"


def _starts(totals: DataFrame, partition: list[str], order: list[Column], sums: list[str]) -> DataFrame:
    before = Window.partitionBy(*partition, F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums})


def range_cuts(df: DataFrame, column: str, rows: int = ROWS_PER_BUCKET) -> Column:
    """Ascending values that cut a numeric column into parts of about `rows` rows, however its values are spread.

    They are even ranks of about SAMPLED values, drawn by a hash of the value: the same ones whenever the query or a task runs
    again, and never more than a task holds. Any cuts give right results, so that the sample decides evenness alone. There are
    MOST_PARTS parts at most; beyond, parts grow with the table. The array comes from a subquery of the query itself,
    so nothing runs when the plan is made.
    """
    n = df.agg(F.count(column)).scalar()
    share = F.greatest(F.lit(1), F.ceil(n / F.lit(SAMPLED)))
    value = F.col(column).cast("double")
    drawn = df.where(F.col(column).isNotNull() & (F.pmod(F.xxhash64(column), share) == 0)).agg(
        F.sort_array(F.collect_list(value)).alias("v"), F.first(n, ignorenulls=True).alias("n")
    )
    parts = F.least(F.ceil(F.col("n") / F.lit(rows)), F.lit(MOST_PARTS), F.size("v")).cast("int")
    at = F.transform(F.sequence(F.lit(1), parts - 1), lambda k: F.get("v", F.floor(k * F.size("v") / parts).cast("int")))
    return drawn.select(F.when(parts > 1, F.array_distinct(at)).otherwise(F.array().cast("array<double>"))).scalar()


def with_part(df: DataFrame, column: str, rows: int = ROWS_PER_BUCKET, name: str = _BUCKET) -> DataFrame:
    """Append the number of the part of about `rows` rows, ascending, that a value lies in; 0 for NULL."""
    value, cuts, ends = F.col(column).cast("double"), F.col("__cuts"), F.col("__ends")

    def below(part: Column) -> Column:
        return F.size(F.filter(part, lambda c: c <= value))

    # How many cuts are not above the value: whole blocks of them first, then those of one block.
    both = df.withColumn("__cuts", range_cuts(df, column, rows))
    both = both.withColumn("__ends", F.when(F.size(cuts) < BLOCK, F.slice(cuts, 1, 0)).otherwise(F.filter(cuts, lambda c, i: (i + 1) % BLOCK == 0)))
    blocks = both.withColumn("__blocks", below(ends) * BLOCK)
    found = F.col("__blocks") + below(F.slice(cuts, F.col("__blocks") + 1, F.lit(BLOCK)))
    return blocks.withColumn(name, F.coalesce(found, F.lit(0)).cast("bigint")).drop("__cuts", "__ends", "__blocks")


def running_totals(df: DataFrame, order: str, sums: list[str], descending: bool = False, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Append `<c>_cum`: the sum of c over all rows up to this one in the order of `order`.

    `order` must be unique, finite and not NULL, such as distinct scores. Buckets follow the number of rows.
    """
    rows = with_part(df, order, rows_per_bucket)
    totals = rows.groupBy(_BUCKET).agg(*[F.sum(c).alias(c) for c in sums])
    sort = F.col(_BUCKET).desc() if descending else F.col(_BUCKET).asc()
    starts = _starts(totals, [], [sort], sums).select(_BUCKET, *[f"{c}_before" for c in sums])
    key = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy(_BUCKET).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(starts, _BUCKET)
        .withColumns({f"{c}_cum": F.col(f"{c}_before") + F.sum(c).over(inside) for c in sums})
        .drop(_BUCKET, *[f"{c}_before" for c in sums])
    )


def running_fold(
    df: DataFrame, order: str, state: Column, kind: str, merge: Callable[[Column, Column], Column], name: str = "folded",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Append the states of all rows up to this one in the order of `order`, merged from left to right.

    `state` is a row's own state of the SQL type `kind`, never NULL, and `merge` any associative function of two states; it need not commute.
    `order` is a unique number. A scan in three levels: rows inside blocks of FOLDED, blocks inside buckets, buckets among
    each other, so no list is longer than a block, the blocks of a bucket or MOST_PARTS.
    """
    nothing = F.lit(None).cast(kind)

    def both(a: Column, b: Column) -> Column:
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(merge(a, b).cast(kind))

    def prefixes(states: Column) -> Column:
        """Of each entry, what stands before it and with it, merged."""
        start = F.struct(nothing.alias("all"), F.array().cast(f"array<struct<before: {kind}, with: {kind}>>").alias("out"))

        def add(done: Column, one: Column) -> Column:
            now = both(done["all"], one)
            return F.struct(now.alias("all"), F.concat(done["out"], F.array(F.struct(done["all"].alias("before"), now.alias("with")))).alias("out"))

        return F.aggregate(states, start, add)

    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    numbered = with_part(df.select(F.col(order).alias("__at"), whole, state.cast(kind).alias("state")), "__at", rows_per_bucket)
    placed = numbered.withColumn("__block", F.floor((F.row_number().over(Window.partitionBy(_BUCKET).orderBy("__at")) - 1) / FOLDED))

    def folded(parts: DataFrame, keys: list[str], entry: Column, state_of: Callable[[Column], Column]) -> DataFrame:
        lists = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("__list"))
        return lists.withColumn("__scan", prefixes(F.transform("__list", state_of)))

    blocks = folded(placed, [_BUCKET, "__block"], F.struct("__at", "row", "state"), lambda x: x["state"])
    totals = blocks.select(_BUCKET, F.struct("__block", F.col("__scan.all").alias("state")).alias("b"))
    buckets = folded(totals, [_BUCKET], F.col("b"), lambda x: x["state"])
    tops = buckets.select(F.lit(0).alias("__one"), F.struct(_BUCKET, F.col("__scan.all").alias("state")).alias("b"))
    top = folded(tops, ["__one"], F.col("b"), lambda x: x["state"])

    def spread(scan: DataFrame, keys: list[str], of: str) -> DataFrame:
        """What stands before each entry of a scan."""
        each = scan.select(*keys, F.explode(F.arrays_zip("__list", F.col("__scan.out").alias("out"))).alias("e"))
        return each.select(*keys, F.col(f"e.__list.{of}").alias(of), F.col("e.out.before").alias(f"{of}_before"))

    offsets = spread(buckets, [_BUCKET], "__block").join(spread(top, [], _BUCKET), _BUCKET)
    before = offsets.select(_BUCKET, "__block", both(F.col(f"{_BUCKET}_before"), F.col("__block_before")).alias("__before"))
    rows = blocks.join(before, [_BUCKET, "__block"]).select("__before", F.explode(F.arrays_zip("__list", F.col("__scan.out").alias("out"))).alias("e"))
    return rows.select("e.__list.row.*", both(F.col("__before"), F.col("e.out.with")).alias(name))


def global_index(df: DataFrame, day: str, row_id: str, name: str = "index", rows_per_bucket: int = ROWS_PER_BUCKET, descending: bool = False) -> DataFrame:
    """0-based position of each row in the order (day with NULL last, row_id); `descending` turns the days round.

    Rows are numbered inside (day, id bucket). Buckets are ranges of ids with about
    the same number of rows, so even a day with most of the rows is split. `row_id` is a unique number.
    """
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    rows = with_part(df, row_id, rows_per_bucket).withColumn("__day", F.coalesce(-number if descending else number, F.lit(2147483647)))
    cells = rows.groupBy("__day", _BUCKET).agg(F.count(F.lit(1)).alias("n"))
    days = _starts(cells.groupBy("__day").agg(F.sum("n").alias("n")), [], [F.col("__day")], ["n"]).select(
        "__day", F.col("n_before").alias("__day_start")
    )  # one row per calendar day
    starts = (
        _starts(cells, ["__day"], [F.col(_BUCKET)], ["n"])
        .join(days, "__day")
        .select("__day", _BUCKET, (F.col("__day_start") + F.col("n_before")).alias("__start"))
    )
    inside = Window.partitionBy("__day", _BUCKET).orderBy(row_id)
    return (
        rows.join(starts, ["__day", _BUCKET])
        .withColumn(name, F.col("__start") + F.row_number().over(inside) - 1)
        .drop("__day", _BUCKET, "__start")
    )


def order_cut(df: DataFrame, order: str, ranks: dict[str, Callable[[Column], Column]], prefix: int = 4) -> DataFrame:
    """One row with, for each name, the value of `order` that holds the given 1-based rank.

    `order` is a unique hexadecimal text (see functions.hashing.order_key); its
    leading `prefix` digits are the buckets, 16**prefix of them, evenly filled.
    Only rows of the buckets that hold a rank are sorted. A rank below 1 gives
    '' (nothing is at or below it); one above the row count, '~' (everything is).
    `ranks` maps a name to a function of the row count.
    """
    head = F.substring(F.col(order), 1, prefix)
    counts = df.groupBy(head.alias(_BUCKET)).agg(F.count(F.lit(1)).alias("n"))
    all_rows = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0))), F.lit(0))  # over bucket counts
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), of(F.col("__all")).cast("bigint").alias("rank")) for k, of in ranks.items()]))
    holding = (
        _starts(counts, [], [F.col(_BUCKET)], ["n"])
        .withColumn("__all", all_rows)
        .select(_BUCKET, "n", "n_before", wanted.alias("o"))
        .select(_BUCKET, "n", F.col("o.name").alias("name"), (F.col("o.rank") - F.col("n_before")).alias("__at"))
        .where(F.col("__at").between(F.lit(1), F.col("n")))
    )  # at most one bucket per name
    near = df.select(head.alias(_BUCKET), F.col(order).alias("__key")).join(F.broadcast(holding), _BUCKET)
    found = near.withColumn("__rn", F.row_number().over(Window.partitionBy("name", _BUCKET).orderBy("__key"))).where(
        F.col("__rn") == F.col("__at")
    )
    # A rank that no row has: below all of them or above.
    sizes = df.agg(F.count(F.lit(1)).alias("__all")).select(wanted.alias("o"))
    beyond = sizes.select(F.col("o.name").alias("name"), F.when(F.col("o.rank") < 1, F.lit("")).otherwise(F.lit("~")).alias("__beyond"))
    offered = found.select("name", "__key").unionByName(beyond, allowMissingColumns=True)
    return offered.groupBy().agg(
        *[F.coalesce(*[F.max(F.when(F.col("name") == k, F.col(c))) for c in ("__key", "__beyond")]).alias(k) for k in ranks]
    )


def first_n_per_class(
    df: DataFrame,
    row_id: str,
    class_col: str,
    limits: dict[str, Callable[[dict[str, Column]], Column]],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Rows among the first N of their class by `row_id`, a unique number.

    `limits` maps each kept class to N, a function of the class counts. The id
    of the N-th row of a class is found from bucket counts and the rows of one
    bucket; the table itself is only filtered, neither sorted nor shuffled.
    """
    classes = list(limits)
    rows = df.where(F.col(class_col).isin(classes))

    def by_class(values: list[Column], column: Column) -> Column:
        chosen = F.lit(None)
        for c, v in zip(classes, values, strict=True):
            chosen = F.when(column == c, v).otherwise(chosen)
        return chosen

    # One row of class sizes and limits, a subquery wherever it is needed.
    n_of = {c: F.col(f"n{i}") for i, c in enumerate(classes)}
    sizes = rows.agg(*[F.count_if(F.col(class_col) == c).alias(f"n{i}") for i, c in enumerate(classes)])
    limited = sizes.select(F.struct(*n_of.values(), *[of(n_of).cast("bigint").alias(f"most{i}") for i, (_, of) in enumerate(limits.items())]))
    keyed = with_part(rows.select(F.col(class_col).alias("__class"), F.col(row_id).alias("__id")), "__id", rows_per_bucket)
    counts = keyed.groupBy("__class", _BUCKET).agg(F.count(F.lit(1)).alias("n")).withColumn("__limits", limited.scalar())
    most = by_class([F.col(f"__limits.most{i}") for i in range(len(classes))], F.col("__class"))
    holding = (
        _starts(counts, ["__class"], [F.col(_BUCKET)], ["n"])
        .withColumn("__at", most - F.col("n_before"))
        .where(F.col("__at").between(F.lit(1), F.col("n")))
        .select("__class", _BUCKET, "__at")
    )  # at most one bucket per class
    found = (
        keyed.join(F.broadcast(holding), ["__class", _BUCKET])
        .withColumn("__rn", F.row_number().over(Window.partitionBy("__class", _BUCKET).orderBy("__id")))
        .where(F.col("__rn") == F.col("__at"))
        .select(F.col("__class").alias(class_col), F.col("__id").alias("__last"))
    )  # at most one row per class
    at = F.col("__limits")
    whole = by_class([at[f"most{i}"] >= at[f"n{i}"] for i in range(len(classes))], F.col(class_col))
    return (
        rows.join(F.broadcast(found), class_col, "left")
        .withColumn("__limits", limited.scalar())
        .where(whole | (F.col(row_id) <= F.col("__last")))
        .select(*df.columns)
    )
