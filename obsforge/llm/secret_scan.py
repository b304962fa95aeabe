"""Secrets in texts: fixed patterns, and windows of high entropy in long tokens. DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run is as long as it can be, so a least length may stand in the pattern; only an assignment can hide another one.
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}", "entropy": r"[A-Za-z0-9+/_=-]{20,}"}
KINDS = list(PATTERNS)
LEAST_ASSIGNED = 6
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
HEX_BITS, MIXED_BITS = 3.0, 3.9
#: Tokens that are no secrets however they look: words and numbers joined by signs, UUIDs, placeholders.
ALLOWED = (
    r"^[A-Za-z+/_=-]+$",
    r"^[0-9+/_=-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|xxxxxx|000000|123456789",
)


def found(text: Column, kind: str) -> Column:
    """Matches of a kind in order: number, code points between it and the one before, and its text."""
    pattern = PATTERNS[kind]
    between = F.transform(F.split(text, pattern, -1), F.char_length)
    pairs = F.arrays_zip(between.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    rows = F.transform(pairs, lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), z["gap"].alias("gap"), z["match"].alias("match")))
    return F.when(text.rlike(pattern), rows)


def high_entropy(token: Column, window: int = WINDOW, hex_bits: float = HEX_BITS, mixed_bits: float = MIXED_BITS) -> Column:
    """struct(first, last): window ends, from 1, of the first and last window whose entropy reaches its class's bits.

    The counts of the window's characters and the sum of c log2 c change by the character that enters and the one that
    leaves; the entropy is log2(window) - sum / window. Tokens of hexadecimal digits have a bound of their own.
    """
    bits = F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), hex_bits).otherwise(mixed_bits)
    codes = F.transform(F.split(F.regexp_replace(token, "(?<=.)(?=.)", "\n"), "\n"), lambda c: F.instr(F.lit(ALPHABET), c))
    steps = F.transform(codes, lambda c, i: F.struct(c.alias("new"), i.alias("i")))
    # Each step carries the code that leaves, so that nothing is looked up by position.
    old = F.concat(F.array_repeat(F.lit(0), window), codes)
    steps = F.filter(F.arrays_zip(steps.alias("step"), old.alias("old")), lambda z: z["step"]["new"] > 0)
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0).alias("first"), F.lit(0).alias("last")
    )

    def weight(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c)).otherwise(0.0)

    def slide(state: Column, z: Column) -> Column:
        new, gone = z["step"]["new"], z["old"]
        come, went = F.get(state["counts"], new - 1), F.get(state["counts"], gone - 1)
        total = F.when(new == gone, state["total"]).otherwise(
            state["total"] - weight(come) + weight(come + 1) + F.when(gone > 0, weight(went - 1) - weight(went)).otherwise(0.0)
        )
        counts = F.transform(state["counts"], lambda c, k: c + (k == new - 1).cast("int") - (k == gone - 1).cast("int"))
        end = z["step"]["i"] + 1
        high = (end >= window) & (F.log2(F.lit(float(window))) - total / window >= bits)
        return F.struct(
            counts.alias("counts"), total.alias("total"),
            F.when(high & (state["first"] == 0), end).otherwise(state["first"]).alias("first"),
            F.when(high, end).otherwise(state["last"]).alias("last"),
        )

    return F.aggregate(steps, start, slide, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def scan_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", allowed: tuple[str, ...] = ALLOWED, window: int = WINDOW, hex_bits: float = HEX_BITS, mixed_bits: float = MIXED_BITS) -> DataFrame:
    """One row per row of docs: id and spans, an array of (start, rank, end, kind, match) in order of start and kind.

    start and end are code points, end exclusive. Kinds are assign (a name, a sign and a value of six characters or more),
    access, hex and entropy: in a token of 20 characters or more that no allowed pattern matches, from the first to the last
    window whose entropy is high. Null and empty texts have no spans; repeated rows are scanned one by one; a null id stays
    null. Matches of one text are numbered in rows, not in one array, so a text may hold any number of them.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("id"), F.monotonically_increasing_id().alias("row"), *[found(whole, k).alias(k) for k in KINDS])
    itself = F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit(None).cast("string").alias("match")))
    some = F.concat(itself, *[F.coalesce(F.col(k), F.slice(itself, 1, 0)) for k in KINDS])
    flat = rows.select("id", "row", F.inline(some))
    suspect = (F.col("kind") == "entropy") & F.col("match").isNotNull()
    for pattern in allowed:
        suspect &= ~F.col("match").rlike(pattern)
    measured = flat.withColumn("high", F.when(suspect, high_entropy(F.col("match"), window, hex_bits, mixed_bits)))
    length = F.coalesce(F.char_length("match"), F.lit(0))
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = measured.repartition("row").withColumn("at", F.sum(F.col("gap").cast("long") + length).over(so_far) - length)
    good = (
        F.when(F.col("kind") == "assign", F.char_length(F.regexp_extract("match", ASSIGN, 2)) >= LEAST_ASSIGNED)
        .when(F.col("kind") == "entropy", F.coalesce(F.col("high.first"), F.lit(0)) > 0)
        .otherwise(F.col("match").isNotNull())
    )
    inner = F.when(F.col("kind") == "entropy", F.col("high.first") - window).otherwise(0)
    past = F.when(F.col("kind") == "entropy", F.col("high.last")).otherwise(length)
    span = F.struct(
        (F.col("at") + inner).alias("start"), F.array_position(F.lit(KINDS), F.col("kind")).cast("int").alias("rank"), (F.col("at") + past).alias("end"),
        "kind", F.expr("substr(match, int(if(kind = 'entropy', high.first - %d, 0)) + 1, int(if(kind = 'entropy', high.last - high.first + %d, char_length(match))))" % (window, window)).alias("match"),
    )
    return placed.groupBy("row").agg(F.first("id").alias(id), F.array_sort(F.collect_list(F.when(good, span))).alias("spans")).drop("row")


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
