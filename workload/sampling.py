"""Running index, pages, samples, balanced classes and exact splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsforge.operators import manifest as M
from obsforge.operators import sampling as S
from workload import fixtures as X
from workload.registry import query


def _key(seed: int, column: str = "object_id") -> str:
    return f"md5('{seed}:' || {column})"


@query(
    "running_index",
    f"""WITH {X.RAW} SELECT object_id, row_number() OVER (ORDER BY day NULLS LAST, object_id) - 1 AS "index",
        (row_number() OVER (ORDER BY day NULLS LAST, object_id) - 1) // 825 AS batch FROM dated""",
)
def running_index(spark, sf):
    from obsforge.functions.dates import parse_obs_date

    raw = X.raw_dates(spark, sf).select("object_id", parse_obs_date(F.col("obs_text")).alias("day"))
    return S.page(raw, "day", "object_id", 825).select("object_id", "index", "batch")


@query(
    "index_on_few_days",
    f"""WITH {X.OBS} SELECT object_id, row_number() OVER (ORDER BY year(obs_date), object_id) - 1 AS "index" FROM obs""",
)
def index_on_few_days(spark, sf):
    """Seven distinct sort dates: each holds a seventh of the table."""
    from obsforge.operators.ranking import global_index

    rows = X.observations(spark, sf).select("object_id", F.trunc("obs_date", "year").alias("d"))
    return global_index(rows, "d", "object_id").select("object_id", "index")


@query(
    "index_descending_years",
    f"""WITH {X.OBS} SELECT object_id, row_number() OVER (ORDER BY year(obs_date) DESC, object_id) - 1 AS "index" FROM obs""",
)
def index_descending_years(spark, sf):
    from obsforge.operators.ranking import global_index

    rows = X.observations(spark, sf).select("object_id", F.trunc("obs_date", "year").alias("d"))
    return global_index(rows, "d", "object_id", descending=True).select("object_id", "index")


STREAK = "struct<n: bigint, head: bigint, tail: bigint, best: bigint>"


def _joined_streaks(a, b):
    """Lengths of two parts one after the other: all, the streaks at either end, and the longest one."""
    return F.struct(
        a["n"] + b["n"],
        F.when(a["head"] == a["n"], a["n"] + b["head"]).otherwise(a["head"]),
        F.when(b["tail"] == b["n"], b["n"] + a["tail"]).otherwise(b["tail"]),
        F.greatest(a["best"], b["best"], a["tail"] + b["head"]),
    )


@query(
    "longest_streak_so_far",
    f"""WITH {X.OBS}, g AS (SELECT object_id, presence = 'PRESENT' AS there, sum(CASE WHEN presence = 'PRESENT' THEN 0 ELSE 1 END) OVER (ORDER BY object_id) AS run FROM obs),
        s AS (SELECT object_id, CASE WHEN there THEN sum(CASE WHEN there THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY object_id) ELSE 0 END AS streak FROM g)
        SELECT object_id, CAST(streak AS BIGINT) AS streak, CAST(max(streak) OVER (ORDER BY object_id) AS BIGINT) AS best FROM s""",
)
def longest_streak_so_far(spark, sf):
    """A running fold whose state is no sum: presences in sequence, now and at most, in the order of ids."""
    from obsforge.operators.ranking import running_fold

    obs = X.observations(spark, sf).select("object_id", "presence")
    there = F.when(F.col("presence") == "PRESENT", F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    own = F.struct(F.lit(1).cast("bigint"), there, there, there)
    folded = running_fold(obs, "object_id", own, STREAK, _joined_streaks, "streaks")
    return folded.select("object_id", F.col("streaks.tail").alias("streak"), "streaks.best")


@query("sample_n", f"WITH {X.OBS} SELECT object_id, country FROM obs ORDER BY {_key(42)} LIMIT 500")
def sample_n(spark, sf):
    return S.sample_n(X.observations(spark, sf), "object_id", 500).select("object_id", "country")


@query("take_first", f"WITH {X.VALID} SELECT object_id, presence FROM valid ORDER BY object_id LIMIT 100")
def take_first(spark, sf):
    return S.take_first(X.valid(spark, sf), "object_id", 100).select("object_id", "presence")


@query(
    "capped_pending",
    f"""WITH {X.VALID}, {X.MANIFEST} SELECT object_id FROM valid WHERE object_id NOT IN
        (SELECT object_id FROM last WHERE status IN ('completed', 'skipped')) ORDER BY object_id LIMIT 200""",
)
def capped_pending(spark, sf):
    rest = M.pending(X.valid(spark, sf), X.manifest(spark, sf), statuses=("completed", "skipped"))
    return S.cap_rows(rest, "object_id", 200).select("object_id")


N_SQL = "(SELECT least(count(*) FILTER (presence = 'PRESENT'), count(*) FILTER (presence = 'ABSENT')) FROM obs)"


@query(
    "balance_first",
    f"""WITH {X.OBS} SELECT object_id, presence FROM obs WHERE presence IN ('PRESENT', 'ABSENT')
        QUALIFY row_number() OVER (PARTITION BY presence ORDER BY object_id) <= {N_SQL}""",
)
def balance_first(spark, sf):
    return S.balance_first(X.observations(spark, sf), "object_id", "presence").select("object_id", "presence")


@query(
    "balance_first_capped",
    f"""WITH {X.OBS} SELECT object_id, presence FROM obs WHERE presence IN ('PRESENT', 'ABSENT')
        QUALIFY row_number() OVER (PARTITION BY presence ORDER BY object_id) <= least({N_SQL}, 1501 // 2)""",
)
def balance_first_capped(spark, sf):
    return S.balance_first(X.observations(spark, sf), "object_id", "presence", most=1501).select("object_id", "presence")


@query(
    "balance_random",
    f"""WITH {X.OBS} SELECT object_id, presence, {_key(42)} AS shuffle_key FROM obs WHERE presence IN ('PRESENT', 'ABSENT')
        QUALIFY row_number() OVER (PARTITION BY presence ORDER BY {_key(42)}) <= {N_SQL}""",
)
def balance_random(spark, sf):
    return S.balance_random(X.observations(spark, sf), "object_id", "presence").select("object_id", "presence", "shuffle_key")


def _split_sql(a: float, b: float, seed: int) -> str:
    first = f"CAST(floor({a}::DOUBLE * (SELECT count(*) FROM obs)) AS BIGINT)"
    second = f"CAST(floor({b}::DOUBLE * (SELECT count(*) FROM obs)) AS BIGINT)"
    return f"""WITH {X.OBS}, r AS (SELECT object_id, row_number() OVER (ORDER BY {_key(seed)}) AS k FROM obs)
        SELECT object_id, CASE WHEN k <= {first} THEN 'train' WHEN k <= {first} + {second} THEN 'val' ELSE 'test' END AS split FROM r"""


@query("split_60_20_20", _split_sql(0.6, 0.2, 7))
def split_60_20_20(spark, sf):
    return S.split_exact(X.observations(spark, sf), "object_id", (0.6, 0.2), seed=7).select("object_id", "split")


@query("split_70_15_15", _split_sql(0.7, 0.15, 42))
def split_70_15_15(spark, sf):
    return S.split_exact(X.observations(spark, sf), "object_id", (0.7, 0.15), seed=42).select("object_id", "split")
