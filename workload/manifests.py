"""Export names, progress, resuming, new files."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsforge.functions.names import build_name, flag_from_name, index_from_name, label_from_name, parse_name
from obsforge.functions.values import class_label
from obsforge.operators import manifest as M
from obsforge.session import shared_dir
from obsforge.streaming.ingest import ingest_new_files, ingested, merge_batches
from workload import fixtures as X
from workload.registry import query, r6, s6

LABEL = "CASE WHEN presence = 'PRESENT' THEN 1 ELSE 0 END"
NAMES = f"""names AS (SELECT object_id, obs_date, {LABEL} AS label, country,
  'locust_' || strftime(obs_date, '%Y-%m-%d') || '_label_' || {LABEL} || '_' || country || '_idx_' || object_id AS "current",
  'locust_' || strftime(obs_date, '%Y-%m-%d') || '_label_' || {LABEL} || '_idx_' || object_id AS "plain",
  'locust_' || strftime(obs_date, '%Y-%m-%d') || '_label_' || {LABEL} || '_' || (object_id + 1) AS "numbered",
  'patch_idx_' || object_id || '_' || strftime(obs_date, '%Y_%m_%d') || '_label_' || {LABEL} AS "scene",
  'Klein_MultiScale_locust_' || strftime(obs_date, '%Y-%m-%d') || '_label_' || {LABEL} || '_idx_' || object_id AS "multiscale" FROM obs)"""
KINDS = ("current", "plain", "numbered", "scene", "multiscale")


def _names(spark, sf):
    obs = X.observations(spark, sf)
    return obs.select(
        "object_id",
        *[
            build_name(k, F.col("obs_date"), class_label(F.col("presence")), F.col("object_id"), F.col("country")).alias(k)
            for k in KINDS
        ],
    )


@query("name_build", f"""WITH {X.OBS}, {NAMES} SELECT object_id, {", ".join(f'"{k}"' for k in KINDS)} FROM names""")
def name_build(spark, sf):
    return _names(spark, sf)


def _mixed(spark, sf):
    """Every row under one of the five formats, so that most parse and the rest give NULLs."""
    at = (F.col("object_id") % 5).cast("int")
    return _names(spark, sf).select("object_id", F.element_at(F.array(*KINDS), at + 1).alias("name"))


@query(
    "name_parse",
    f"""WITH {X.OBS}, {NAMES} SELECT object_id, CASE WHEN object_id % 5 < 3 THEN obs_date END AS date, CASE WHEN object_id % 5 < 3 THEN label END AS label,
        CASE WHEN object_id % 5 = 0 THEN country END AS country, CASE WHEN object_id % 5 < 3 THEN object_id END AS id FROM names""",
)
def name_parse(spark, sf):
    rows = _mixed(spark, sf)
    suffix = F.when(F.col("object_id") % 2 == 0, ".tif").otherwise(F.lit(""))
    return rows.select("object_id", parse_name(F.concat("name", suffix)).alias("n")).select("object_id", "n.*")


@query(
    "name_tokens",
    f"""WITH {X.OBS}, {NAMES} SELECT object_id, label, label AS flag, CASE object_id % 5 WHEN 2 THEN object_id + 1 WHEN 3 THEN label ELSE object_id END AS last_number FROM names""",
)
def name_tokens(spark, sf):
    path = F.concat(F.lit("/exports/a/"), "name", F.lit(".tif"))
    return _mixed(spark, sf).select(
        "object_id",
        label_from_name(path).alias("label"),
        flag_from_name(path).alias("flag"),
        index_from_name(path).alias("last_number"),
    )


@query(
    "count_by_name",
    f"""WITH {X.OBS}, {NAMES} SELECT count(*) AS n_files, CAST(sum(label) AS BIGINT) AS presence_count, CAST(sum(1 - label) AS BIGINT) AS absence_count,
        CAST(0 AS BIGINT) AS no_label, CAST(sum(label) AS BIGINT) AS flagged, count(*) AS indexed FROM names""",
)
def count_by_name(spark, sf):
    return M.count_by_name(_mixed(spark, sf), "name")


@query(
    "pending",
    f"""WITH {X.OBS}, {X.MANIFEST} SELECT object_id, presence FROM obs WHERE object_id NOT IN (SELECT object_id FROM last WHERE status = 'completed')""",
)
def pending(spark, sf):
    return M.pending(X.observations(spark, sf), X.manifest(spark, sf), statuses=("completed",)).select("object_id", "presence")


@query("latest_status", f"WITH {X.MANIFEST} SELECT object_id, status FROM last")
def latest_status(spark, sf):
    return M.latest(X.manifest(spark, sf)).select("object_id", "status")


@query(
    "progress_summary",
    f"""WITH {X.MANIFEST}, n AS (SELECT count(*) AS total_processed, count(*) FILTER (status = 'completed') AS completed_count,
        count(*) FILTER (status = 'failed') AS failed_count, count(*) FILTER (status = 'skipped') AS skipped_count FROM last)
        SELECT *, completed_count + failed_count + skipped_count AS total_count,
        {s6("100.0::DOUBLE * completed_count / (completed_count + failed_count + skipped_count)")} AS completion_percentage FROM n""",
)
def progress_summary(spark, sf):
    s = M.progress_summary(X.manifest(spark, sf))
    return s.withColumn("completion_percentage", r6(F.col("completion_percentage").cast("double")))


@query(
    "reconcile",
    f"""WITH {X.VALID}, {X.MANIFEST} SELECT coalesce(v.object_id, l.object_id) AS object_id,
        CASE WHEN l.object_id IS NULL THEN 'not_saved' ELSE 'not_expected' END AS side
        FROM valid v FULL JOIN last l ON v.object_id = l.object_id WHERE v.object_id IS NULL OR l.object_id IS NULL""",
)
def reconcile(spark, sf):
    return M.reconcile(X.valid(spark, sf), X.manifest(spark, sf))


@query(
    "new_or_changed",
    """SELECT page_id, md5(html) AS md5 FROM pages WHERE page_id % 3 = 0 OR page_id % 7 = 0""",
)
def new_or_changed(spark, sf):
    """Pages as files: every third is unknown, every seventh is known with other content."""
    pages = X.table(spark, sf, "pages")
    files = pages.select("page_id", F.md5(F.col("html").cast("binary")).alias("md5"))
    known = files.where(F.col("page_id") % 3 != 0).withColumn(
        "md5", F.when(F.col("page_id") % 7 == 0, F.lit("0")).otherwise(F.col("md5"))
    )
    return M.new_or_changed(files, known, ["page_id", "md5"])


@query(
    "progress_documents",
    """SELECT o_orderkey, 2 + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE -2 END AS n_processed, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 0 END AS completed_count,
       CAST(0 AS BIGINT) AS failed_count, CASE WHEN o_orderkey % 2 = 0 THEN '2020-01-01' ELSE 'unknown' END AS "timestamp" FROM orders""",
)
def progress_documents(spark, sf):
    full = F.concat(
        F.lit('{"processed_indices": ['), F.col("o_orderkey").cast("string"), F.lit(", 7], \"completed_count\": "),
        F.col("o_custkey").cast("string"), F.lit(', "timestamp": "2020-01-01"}'),
    )
    docs = X.table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, full).otherwise(F.lit("{}")).alias("doc")
    )
    out = M.progress_from_json(docs, "doc")
    return out.select("o_orderkey", F.size("processed_indices").alias("n_processed"), "completed_count", "failed_count", "timestamp")


@query(
    "ingest_new_files",
    f"SELECT event_type, user_id, count(*) AS n, {s6('sum(value)')} AS total FROM events GROUP BY event_type, user_id",
)
def ingest(spark, sf):
    """A file stream over the events table, run twice: the second run finds nothing new."""
    schema = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    target, checkpoint = shared_dir(spark, "ingest"), shared_dir(spark, "ingest-checkpoint")
    for _ in range(2):
        ingest_new_files(spark, sf, target, checkpoint, schema, "events.parquet")
    return ingested(spark, target).groupBy("event_type", "user_id").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total")
    )


@query(
    "ingest_in_batches",
    """SELECT event_type, user_id, count(*) AS n, CAST(sum(event_id) AS HUGEINT)::BIGINT AS ids FROM events GROUP BY ALL""",
)
def ingest_in_batches(spark, sf):
    """Files taken in few at a time, merged half way, and the rest taken in behind the merged folder."""
    folder, target, checkpoint = (shared_dir(spark, f"ingest-{x}") for x in ("files", "target", "checkpoint"))
    events = X.table(spark, sf, "events").select("event_id", "event_type", "user_id")
    half = F.pmod(F.xxhash64("event_id"), F.lit(2))
    for part in (0, 1):
        events.where(half == part).repartition(7).write.mode("append").parquet(folder)
        ingest_new_files(spark, folder, target, checkpoint, "event_id BIGINT, event_type STRING, user_id BIGINT", max_files=3)
        if part == 0:
            merge_batches(spark, target)
    return ingested(spark, target).groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
