"""Confusion, ranking and threshold metrics of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsforge.operators import metrics as M
from obsforge.plans import scoring
from workload import fixtures as X
from workload.registry import query, r6, s6

CELLS = """c AS (SELECT CAST(count(*) FILTER (y_true = 1 AND y_pred = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (y_true = 0 AND y_pred = 0) AS DOUBLE) AS tn,
  CAST(count(*) FILTER (y_true = 0 AND y_pred = 1) AS DOUBLE) AS fp, CAST(count(*) FILTER (y_true = 1 AND y_pred = 0) AS DOUBLE) AS fn FROM pred)"""
BASE = """b AS (SELECT *, tp + tn + fp + fn AS n, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r,
  coalesce(tn / nullif(tn + fp, 0), 0) AS sp FROM c)"""
STEPS = """st AS (SELECT y_prob, CAST(count(*) FILTER (y_true = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (y_true = 0) AS DOUBLE) AS neg FROM pred GROUP BY y_prob),
cum AS (SELECT *, sum(pos) OVER (ORDER BY y_prob DESC) AS cp, sum(neg) OVER (ORDER BY y_prob DESC) AS cn, sum(pos) OVER () AS tp_all, sum(neg) OVER () AS tn_all FROM st)"""
AUC = """(SELECT sum(neg * (cp - pos) + neg * pos / 2) / (max(tp_all) * max(tn_all)) FROM cum)"""
AP = """(SELECT sum(pos * cp / (cp + cn)) / max(tp_all) FROM cum)"""
SCORES = {
    "accuracy": "(tp + tn) / n",
    "precision": "p",
    "recall": "r",
    "f1_score": "2 * tp / (2 * tp + fp + fn)",
    "f2_score": "coalesce(5 * p * r / nullif(4 * p + r, 0), 0)",
    "specificity": "sp",
    "sensitivity": "r",
    "balanced_accuracy": "(r + sp) / 2",
    "cohen_kappa": "((tp + tn) / n - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)) / (1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n))",
    "matthews_cc": "(tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))",
    "g_mean": "sqrt(r * sp)",
    "youdens_j": "r + sp - 1",
}
WIDE = f"""WITH {X.PRED}, {CELLS}, {BASE}, {STEPS} SELECT {", ".join(f'{s6(e)} AS "{k}"' for k, e in SCORES.items())},
  CAST(tp AS BIGINT) AS true_positives, CAST(tn AS BIGINT) AS true_negatives, CAST(fp AS BIGINT) AS false_positives,
  CAST(fn AS BIGINT) AS false_negatives, {s6(AUC)} AS auc_roc, {s6(AP)} AS auc_pr FROM b"""
WHOLE = ("true_positives", "true_negatives", "false_positives", "false_negatives")


@query("classification_metrics", WIDE)
def classification_metrics(spark, sf):
    m = M.classification_metrics(X.predictions(spark, sf))
    return m.select(*[F.col(c) if c in WHOLE else r6(c).alias(c) for c in m.columns])


@query(
    "score_predictions",
    f"WITH wide AS ({WIDE}) SELECT 'own' AS model, metric, CAST(value AS DOUBLE) AS value FROM (SELECT COLUMNS(*)::DOUBLE FROM wide) UNPIVOT (value FOR metric IN (COLUMNS(*)))",
)
def score_predictions(spark, sf):
    return scoring.score_predictions(X.predictions(spark, sf), "own").select("model", "metric", r6("value").alias("value"))


@query(
    "confusion",
    f"""WITH {X.PRED}, k AS (SELECT a.v AS y_true, b.v AS y_pred FROM (VALUES (0), (1)) a(v), (VALUES (0), (1)) b(v)),
        n AS (SELECT k.y_true, k.y_pred, count(pred.id) AS n FROM k LEFT JOIN pred USING (y_true, y_pred) GROUP BY ALL)
        SELECT y_true, y_pred, n, {s6("n / CAST(sum(n) OVER (PARTITION BY y_true) AS DOUBLE)")} AS share FROM n""",
)
def confusion(spark, sf):
    return M.confusion(X.predictions(spark, sf)).withColumn("share", r6("share"))


@query("ranking_metrics", f"WITH {X.PRED}, {STEPS} SELECT {s6(AUC)} AS auc_roc, {s6(AP)} AS auc_pr")
def ranking_metrics(spark, sf):
    return M.ranking_metrics(X.predictions(spark, sf)).select(r6("auc_roc").alias("auc_roc"), r6("auc_pr").alias("auc_pr"))


@query(
    "ranking_of_prices",
    f"""WITH pred AS (SELECT l_extendedprice AS y_prob, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS y_true FROM lineitem), {STEPS}
        SELECT {s6(AUC)} AS auc_roc, {s6(AP)} AS auc_pr""",
)
def ranking_of_prices(spark, sf):
    """Many distinct scores: every line item is a prediction."""
    li = X.table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("y_prob"), (F.col("l_returnflag") == "A").cast("int").alias("y_true")
    )
    return M.ranking_metrics(li).select(r6("auc_roc").alias("auc_roc"), r6("auc_pr").alias("auc_pr"))


@query(
    "curve_points",
    f"""WITH {X.PRED}, {STEPS} SELECT y_prob AS threshold, {s6("cn / tn_all")} AS fpr, {s6("cp / tp_all")} AS tpr,
        {s6("cp / (cp + cn)")} AS "precision", {s6("cp / tp_all")} AS recall FROM cum""",
)
def curve_points(spark, sf):
    c = M.curve_points(X.predictions(spark, sf))
    return c.select("threshold", *[r6(k).alias(k) for k in ("fpr", "tpr", "precision", "recall")])


@query(
    "curve_areas",
    f"""WITH {X.PRED}, {STEPS}, l AS (SELECT *, cp / (cp + cn) AS prec, lag(cp / (cp + cn), 1, 1.0::DOUBLE) OVER (ORDER BY y_prob DESC) AS prev FROM cum)
        SELECT {s6(AUC)} AS roc_area, {s6("(SELECT sum(pos * (prec + prev) / 2) / max(tp_all) FROM l)")} AS pr_area""",
)
def curve_areas(spark, sf):
    return M.curve_areas(X.predictions(spark, sf)).select(r6("roc_area").alias("roc_area"), r6("pr_area").alias("pr_area"))


@query(
    "threshold_sweep",
    f"""WITH {X.PRED}, t AS (SELECT range / 20.0::DOUBLE AS threshold FROM range(2, 20)),
        c AS (SELECT threshold, CAST(count(*) FILTER (y_true = 1 AND y_prob > threshold) AS DOUBLE) AS tp, CAST(count(*) FILTER (y_true = 0 AND y_prob > threshold) AS DOUBLE) AS fp,
              CAST(count(*) FILTER (y_true = 1 AND y_prob <= threshold) AS DOUBLE) AS fn FROM pred, t GROUP BY threshold)
        SELECT threshold, {s6("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)")} AS f1_score, {s6("coalesce(tp / nullif(tp + fp, 0), 0)")} AS "precision",
          {s6("coalesce(tp / nullif(tp + fn, 0), 0)")} AS recall FROM c""",
)
def threshold_sweep(spark, sf):
    t = M.threshold_sweep(X.predictions(spark, sf))
    return t.select("threshold", *[r6(k).alias(k) for k in ("f1_score", "precision", "recall")])


@query(
    "score_histogram",
    f"""WITH {X.PRED}, e AS (SELECT y_true, min(y_prob) AS lo, max(y_prob) AS hi FROM pred GROUP BY y_true)
        SELECT y_true, CAST(least(floor((y_prob - lo) / (hi - lo) * 30) + 1, 30) AS INTEGER) AS bin, count(*) AS n FROM pred JOIN e USING (y_true) GROUP BY ALL""",
)
def score_histogram(spark, sf):
    return M.score_histogram(X.predictions(spark, sf))


HISTORY = ("l_quantity", "l_extendedprice", "l_discount")


@query(
    "correlation_matrix",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {s6(f'corr({a}, {b})')} AS r FROM lineitem" for a in HISTORY for b in HISTORY
    )
    + f" UNION ALL SELECT a, b, NULL FROM (SELECT 'one' AS a, unnest({[*HISTORY, 'one']}) AS b UNION ALL SELECT unnest({list(HISTORY)}), 'one'))",
)
def correlation_matrix(spark, sf):
    rows = X.table(spark, sf, "lineitem").select(*HISTORY, F.lit(1.0).alias("one"))
    return M.correlation_matrix(rows, [*HISTORY, "one"]).withColumn("r", r6("r"))


@query(
    "history_means",
    " UNION ALL ".join(f"SELECT '{c}' AS metric, {s6(f'avg({c})')} AS value FROM lineitem" for c in HISTORY),
)
def history_means(spark, sf):
    return M.history_means(X.table(spark, sf, "lineitem"), list(HISTORY)).withColumn("value", r6("value"))


@query(
    "class_balance",
    f"WITH {X.PRED} SELECT count(*) AS n, CAST(sum(y_true) AS BIGINT) AS positive, CAST(count(*) - sum(y_true) AS BIGINT) AS negative, {s6('avg(y_true)')} AS positive_share FROM pred",
)
def class_balance(spark, sf):
    return M.class_balance(X.predictions(spark, sf), "y_true").withColumn("positive_share", r6("positive_share"))


@query(
    "class_report",
    f"""WITH {X.PRED}, {CELLS}, k AS (SELECT 'Absence' AS class, coalesce(tn / nullif(tn + fn, 0), 0) AS p, coalesce(tn / nullif(tn + fp, 0), 0) AS r, coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS f, tn + fp AS s FROM c
        UNION ALL SELECT 'Presence', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0), coalesce(2 * tp / nullif(2 * tp + fn + fp, 0), 0), tp + fn FROM c),
        rows_ AS (SELECT * FROM k UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT (tp + tn) / (tp + tn + fp + fn) AS a, tp + tn + fp + fn AS n FROM c)
        UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(s) FROM k UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM k)
        SELECT class, {s6("p")} AS "precision", {s6("r")} AS recall, {s6("f")} AS f1_score, CAST(s AS BIGINT) AS support FROM rows_""",
)
def class_report(spark, sf):
    c = M.class_report(X.predictions(spark, sf))
    return c.select("class", *[r6(k).alias(k) for k in ("precision", "recall", "f1_score")], "support")


SCORE_ROWS = f"""own AS ({WIDE}), scores AS (SELECT 'own' AS model, metric, value FROM (SELECT accuracy, f1_score, auc_roc, "precision", recall FROM own)
    UNPIVOT (value FOR metric IN (accuracy, f1_score, auc_roc, "precision", recall)) UNION ALL SELECT * FROM (VALUES {
    ", ".join(f"('{m}', '{k}', {v}::DOUBLE)" for m, vs in M.PUBLISHED.items() for k, v in vs.items())}))"""


@query(
    "best_per_metric",
    f"""WITH {SCORE_ROWS}, b AS (SELECT metric, max({{'v': value, 'm': model}}) AS top, max(value) FILTER (model = 'own') AS own_value FROM scores GROUP BY metric)
        SELECT metric, top.m AS best_model, {s6("top.v")} AS best_value, {s6("own_value")} AS own_value,
          {s6("CASE WHEN top.m = 'own' THEN 0.0::DOUBLE ELSE (own_value - top.v) / top.v * 100 END")} AS gap_pct FROM b""",
)
def best_per_metric(spark, sf):
    rows = scoring.compare_models(X.predictions(spark, sf), "own").withColumn("value", r6("value"))
    b = M.best_per_metric(rows, "own")
    return b.select("metric", "best_model", *[r6(c).alias(c) for c in ("best_value", "own_value", "gap_pct")])


@query(
    "mean_per_model",
    f"""WITH {SCORE_ROWS}, m AS (SELECT model, avg(value) AS mean_score FROM scores GROUP BY model)
        SELECT model, {s6("mean_score")} AS mean_score, {s6("((SELECT mean_score FROM m WHERE model = 'own') - mean_score) / mean_score * 100")} AS gap_pct FROM m""",
)
def mean_per_model(spark, sf):
    rows = scoring.compare_models(X.predictions(spark, sf), "own").withColumn("value", r6("value"))
    m = M.mean_per_model(rows, "own")
    return m.select("model", r6("mean_score").alias("mean_score"), r6("gap_pct").alias("gap_pct"))


@query(
    "logits_to_predictions",
    f"""SELECT doc_id AS id, quality AS y_true, CASE WHEN (doc_id % 13) - 6 > 0 THEN 1 ELSE 0 END AS y_pred, {s6("1 / (1 + exp(-((doc_id % 13) - 6)))")} AS y_prob FROM labels""",
)
def logits_to_predictions(spark, sf):
    labels = X.table(spark, sf, "labels")
    out = scoring.predictions_from_logits(labels, "doc_id", F.col("quality"), F.col("doc_id") % 13 - 6)
    return out.withColumn("y_prob", r6("y_prob"))


@query(
    "pixel_accuracy",
    f"""WITH {X.PIX}, m AS (SELECT l.value > 0.5 AS y, i.value > 0 AS p FROM pix l JOIN pix i ON l.file_key = i.file_key AND l."row" = i."row" AND l.col = i.col WHERE l.band = 59 AND i.band = 0)
        SELECT count(*) AS n_pixels, {s6("avg(CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS accuracy FROM m""",
)
def pixel_accuracy(spark, sf):
    from obsforge.functions.values import binarise
    from obsforge.operators.pixels import binary_label, clean_pixels

    pix = clean_pixels(X.pixels(spark, sf))
    masks = pix.where(F.col("band") == 0).select("file_key", "row", "col", binarise(F.col("value"), 0.0).alias("y_pred"))
    labels = binary_label(pix).withColumnRenamed("label", "y_true")
    return M.pixel_accuracy(masks.join(labels, ["file_key", "row", "col"])).withColumn("accuracy", r6("accuracy"))
