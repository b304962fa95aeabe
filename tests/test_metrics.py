"""Scores against plain Python, and their degenerate cases."""

import math
import random

import pytest

from obsforge.operators import metrics as M

SCHEMA = "id BIGINT, y_true INT, y_pred INT, y_prob DOUBLE"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for i in range(400):
        t = int(rng.random() < 0.4)
        p = round(min(max(rng.gauss(0.4 + 0.2 * t, 0.2), 0.0), 1.0), 2)  # two decimals, so there are ties
        out.append((i, t, int(p > 0.5), p))
    return out


def brute_auc(rows):
    pos = [p for _, t, _, p in rows if t]
    neg = [p for _, t, _, p in rows if not t]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def brute_ap(rows):
    total, n_pos, before = 0.0, sum(t for _, t, _, _ in rows), 0.0
    for s in sorted({p for *_, p in rows}, reverse=True):
        hit = [t for _, t, _, p in rows if p >= s]
        recall = sum(hit) / n_pos
        total += (recall - before) * sum(hit) / len(hit)
        before = recall
    return total


def test_ranking_metrics(spark, rows):
    r = M.ranking_metrics(spark.createDataFrame(rows, SCHEMA)).first()
    assert math.isclose(r["auc_roc"], brute_auc(rows), abs_tol=1e-12)
    assert math.isclose(r["auc_pr"], brute_ap(rows), abs_tol=1e-12)


def test_all_scores_tied(spark):
    df = spark.createDataFrame([(i, i % 2, 1, 0.7) for i in range(10)], SCHEMA)
    r = M.ranking_metrics(df).first()
    assert r["auc_roc"] == 0.5 and r["auc_pr"] == 0.5


def test_one_class_only(spark):
    r = M.classification_metrics(spark.createDataFrame([(i, 1, i % 2, i / 10) for i in range(4)], SCHEMA)).first()
    assert r["auc_roc"] == 0.0 and r["specificity"] == 0.0 and r["matthews_cc"] == 0.0
    assert (r["true_positives"], r["false_negatives"], r["false_positives"]) == (2, 2, 0)


def test_large_counts_do_not_overflow(spark):
    from pyspark.sql import functions as F

    cells = spark.createDataFrame([(4 * 10**9, 3 * 10**9, 10**9, 2 * 10**9)], "tp BIGINT, tn BIGINT, fp BIGINT, fn BIGINT")
    m = cells.select(M.threshold_metrics(*(F.col(c) for c in ("tp", "tn", "fp", "fn")))["matthews_cc"].alias("m")).first()["m"]
    assert math.isclose(m, (12e18 - 2e18) / math.sqrt(5e9 * 6e9 * 4e9 * 5e9))


def test_sweep_is_strict(spark):
    df = spark.createDataFrame([(0, 1, 1, 0.5), (1, 0, 0, 0.1)], SCHEMA)
    out = {round(r["threshold"], 2): r for r in M.threshold_sweep(df).collect()}
    assert len(out) == 18
    assert out[0.45]["recall"] == 1.0 and out[0.5]["recall"] == 0.0
    assert out[0.1]["precision"] == 1.0  # 0.1 is not above 0.1


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(5)], "a DOUBLE, b DOUBLE")
    out = {(r["a"], r["b"]): r["r"] for r in M.correlation_matrix(df, ["a", "b"]).collect()}
    assert math.isclose(out["a", "a"], 1.0) and out["a", "b"] is None and out["b", "b"] is None


def test_own_model_leads(spark):
    rows = [("own", "f1", 0.9), ("x", "f1", 0.8), ("own", "r", 0.4), ("x", "r", 0.5)]
    out = {r["metric"]: r for r in M.best_per_metric(spark.createDataFrame(rows, "model STRING, metric STRING, value DOUBLE"), "own").collect()}
    assert (out["f1"]["best_model"], out["f1"]["gap_pct"]) == ("own", 0.0)
    assert out["r"]["best_model"] == "x" and math.isclose(out["r"]["gap_pct"], -20.0)
