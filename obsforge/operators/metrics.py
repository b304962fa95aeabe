"""Scores of binary predictions: (id, y_true, y_pred, y_prob)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsforge.operators.ranking import ROWS_PER_BUCKET, running_totals

# Thresholds 0.10, 0.15 .. 0.95, as twentieths.
THRESHOLD_TWENTIETHS = range(2, 20)
SCORE_BINS = 30

# Published scores other methods are compared with.
PUBLISHED = {
    "PLAN": {"accuracy": 0.8174, "f1_score": 0.7918, "auc_roc": 0.8904, "precision": 0.7900, "recall": 0.7950},
    "Prithvi-LB": {"accuracy": 0.8303, "f1_score": 0.8153, "auc_roc": 0.8769, "precision": 0.8212, "recall": 0.8290},
    "HMM-based": {"accuracy": 0.7800, "f1_score": 0.7200, "auc_roc": 0.8500, "precision": 0.7400, "recall": 0.7000},
    "ConvLSTM": {"accuracy": 0.7576, "f1_score": 0.6734, "auc_roc": 0.6361, "precision": 0.8037, "recall": 0.6648},
    "MaxEnt": {"accuracy": 0.8400, "f1_score": 0.7500, "auc_roc": 0.8400, "precision": 0.7800, "recall": 0.7200},
}


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, or `default` when b is 0."""
    return F.when(b != 0, a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))).otherwise(F.lit(default))


def cell_counts(df: DataFrame) -> DataFrame:
    """tp, tn, fp and fn of the whole table: one pass, one row."""
    true, pred = F.col("y_true"), F.col("y_pred")
    return df.agg(
        F.count_if((true == 1) & (pred == 1)).alias("tp"),
        F.count_if((true == 0) & (pred == 0)).alias("tn"),
        F.count_if((true == 0) & (pred == 1)).alias("fp"),
        F.count_if((true == 1) & (pred == 0)).alias("fn"),
    )


def confusion(df: DataFrame) -> DataFrame:
    """The four cells as rows, with the share of their true class; absent cells are 0."""
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(t).alias("y_true"), F.lit(p).alias("y_pred"), F.col(n).alias("n"), (F.col(n) + F.col(o)).alias("row_n"))
                for t, p, n, o in ((0, 0, "tn", "fp"), (0, 1, "fp", "tn"), (1, 0, "fn", "tp"), (1, 1, "tp", "fn"))
            ]
        )
    )
    return (
        cell_counts(df).select(cells.alias("c")).select("c.y_true", "c.y_pred", "c.n", ratio(F.col("c.n"), F.col("c.row_n")).alias("share"))
    )


def threshold_metrics(tp: Column, tn: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Closed forms over the four counts, zero where a denominator is."""
    tp, tn, fp, fn = (c.cast("double") for c in (tp, tn, fp, fn))
    n = tp + tn + fp + fn
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    specificity = ratio(tn, tn + fp)
    observed = ratio(tp + tn, n)
    expected = ratio((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "accuracy": observed,
        "precision": precision,
        "recall": recall,
        "f1_score": ratio(tp * 2, tp * 2 + fp + fn),
        "f2_score": ratio(precision * recall * 5, precision * 4 + recall),
        "specificity": specificity,
        "sensitivity": recall,
        "balanced_accuracy": (recall + specificity) / 2,
        "cohen_kappa": ratio(observed - expected, F.lit(1.0) - expected),
        "matthews_cc": ratio(tp * tn - fp * fn, spread),
        "g_mean": F.sqrt(recall * specificity),
        "youdens_j": recall + specificity - 1,
    }


def score_steps(df: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Distinct scores from high to low with positives and negatives at the score and at or above it."""
    steps = (
        df.where(F.col("y_prob").isNotNull())
        .groupBy("y_prob")
        .agg(F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg"))
    )
    return running_totals(steps, "y_prob", ["pos", "neg"], descending=True, rows_per_bucket=rows_per_bucket)


def ranking_metrics(df: DataFrame) -> DataFrame:
    """One row: area under the ROC curve, ties counting half, and average precision; 0 with one class only."""
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    below = F.col("neg_cum").cast("double") - neg
    cum_pos, cum = F.col("pos_cum").cast("double"), (F.col("pos_cum") + F.col("neg_cum")).cast("double")
    sums = score_steps(df).agg(
        F.coalesce(F.sum(pos), F.lit(0.0)).alias("p"),
        F.coalesce(F.sum(neg), F.lit(0.0)).alias("n"),
        F.sum(pos * (below + neg * 0.5)).alias("above"),
        F.sum(pos * cum_pos / cum).alias("precision_sum"),
    )
    p, n = F.col("p"), F.col("n")
    return sums.select(
        F.when((p > 0) & (n > 0), F.lit(1.0) - F.col("above") / F.nullif(p * n, F.lit(0.0))).otherwise(0.0).alias("auc_roc"),
        F.when(p > 0, F.col("precision_sum") / F.nullif(p, F.lit(0.0))).otherwise(0.0).alias("auc_pr"),
    )


def classification_metrics(df: DataFrame) -> DataFrame:
    """The eighteen scores in one row."""
    cells = cell_counts(df)
    flat = cells.select(
        *[m.alias(k) for k, m in threshold_metrics(*(F.col(c) for c in ("tp", "tn", "fp", "fn"))).items()],
        F.col("tp").alias("true_positives"),
        F.col("tn").alias("true_negatives"),
        F.col("fp").alias("false_positives"),
        F.col("fn").alias("false_negatives"),
    )
    area = ranking_metrics(df).select(F.struct("auc_roc", "auc_pr")).scalar()
    return flat.withColumns({"auc_roc": area["auc_roc"], "auc_pr": area["auc_pr"]})


def curve_points(df: DataFrame) -> DataFrame:
    """One row per distinct score: false and true positive rate, precision and recall when everything from it up is positive."""
    steps = score_steps(df)
    total = df.where(F.col("y_prob").isNotNull()).agg(
        F.struct(F.count_if(F.col("y_true") == 1).alias("p"), F.count_if(F.col("y_true") == 0).alias("n"))
    ).scalar()
    return steps.select(
        F.col("y_prob").alias("threshold"),
        ratio(F.col("neg_cum"), total["n"]).alias("fpr"),
        ratio(F.col("pos_cum"), total["p"]).alias("tpr"),
        ratio(F.col("pos_cum"), F.col("pos_cum") + F.col("neg_cum")).alias("precision"),
        ratio(F.col("pos_cum"), total["p"]).alias("recall"),
    )


def curve_areas(df: DataFrame) -> DataFrame:
    """Trapezoid areas under both curves, from the same steps; the first PR point has recall 0 and precision 1."""
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    cum_pos, cum_neg = F.col("pos_cum").cast("double"), F.col("neg_cum").cast("double")
    before_pos, before_neg = cum_pos - pos, cum_neg - neg
    before = before_pos + before_neg
    earlier = F.when(before > 0, before_pos / F.nullif(before, F.lit(0.0))).otherwise(F.lit(1.0))
    sums = score_steps(df).agg(
        F.sum(pos).alias("p"),
        F.sum(neg).alias("n"),
        F.sum(neg * (cum_pos + before_pos) / 2.0).alias("roc"),
        F.sum(pos * (cum_pos / (cum_pos + cum_neg) + earlier) / 2.0).alias("pr"),
    )
    return sums.select(
        ratio(F.col("roc"), F.col("p") * F.col("n")).alias("roc_area"), ratio(F.col("pr"), F.col("p")).alias("pr_area")
    )


def threshold_sweep(df: DataFrame, twentieths=THRESHOLD_TWENTIETHS) -> DataFrame:
    """f1, precision and recall for each threshold, a score counting as positive when strictly above it.

    Rows are counted once, by how many thresholds they pass; the sums over at
    most len(thresholds) + 1 groups do the rest.
    """
    cuts = [k / 20 for k in twentieths]
    passed = F.lit(0)
    for t in cuts:
        passed = passed + F.when(F.col("y_prob") > t, 1).otherwise(0)
    groups = df.groupBy(passed.alias("passed")).agg(
        F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg")
    )
    over = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(cuts)]))
    rows = groups.select("passed", "pos", "neg", over.alias("c")).groupBy("c.i", "c.t").agg(
        F.sum(F.when(F.col("passed") > F.col("c.i"), F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("passed") > F.col("c.i"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("passed") > F.col("c.i"), 0).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(F.col("passed") > F.col("c.i"), 0).otherwise(F.col("neg"))).alias("tn"),
    )
    scores = threshold_metrics(*(F.col(c) for c in ("tp", "tn", "fp", "fn")))
    return rows.select(
        F.col("t").alias("threshold"), *[scores[k].alias(k) for k in ("f1_score", "precision", "recall")]
    )


def score_histogram(df: DataFrame, bins: int = SCORE_BINS) -> DataFrame:
    """Counts of scores per class in `bins` equal bins between the class's own extremes; bins from 1."""
    of = {c: F.when(F.col("y_true") == c, F.col("y_prob")) for c in (0, 1)}
    ends = df.agg(F.struct(*[f(v).alias(f"{n}{c}") for c, v in of.items() for n, f in (("low", F.min), ("high", F.max))])).scalar()
    low, high = (F.when(F.col("y_true") == 1, ends[f"{n}1"]).otherwise(ends[f"{n}0"]) for n in ("low", "high"))
    placed = df.where(F.col("y_true").isin(0, 1)).withColumns({"low": low, "high": high}).withColumn(
        "bin",
        F.when(F.col("high") > F.col("low"), F.least(F.width_bucket("y_prob", "low", "high", F.lit(bins)), F.lit(bins)))
        .otherwise(F.lit(bins // 2 + 1))
        .cast("int"),
    )
    return placed.groupBy("y_true", "bin").agg(F.count(F.lit(1)).alias("n"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair, (a, b, r) rows from one pass; NULL when a column is constant."""
    pairs = [(a, b) for a in columns for b in columns]
    one = df.agg(
        *[F.min(c).alias(f"lo_{c}") for c in columns],
        *[F.max(c).alias(f"hi_{c}") for c in columns],
        *[F.covar_pop(a, b).alias(f"cov_{i}") for i, (a, b) in enumerate(pairs) if a <= b],
    )
    position = {pair: i for i, pair in enumerate(pairs)}

    def cov(a: str, b: str) -> Column:
        return F.col(f"cov_{position[(a, b) if a <= b else (b, a)]}")

    def varies(c: str) -> Column:
        return F.col(f"hi_{c}") > F.col(f"lo_{c}")

    cells = [
        F.struct(
            F.lit(a).alias("a"),
            F.lit(b).alias("b"),
            F.when(varies(a) & varies(b), F.try_divide(cov(a, b), F.sqrt(cov(a, a) * cov(b, b)))).alias("r"),
        )
        for a, b in pairs
    ]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(label).cast("bigint")).alias("positive"),
        (F.count(F.lit(1)) - F.sum(F.col(label).cast("bigint"))).alias("negative"),
        F.avg(F.col(label).cast("double")).alias("positive_share"),
    )


def class_report(df: DataFrame, names: tuple[str, str] = ("Absence", "Presence")) -> DataFrame:
    """Precision, recall, f1 and support per class, then accuracy, macro and weighted averages."""
    counts = cell_counts(df)
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    per_class = [
        (names[0], ratio(tn, tn + fn), ratio(tn, tn + fp), ratio(tn * 2, tn * 2 + fn + fp), tn + fp),
        (names[1], ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tp * 2, tp * 2 + fp + fn), tp + fn),
    ]
    n = tp + tn + fp + fn
    rows = [(name, p, r, f, s) for name, p, r, f, s in per_class]
    accuracy = ratio(tp + tn, n)
    rows.append(("accuracy", accuracy, accuracy, accuracy, n))
    (_, p0, r0, f0, s0), (_, p1, r1, f1, s1) = per_class
    rows.append(("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n))
    rows.append(("weighted avg", *(ratio(a * s0 + b * s1, n) for a, b in ((p0, p1), (r0, r1), (f0, f1))), n))
    cells = [
        F.struct(
            F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1_score"), s.cast("bigint").alias("support")
        )
        for name, p, r, f, s in rows
    ]
    return counts.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def long_metrics(one_row: DataFrame, model: str, metrics: list[str]) -> DataFrame:
    """A one-row metrics table as (model, metric, value)."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    return one_row.select(F.lit(model).alias("model"), cells.alias("c")).select("model", "c.metric", "c.value")


def published_scores(one_row: DataFrame, scores: Mapping[str, Mapping[str, float]] = PUBLISHED) -> DataFrame:
    """The fixed score table in long form, hung on a one-row table of any content."""
    cells = F.array(
        *[
            F.struct(F.lit(model).alias("model"), F.lit(metric).alias("metric"), F.lit(value).alias("value"))
            for model, values in scores.items()
            for metric, value in values.items()
        ]
    )
    return one_row.select(F.explode(cells).alias("c")).select("c.*")


def best_per_metric(scores: DataFrame, own: str) -> DataFrame:
    """Per metric: the best model, its value, the own value and the gap in percent of the best."""
    best = F.max_by(F.col("model"), F.struct(F.col("value"), F.col("model")))
    return (
        scores.groupBy("metric")
        .agg(best.alias("best_model"), F.max("value").alias("best_value"), F.max(F.when(F.col("model") == own, F.col("value"))).alias("own_value"))
        .withColumn(
            "gap_pct",
            F.when(F.col("best_model") == own, F.lit(0.0)).otherwise(ratio((F.col("own_value") - F.col("best_value")) * 100, F.col("best_value"))),
        )
    )


def mean_per_model(scores: DataFrame, own: str) -> DataFrame:
    """Mean score per model and by how many percent the own mean differs from it."""
    means = scores.groupBy("model").agg(F.avg("value").alias("mean_score"))
    mine = means.where(F.col("model") == own).select("mean_score").scalar()
    return means.withColumn("gap_pct", ratio((mine - F.col("mean_score")) * 100, F.col("mean_score")))


def history_means(history: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean of each metric over a table with one row per epoch."""
    one = history.agg(*[F.avg(m).alias(m) for m in metrics])
    return long_metrics(one, "history", metrics).select("metric", "value")


def pixel_accuracy(predicted: DataFrame) -> DataFrame:
    """Share of all pixels whose predicted mask equals the label."""
    return predicted.agg(
        F.count(F.lit(1)).alias("n_pixels"),
        ratio(F.count_if(F.col("y_pred") == F.col("y_true")), F.count(F.lit(1))).alias("accuracy"),
    )
