"""From exported tiles to a balanced, split tile table, and from predictions to a metrics table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsforge.functions.values import sigmoid
from obsforge.operators import metrics as M
from obsforge.operators.pixels import INPUT_BANDS, bilinear_resize, centre_label, clean_pixels, crop_pad, standardise
from obsforge.operators.sampling import split_exact

COMPARED = ["accuracy", "f1_score", "auc_roc", "precision", "recall"]  # fixed values: metrics models are compared on


def predictions_from_logits(df: DataFrame, row_id: str, label: Column, logit: Column, threshold: float = 0.5) -> DataFrame:
    probability = sigmoid(logit)
    return df.select(
        F.col(row_id).alias("id"),
        label.cast("int").alias("y_true"),
        (probability > threshold).cast("int").alias("y_pred"),
        probability.alias("y_prob"),
    )


def prepare_tiles(pixels: DataFrame, size: int, how: str = "crop", label_band: int = INPUT_BANDS) -> DataFrame:
    """Clean pixels of the input bands on size x size tiles, standardised over the whole table."""
    cleaned = clean_pixels(pixels.where(F.col("band") < label_band))
    sized = crop_pad(cleaned, size, size) if how == "crop" else bilinear_resize(cleaned, size, size)
    return standardise(sized)


def labelled_tiles(
    pixels: DataFrame, shares: tuple[float, float] = (0.6, 0.2), seed: int = 42, label_band: int = INPUT_BANDS
) -> DataFrame:
    """One row per tile with its centre label and its part of the split."""
    return split_exact(centre_label(pixels, label_band), "file_key", shares, seed)


def score_predictions(predictions: DataFrame, model: str) -> DataFrame:
    """The eighteen scores as (model, metric, value)."""
    one = M.classification_metrics(predictions)
    return M.long_metrics(one, model, one.columns)


def compare_models(predictions: DataFrame, model: str) -> DataFrame:
    """Own and published scores on the compared metrics, in long form."""
    own = M.classification_metrics(predictions).select(*COMPARED)
    return M.long_metrics(own, model, COMPARED).unionByName(M.published_scores(own))
