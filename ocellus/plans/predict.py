"""Decisions for new images, by a saved model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.config import Features, Quality
from ocellus.functions.scalars import refer
from ocellus.ml.models import Fitted
from ocellus.operators.extract import extract, pixels


def decide(rows: DataFrame, model: Fitted, threshold: float | None) -> DataFrame:
    """image_id, predicted_grade, severity_score (4 digits, half to even), gradable, qc_reasons, and refer where a threshold is known."""
    out = model.transform(rows)
    cols = [F.col("image_id"), F.col("prediction").alias("predicted_grade"), F.bround("score", 4).alias("severity_score"), F.col("gradable"), F.col("qc_reasons")]
    decision = refer(F.col("score"), threshold)
    return out.select(*cols, *([decision.alias("refer")] if decision is not None else []))


def predict(images: DataFrame, model: Fitted, threshold: float | None = None, features: Features = Features(), quality: Quality = Quality()) -> DataFrame:
    """``images``: image_id, image_path. Ungradable images are scored too, and flagged; failed ones are scored by the medians."""
    return decide(extract(pixels(images), features, quality), model, threshold)
