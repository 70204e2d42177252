"""Scoring snippets with a fitted model: verdict, confidence and the reasons for it."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.operators.corpus import nonblank
from inkprint.operators.detectors import with_probability
from inkprint.operators.explain import TreeTable, sampled_attributions, top_contributions, unit_of, with_attributions
from inkprint.operators.features import align_features, with_features
from inkprint.operators.metrics import threshold_prediction


# Wording of the verdict.
LIKELY_AI, LIKELY_HUMAN = "Likely AI-generated", "Likely human-written"


def verdict(probability: Column) -> Column:
    return F.when(probability > 0.5, LIKELY_AI).otherwise(LIKELY_HUMAN)


def confidence(probability: Column) -> Column:
    return F.format_string("%.1f%%", probability * 100)


def score_snippets(
    df: DataFrame, model: PipelineModel, top_k: int = 6, trees: TreeTable | None = None, background: DataFrame | None = None
) -> DataFrame:
    """(id, score, prediction, verdict, confidence, reasons, unit) for one snippet or all of them.

    ``model`` is any fitted baseline; ``unit`` says what the reasons add up to, and both are null for one
    whose score has no shares of features, unless ``background`` has rows of (id, features) to stand for absent ones (``sampled_attributions``). Narrow from end to end: nothing is shuffled unless the model
    is too large to send to every task (``with_attributions``).
    """
    names = list(model.stages[0].getInputCols())
    aligned = align_features(with_features(nonblank(df.select("id", "code"))), names, ["id"])
    if unit_of(model) is None and background is not None:
        scored = with_probability(model.transform(sampled_attributions(aligned, model, background)))
    else:
        scored = with_attributions(with_probability(model.transform(aligned)), model, trees=trees)
    score = F.col("score")
    return scored.select(
        "id",
        "score",
        threshold_prediction(score).alias("prediction"),
        verdict(score).alias("verdict"),
        confidence(score).alias("confidence"),
        F.when(F.col("shap").isNotNull(), top_contributions(F.col("shap"), names, top_k)).alias("reasons"),
        "unit",
    )
