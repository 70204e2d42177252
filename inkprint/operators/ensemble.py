"""Stacking: three per-snippet scores, one balanced logistic model."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.operators.corpus import in_split
from inkprint.operators.detectors import assembler, with_probability
from inkprint.operators.metrics import evaluate

STACKED = ["baseline_prob", "lexical_prob", "likelihood_score"]


def merge_scores(
    dataset: DataFrame, baseline: DataFrame, lexical: DataFrame, likelihood: DataFrame
) -> DataFrame:
    """Label, split and the three scores, aligned by id; each input is (id, score)."""
    merged = dataset.select("id", "label", "split")
    for name, scores in zip(STACKED, (baseline, lexical, likelihood)):
        merged = merged.join(scores.select("id", F.col("score").alias(name)), "id")
    return merged


def with_balanced_weights(train: DataFrame, out: str = "weight") -> DataFrame:
    """n / (2 n_class) per row; the class table has one row per label."""
    sizes = train.groupBy("label").agg(F.count("*").alias("_n_class"))
    total = train.agg(F.count("*").alias("_n"))
    weighted = train.join(F.broadcast(sizes), "label").crossJoin(F.broadcast(total))
    return weighted.withColumn(out, F.col("_n") / (2 * F.col("_n_class"))).drop("_n", "_n_class")


def train_ensemble(merged: DataFrame) -> tuple[PipelineModel, DataFrame]:
    """The fitted stack and its validation metrics.

    The weights sum to n, so regParam = 1/n is the objective of an unscaled L2 penalty
    with C = 1.
    """
    train = with_balanced_weights(in_split(merged, "train").na.drop(subset=STACKED)).persist()
    try:
        logistic = LogisticRegression(
            featuresCol="features",
            weightCol="weight",
            standardization=False,
            regParam=1 / max(train.count(), 1),
            maxIter=100,
        )
        model = Pipeline(stages=[assembler(STACKED), logistic]).fit(train)
    finally:
        train.unpersist()
    val = in_split(merged, "val").na.drop(subset=STACKED)
    return model, evaluate(with_probability(model.transform(val)), [])


def learned_weights(model: PipelineModel, df: DataFrame) -> DataFrame:
    logistic = model.stages[-1]
    rows = list(zip(STACKED, map(float, logistic.coefficients.toArray())))
    rows.append(("intercept", float(logistic.intercept)))
    return df.sparkSession.createDataFrame(rows, "input string, weight double")
