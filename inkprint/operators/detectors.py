"""Trained detectors: boosted trees, forest and kernel machine on features, and a lexical
classifier on token n-grams. All fits are jobs over the training partitions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.operators.boosting import NewtonTrees
from inkprint.operators.corpus import in_split
from inkprint.operators.epochs import LexicalModel, train_lexical  # noqa: F401
from inkprint.operators.forest import DeepForest
from inkprint.operators.kernel import fit_kernel_machine, kernel_width  # noqa: F401
from inkprint.operators.metrics import evaluate

VECTOR = "features"
PROBABILITY = "score"


def assembler(columns: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=VECTOR, handleInvalid="keep")


def fit_pipeline(estimator: Estimator, columns: Sequence[str], train: DataFrame) -> PipelineModel:
    """Assemble the columns and fit."""
    return Pipeline(stages=[assembler(columns), estimator]).fit(train)


def boosted_trees(
    rounds: int = 300,
    depth: int = 6,
    rate: float = 0.05,
    rows: float = 0.9,
    columns: float = 0.9,
    seed: int = 42,
) -> NewtonTrees:
    return NewtonTrees(featuresCol=VECTOR, rounds=rounds, depth=depth, rate=rate, rows=rows, columns=columns, seed=seed)


def forest(trees: int = 300, seed: int = 42) -> DeepForest:
    """Trees of any depth."""
    return DeepForest(featuresCol=VECTOR, trees=trees, seed=seed)


def with_probability(scored: DataFrame, out: str = PROBABILITY) -> DataFrame:
    """Probability of the AI class as a plain column."""
    return scored.withColumn(out, vector_to_array("probability")[1])


def baseline_estimators(rounds: int = 300, trees: int = 300) -> dict[str, Estimator]:
    """Extension point: name -> estimator over the feature vector."""
    return {"boosted_trees": boosted_trees(rounds), "random_forest": forest(trees)}


def train_baselines(
    features: DataFrame,
    columns: Sequence[str],
    estimators: dict[str, Estimator] | None = None,
    kernel: dict | None = None,
    fitted: dict[str, PipelineModel] | None = None,
) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Fit every baseline on the train split; one metrics row per model and held-out split.

    ``features`` is read once per model for training and once for scoring: pass a stored matrix. No rows are kept in executors' memory.
    ``kernel`` holds options of the kernel machine; ``{}`` takes the defaults and None
    leaves it out. ``fitted`` holds models by name that are taken as they are. All models are evaluated in one job over the union of their scores.
    """
    estimators = baseline_estimators() if estimators is None else estimators
    train = in_split(features, "train")
    models = {
        name: (fitted or {}).get(name) or fit_pipeline(estimator, columns, train)
        for name, estimator in estimators.items()
    }
    if kernel is not None:
        models["kernel_machine"] = fit_kernel_machine(train, columns, **kernel)
    held_out = features.where(F.col("split").isin("val", "test"))
    scored = reduce(
        DataFrame.unionByName,
        [
            with_probability(model.transform(held_out)).select(
                F.lit(name).alias("model"), "split", "id", "label", PROBABILITY
            )
            for name, model in models.items()
        ],
    )
    return models, evaluate(scored, ["model", "split"])


def importances(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """(feature_ix, feature, importance) of a fitted tree model."""
    names = model.stages[0].getInputCols()
    values = model.stages[-1].featureImportances
    values = values if isinstance(values, np.ndarray) else values.toArray()
    rows = [(i, name, float(v)) for i, (name, v) in enumerate(zip(names, values))]
    return spark.createDataFrame(rows, "feature_ix int, feature string, importance double")


def top_importances(model: PipelineModel, spark: SparkSession, n: int = 20) -> DataFrame:
    return importances(model, spark).orderBy(F.col("importance").desc(), "feature_ix").limit(n)


# --- lexical classifier -------------------------------------------------------------


def score_lexical(model: LexicalModel, df: DataFrame) -> DataFrame:
    scored = with_probability(model.transform(df))
    return scored.select("id", PROBABILITY)
