"""Train on one generator's snippets, test on another's."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.operators.corpus import distinct_source_models, in_split
from inkprint.operators.detectors import boosted_trees, fit_pipeline, with_probability
from inkprint.operators.metrics import areas_against_rest
from inkprint.storage import MAX_BROADCAST_GROUPS, broadcast_bounded

MIN_ROWS = 10
_PARALLEL_FITS = 4


def pair_grid(df: DataFrame) -> DataFrame:
    """Every (train_model, test_model) of the generators of the AI rows: a join of their table of names with itself."""
    names = distinct_source_models(df)
    tests = names.select(F.col("source_model").alias("test_model"))
    return names.select(F.col("source_model").alias("train_model")).join(tests, F.lit(True))


def rows_for_model(df: DataFrame, model: str | Column) -> DataFrame:
    """AI rows of one generator and all human rows, in one filter."""
    return df.where((F.col("label") == 0) | (F.col("source_model") == model))


def population(df: DataFrame) -> DataFrame:
    """AI rows per generator in train and test."""
    return (
        df.where("label = 1")
        .groupBy("source_model")
        .agg(
            F.count_if(F.col("split") == "train").alias("n_train"),
            F.count_if(F.col("split") == "test").alias("n_test"),
        )
    )


def training_rows(df: DataFrame) -> DataFrame:
    """Every AI row under its generator and every human row under each generator, in one scan: (model, columns of df).

    The human rows are joined to the table of names, which has a row for each planned fit.
    """
    names = distinct_source_models(df).select(F.col("source_model").alias("model"))
    mine = (F.col("label") == 0) | (F.col("source_model") == F.col("model"))
    return df.join(broadcast_bounded(names, MAX_BROADCAST_GROUPS), mine).select("model", *df.columns)


def guarded_grid(df: DataFrame, minimum: int = MIN_ROWS) -> DataFrame:
    """The grid with both populations and whether the cell is defined."""
    sizes = population(df)
    train = sizes.select(F.col("source_model").alias("train_model"), "n_train")
    test = sizes.select(F.col("source_model").alias("test_model"), "n_test")
    grid = pair_grid(df).join(train, "train_model", "left").join(test, "test_model", "left")
    filled = grid.na.fill(0, ["n_train", "n_test"])
    return filled.withColumn("is_defined", F.least("n_train", "n_test") >= minimum)


def transfer_auc(
    features: DataFrame,
    columns: Sequence[str],
    estimator: Estimator | None = None,
    minimum: int = MIN_ROWS,
) -> DataFrame:
    """(train_model, test_model, roc_auc), null where a population is too small.

    One fit per generator; the fits are independent jobs, a few at a time. Test rows are scanned once, each
    scored by every model, and collapse to counts per score. An AI score's area is the number of human
    scores below it, which does not depend on who generated it: so human rows are counted once for a
    model and copied for no generator.
    """
    estimator = estimator or boosted_trees(200, 5, rate=0.3, rows=1.0, columns=1.0)
    grid = guarded_grid(features, minimum).select("train_model", "test_model", "is_defined")
    # one name for each fit that follows
    trainable = sorted(r[0] for r in grid.where("is_defined").select("train_model").distinct().collect())
    if not trainable:
        return grid.select("train_model", "test_model", F.lit(None).cast("double").alias("roc_auc"))

    train = in_split(features, "train").persist()
    try:

        def fit(name: str):
            return fit_pipeline(estimator, columns, rows_for_model(train, name))

        with ThreadPool(_PARALLEL_FITS) as pool:
            fitted = pool.map(inheritable_thread_target(features.sparkSession)(fit), trainable)
    finally:
        train.unpersist()
    scored, scores = in_split(features, "test"), []
    for i, model in enumerate(fitted):
        own = f"_score{i}"
        scores.append(F.struct(F.lit(trainable[i]).alias("train_model"), F.col(own).alias("score")))
        scored = with_probability(model.transform(scored), own).drop("features", "rawPrediction", "probability", "prediction")
    cells = scored.select("label", F.col("source_model").alias("test_model"), F.inline(F.array(*scores)))
    aucs = areas_against_rest(cells, ["train_model"], "test_model")
    return grid.join(aucs, ["train_model", "test_model"], "left").select(
        "train_model", "test_model", F.when(F.col("is_defined"), F.col("roc_auc")).alias("roc_auc")
    )
