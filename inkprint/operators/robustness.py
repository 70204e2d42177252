"""How a fixed model's metrics change when its test snippets are transformed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkprint.functions.attacks import ATTACKS, Attack, attacked, draw
from inkprint.operators.corpus import drop_null_code, in_split
from inkprint.operators.detectors import with_probability
from inkprint.operators.features import align_features, with_features
from inkprint.operators.metrics import evaluate
from inkprint.operators.ranking import seeded_sample


def attack_rows(
    df: DataFrame, attacks: dict[str, Attack] | None = None, seed: int = 42
) -> DataFrame:
    """One row per snippet and attack. Each row is unfolded in place: no join."""
    variants = attacked(attacks or ATTACKS, F.col("code"), F.col("id"), seed)
    return df.select("id", "label", F.inline(variants))


def with_strengths(
    scored: DataFrame, strengths: Sequence[float], seed: int = 42
) -> DataFrame:
    """Each scored attack at several strengths, the share of snippets it is applied to.

    Snippets are chosen by hash, so those attacked at one strength are attacked at every
    greater one. Untouched snippets take the score of their own text; nothing is extracted
    or scored again. A snippet has one row per attack, so the window stays small.
    """
    own = F.max(F.when(F.col("attack") == "none", F.col("score"))).over(Window.partitionBy("id"))
    chosen = draw(F.md5(F.concat(F.lit(f"{seed}|strength|"), "id")), 0) / F.lit(float(2**32))
    levels = F.array(*[F.lit(float(s)) for s in strengths])
    rows = scored.withColumn("_own", own).withColumn("strength", F.explode(levels))
    score = F.when(chosen < F.col("strength"), F.col("score")).otherwise(F.col("_own"))
    return rows.withColumn("score", score).drop("_own")


def robustness(
    model: PipelineModel,
    dataset: DataFrame,
    n_samples: int | None = None,
    attacks: dict[str, Attack] | None = None,
    seed: int = 42,
    strengths: Sequence[float] | None = None,
) -> DataFrame:
    """(attack, accuracy, roc_auc) on the whole test split, or on a seeded sample of it.

    All attacks go through one plan with the attack as a column: features are extracted,
    aligned to the training columns and scored once. ``strengths`` adds a degradation curve.
    """
    attacks = attacks or ATTACKS
    if strengths is not None:
        attacks = {"none": ATTACKS["none"], **attacks}
    test = drop_null_code(in_split(dataset, "test"))
    if n_samples is not None:
        # a top-n ends in one task; spread its rows before the costly part
        test = seeded_sample(test.select("id", "label", "code"), n_samples, "id", seed)
        test = test.repartition("id")
    columns = model.stages[0].getInputCols()
    features = with_features(attack_rows(test, attacks, seed))
    scored = with_probability(
        model.transform(align_features(features, columns, ["id", "label", "attack"]))
    )
    by = ["attack"]
    if strengths is not None:
        scored = with_strengths(scored.select("id", "label", "attack", "score"), strengths, seed)
        by.append("strength")
    return evaluate(scored, by).select(*by, "accuracy", "roc_auc")
