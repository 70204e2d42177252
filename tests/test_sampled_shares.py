"""Shares for models without trees: enumeration where it is possible, and sums everywhere."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprint.operators import detectors as D
from inkprint.operators import explain as X
from inkprint.operators import score as S

NAMES = list("abcdefgh")


@pytest.fixture(scope="module")
def machine(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(150, 8))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(int)
    rows = [(f"r{i:03d}", int(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id string, label int, " + ", ".join(f"{n} double" for n in NAMES)).cache()
    return df, D.fit_kernel_machine(df, NAMES, folds=3)


def probabilities(spark, model, rows):
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{n} double" for n in NAMES))
    scored = D.with_probability(model.transform(df)).select("id", "score").collect()
    return np.array([p for _, p in sorted(map(tuple, scored))])


def test_shares_equal_enumeration_at_eight_features(spark, machine):
    df, model = machine
    background = df.orderBy("id").limit(5)
    explained = X.sampled_attributions(df.where("id IN ('r100', 'r120')"), model, background).collect()
    fill = np.array([[r[n] for n in NAMES] for r in background.collect()])
    for r in explained:
        own = np.array([r[n] for n in NAMES])
        sets = [frozenset(s) for k in range(9) for s in combinations(range(8), k)]
        mixed = [np.where([j in s for j in range(8)], own, f) for s in sets for f in fill]
        worth = dict(zip(sets, probabilities(spark, model, mixed).reshape(len(sets), -1).mean(axis=1), strict=True))
        for j in range(8):
            weight = {k: factorial(k) * factorial(7 - k) / factorial(8) for k in range(8)}
            expected = sum(weight[len(s)] * (worth[s | {j}] - worth[s]) for s in sets if j not in s)
            assert r.shap[j] == pytest.approx(expected, abs=1e-8)
        assert r.base_value == pytest.approx(worth[frozenset()]) and r.unit == X.PROBABILITY


def test_drawn_sets_add_up_and_are_close(machine):
    df, model = machine
    few = df.where("id < 'r006'")
    background = df.orderBy("id").limit(4)
    exact = {r.id: r.shap for r in X.sampled_attributions(few, model, background).collect()}
    drawn = X.sampled_attributions(D.with_probability(model.transform(few)).select("id", "score", *NAMES), model, background, n_coalitions=120).collect()
    assert len(drawn) == 6
    for r in drawn:
        assert sum(r.shap) + r.base_value == pytest.approx(r.score, abs=1e-9)
        assert np.abs(np.array(r.shap) - exact[r.id]).max() < 0.1


def test_sets_of_features():
    masks, weights = X.coalitions(4)
    assert len(masks) == 14 and weights[masks.sum(axis=1) == 1] == pytest.approx([1 / 12] * 4)
    masks, _ = X.coalitions(136, 64)
    assert masks.shape == (64, 136) and (masks[:32] == ~masks[32:]).all() and np.array_equal(masks, X.coalitions(136, 64)[0])
    assert X._least_squares(*X.coalitions(1)).tolist() == [[1.0]]


def test_a_kernel_machine_gives_reasons_against_a_background(spark, sf):
    from inkprint.operators import features as FE
    from inkprint.plans import queries as Q
    from inkprint.plans import views as V

    features = Q._planted_features(spark, sf)
    model = D.fit_kernel_machine(features.where("split = 'train'"), FE.FEATURES, folds=2)
    snippets = V.code_corpus(spark, sf).select("id", "code").limit(3)
    rows = S.score_snippets(snippets, model, background=features.limit(2)).collect()
    assert len(rows) == 3 and {r.unit for r in rows} == {X.PROBABILITY} and all(len(r.reasons) == 6 for r in rows)
    assert S.score_snippets(snippets, model).where(F.col("reasons").isNotNull()).count() == 0
