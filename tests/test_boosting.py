"""Second-order boosting against a plain version, and what it promises of rows, columns and missing values."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from inkprint.operators import boosting as B
from inkprint.operators import detectors as D
from inkprint.sources import files

NAMES = ["a", "b", "c"]
SCHEMA = "id string, label int, a double, b double, c double"


def table_of(spark, x, y):
    rows = [(str(i), None if t is None else int(t), *(float(v) for v in r)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, size=(600, 3)).astype(float)
    x[rng.random(600) < 0.2, 1] = np.nan
    y = ((x[:, 0] > 6) ^ (np.nan_to_num(x[:, 1], nan=20) > 7)).astype(int)
    flips = rng.random(600) < 0.1
    return x, np.where(flips, 1 - y, y)


def margins(model, df):
    rows = D.with_probability(model.transform(df)).select("id", "score").collect()
    return {int(r.id): np.log(r.score / (1 - r.score)) for r in rows}


def grow(x, g, h, rows, depth, l2, least):
    """A plain tree: the first best (column, cut, side of missing values) of each node; a function of rows."""
    def score(i):
        return g[i].sum() ** 2 / (h[i].sum() + l2)

    best = (1e-6, None)
    if depth:
        for missing_left in (False, True):
            for f in range(x.shape[1]):
                values = np.unique(x[~np.isnan(x[:, f]), f])
                for cut in (values[:-1] + values[1:]) / 2:
                    side = np.where(np.isnan(x[rows, f]), missing_left, x[rows, f] <= cut)
                    left, right = rows[side], rows[~side]
                    if min(h[left].sum(), h[right].sum()) >= least:
                        gain = score(left) + score(right) - score(rows)
                        if gain > best[0] + 1e-7:
                            best = (gain, (f, cut, missing_left, left, right))
    if best[1] is None:
        value = -g[rows].sum() / (h[rows].sum() + l2)
        return lambda r: np.full(len(r), value)
    f, cut, missing_left, left, right = best[1]
    below = [grow(x, g, h, part, depth - 1, l2, least) for part in (left, right)]

    def leaf(r):
        side = np.where(np.isnan(r[:, f]), missing_left, r[:, f] <= cut)
        return np.where(side, below[0](r), below[1](r))

    return leaf


@pytest.mark.parametrize(("depth", "l2", "least"), [(1, 0.0, 1.0), (3, 1.0, 1.0), (5, 2.0, 12.0)])
def test_margins_equal_a_plain_version(spark, planted, depth, l2, least):
    x, y = planted
    share = (y.sum() + 0.5) / (len(y) + 1)
    expected = np.full(len(y), np.log(share / (1 - share)))
    for _ in range(6):
        p = 1 / (1 + np.exp(-expected))
        expected = expected + 0.3 * grow(x, p - y, p * (1 - p), np.arange(len(y)), depth, l2, least)(x)
    estimator = B.NewtonTrees(rounds=6, depth=depth, rate=0.3, rows=1.0, columns=1.0, l2=l2, leastCover=least)
    df = table_of(spark, x, y).repartition(3)
    found = margins(D.fit_pipeline(estimator, NAMES, df), df)
    assert [found[i] for i in range(len(y))] == pytest.approx(list(expected), abs=1e-6)


def test_a_fit_does_not_depend_on_how_rows_are_dealt(spark, planted, monkeypatch, tmp_path):
    x, y = planted
    df = table_of(spark, x, y)
    estimator = D.boosted_trees(30, 4, rate=0.2)
    model = D.fit_pipeline(estimator, NAMES, df.coalesce(1))
    monkeypatch.setattr(B, "ROWS_PER_BLOCK", 64)
    monkeypatch.setattr(B, "_TREES_PER_STATE", 4)
    again = D.fit_pipeline(estimator, NAMES, df.repartition(7, "a"))
    assert again.stages[-1].nodes.equals(model.stages[-1].nodes)
    files.save_model(model, str(tmp_path / "m"))
    assert margins(files.load_model(str(tmp_path / "m")), df) == margins(model, df)


def test_shares_of_rows_and_columns_are_drawn(spark, planted):
    x, y = planted
    df = table_of(spark, x, y)
    nodes = D.fit_pipeline(D.boosted_trees(40, 2, rows=0.5, columns=0.67), NAMES, df).stages[-1].nodes
    roots = nodes[nodes["node"] == 0]
    # a root's curvature is a quarter of its rows at first: half of 600 rows of them were drawn
    assert 50 < roots["n"].iloc[0] < 100 and roots["n"].nunique() > 30
    used = nodes[nodes["left"] >= 0].groupby("tree")["feature"].nunique()
    assert used.max() <= 2


def test_odd_inputs(spark):
    one_class = table_of(spark, [[1.0, 2.0, 3.0]] * 5, [1] * 5)
    model = D.fit_pipeline(D.boosted_trees(3, 3), NAMES, one_class)
    assert all(v > 0 for v in margins(model, one_class).values())
    assert not np.any(model.stages[-1].featureImportances)
    unlabelled = table_of(spark, [[0.0, 0.0, np.nan], [9.0, 9.0, 9.0], [5.0, 5.0, 5.0]], [0, 1, None])
    assert D.fit_pipeline(D.boosted_trees(2, 2), NAMES, unlabelled).stages[-1].getOrDefault("base") == 0.0
    with pytest.raises(ValueError):
        D.fit_pipeline(D.boosted_trees(2, 2), NAMES, unlabelled.where(F.lit(False)))


def test_importances_are_average_gains(spark, planted):
    x, y = planted
    model = D.fit_pipeline(D.boosted_trees(20, 3), NAMES, table_of(spark, x, y))
    found = {r.feature: r.importance for r in D.importances(model, spark).collect()}
    assert sum(found.values()) == pytest.approx(1) and found["c"] < min(found["a"], found["b"])


def test_rows_that_repeat_are_one_pattern(spark, planted, monkeypatch):
    """More rows than a task grows, of few different ones: the trees are those of level by level, without a job for each."""
    x, y = planted
    x, y = np.repeat(x[:40], 12, axis=0), np.repeat(y[:40], 12)
    df = table_of(spark, x, y)
    estimator = D.boosted_trees(12, 4, rate=0.2, rows=0.7)
    expected = D.fit_pipeline(estimator, NAMES, df.coalesce(1)).stages[-1].nodes
    monkeypatch.setattr(B, "ROWS_PER_BLOCK", 64)
    jobs = []
    monkeypatch.setattr(B, "_merged", lambda *a: jobs.append(a))
    found = D.fit_pipeline(estimator, NAMES, df.repartition(5, "id")).stages[-1].nodes
    assert found.equals(expected) and not jobs


def test_rows_between_the_same_thresholds_are_alike():
    x = np.array([[1.0, 5.0], [1.4, 5.0], [1.5, 9.0], [np.nan, 5.0], [2.0, 5.0], [np.nan, 7.0]])
    first, which = B.alike(x, np.array([0, 0]), np.array([1.5, 1.9]))
    assert which[0] == which[1] == which[2] and which[3] == which[5] and len(first) == 3


def test_quantiles_of_many_rows_are_sketched_a_few_columns_at_a_time(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(300, 5))
    rows = [(str(i), i % 2, list(map(float, r))) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id string, label int, x array<double>").withColumn("features", array_to_vector("x"))
    _, whole, *_ = B.binned_rows(df, "label", "features")
    asked, agg = [], type(df).agg
    monkeypatch.setattr(type(df), "agg", lambda self, *columns: asked.append(len(columns)) or agg(self, *columns))
    monkeypatch.setattr(B, "SKETCH_ROWS", 100)
    monkeypatch.setattr(B, "SKETCH_COLUMNS", 2)
    _, parts, *_ = B.binned_rows(df, "label", "features")
    assert asked == [3, 2, 2, 1] and len(parts) == 5
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
