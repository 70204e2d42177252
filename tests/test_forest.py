"""Forests: the same trees wherever they are grown, leaves of one class at any depth, shares that add up."""

import numpy as np
import pytest

from inkprint.operators import detectors as D
from inkprint.operators import explain as X
from inkprint.operators import forest as FO
from inkprint.sources import files


def table_of(spark, x, y):
    names = [f"c{i}" for i in range(x.shape[1])]
    rows = [(str(i), int(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id string, label int, " + ", ".join(f"{n} double" for n in names)), names


def nodes_of(model):
    table = model.stages[-1].nodes.toPandas()
    return table.sort_values(["tree", "node"], ignore_index=True)


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 9, size=(500, 5)).astype(float)
    x[rng.random((500, 5)) < 0.05] = np.nan
    y = (np.nan_to_num(x[:, 0], nan=9) + np.nan_to_num(x[:, 1], nan=9) > 9).astype(int)
    return table_of(spark, x, np.where(rng.random(500) < 0.1, 1 - y, y))


def test_trees_do_not_depend_on_where_they_are_grown(noisy, monkeypatch):
    df, names = noisy
    whole = nodes_of(D.fit_pipeline(FO.DeepForest(trees=7), names, df.coalesce(1)))
    monkeypatch.setattr(FO, "ROWS_PER_BLOCK", 90)
    monkeypatch.setattr(FO, "NODES_PER_JOB", 5)
    monkeypatch.setattr(FO, "PASS_ROWS", 1_600)
    dealt = nodes_of(D.fit_pipeline(FO.DeepForest(trees=7, localRows=40), names, df.repartition(4, "c1")))
    assert whole.equals(dealt)


def test_rows_of_large_leaves_do_not_meet(spark, monkeypatch):
    # one cut parts the classes: two leaves of some 600 rows each, which once met in one task, however many they were
    x = np.repeat([[0.0, 3.0], [1.0, 3.0]], 600, axis=0)
    df, names = table_of(spark, x, x[:, 0])
    pieces = []
    created = spark.createDataFrame

    def create(data, schema=None, **options):
        if "bins binary" in str(schema):
            pieces.append(data.count())
        return created(data, schema, **options)

    monkeypatch.setattr(type(spark), "createDataFrame", lambda _, *a, **b: create(*a, **b))
    few = D.fit_pipeline(FO.DeepForest(trees=3, localRows=100), names, df)
    assert pieces == [0]
    pieces.clear()
    whole = D.fit_pipeline(FO.DeepForest(trees=3), names, df)
    assert pieces[0] > 0 and nodes_of(few).equals(nodes_of(whole)) and len(nodes_of(few)) == 9


def test_nodes_part_their_rows(spark, noisy):
    df, names = noisy
    model = D.fit_pipeline(FO.DeepForest(trees=3), names, df)
    for _, tree in nodes_of(model).groupby("tree"):
        tree = tree.set_index("node")
        assert 350 < tree["n"][0] < 650  # a bootstrap sample
        for _, node in tree[tree["left"] >= 0].iterrows():
            below = [tree.loc[node["left"]], tree.loc[node["right"]]]
            assert sum(b["n"] for b in below) == node["n"] and min(b["n"] for b in below) > 0
            assert sum(b["n"] * b["value"] for b in below) == pytest.approx(node["n"] * node["value"])
    top = {r.feature for r in D.top_importances(model, spark, 2).collect()}
    assert top == {"c0", "c1"}


@pytest.mark.parametrize("local", [16_384, 8])
def test_a_chain_deeper_than_thirty_is_learnt(spark, local):
    # values alternate in class: a tree that sees them all has a cut between any two, and needs depth where one column parts single rows
    depth = 40
    x = np.zeros((depth + 1, depth))
    for i in range(depth + 1):
        x[i, :i] = 1.0  # column j is set for rows behind j
    y = np.arange(depth + 1) % 2
    rows = np.repeat(np.arange(depth + 1), 6)
    df, names = table_of(spark, x[rows], y[rows])
    model = D.fit_pipeline(FO.DeepForest(trees=25, localRows=local), names, df)
    scored = D.with_probability(model.transform(df)).select("label", "score").collect()
    assert all((r.score > 0.5) == (r.label == 1) for r in scored)


def test_subtrees_go_as_deep_as_rows_need():
    # one row more on the left at each level: only a chain of cuts parts the classes
    n = 120
    bins = np.arange(n, dtype=np.uint8)[:, None]
    nodes = FO.grow_subtree(bins, (np.arange(n) % 2).astype(float), np.ones(n, dtype=int), 1, 0, 1, 1)
    leaves = [r for r in nodes if r[4] < 0]
    assert len(leaves) == n and all(r[7] in (0.0, 1.0) for r in leaves)
    assert max(r[1].bit_length() - 1 for r in leaves) > 31


@pytest.mark.parametrize("bound", [500_000, 60])
def test_scores_and_shares_of_large_models(noisy, monkeypatch, tmp_path, bound):
    df, names = noisy
    model = D.fit_pipeline(FO.DeepForest(trees=6), names, df)
    expected = {r.id: r.score for r in D.with_probability(model.transform(df)).select("id", "score").collect()}
    files.save_model(model, str(tmp_path / "m"))
    monkeypatch.setattr(X, "MAX_NODES", bound)
    monkeypatch.setattr(X, "ROWS_PER_PART", 200)
    again = files.load_model(str(tmp_path / "m"))
    rows = X.with_attributions(D.with_probability(again.transform(df)), again).select("id", "score", "shap", "base_value", "unit").collect()
    assert {r.id: r.score for r in rows} == pytest.approx(expected)
    assert {r.unit for r in rows} == {X.PROBABILITY}
    assert [sum(r.shap) + r.base_value for r in rows] == pytest.approx([r.score for r in rows], abs=1e-9)


def test_one_class(spark):
    df, names = table_of(spark, np.ones((4, 2)), np.ones(4))
    model = D.fit_pipeline(FO.DeepForest(trees=3), names, df)
    # a sample may miss all four rows, and its tree then has no node
    assert all(0.6 < r.score <= 1 + 1e-12 for r in D.with_probability(model.transform(df)).collect())
    assert not np.any(model.stages[-1].featureImportances)
