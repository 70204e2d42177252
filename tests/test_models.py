"""Detectors on planted signals, attributions against brute force, and the jobs around them."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import functions as F

from inkprint.functions.attacks import ATTACKS
from inkprint.operators import corpus as C
from inkprint.operators import detectors as D
from inkprint.operators import ensemble as E
from inkprint.operators import explain as X
from inkprint.operators import features as FE
from inkprint.operators import robustness as RB
from inkprint.operators import score as S
from inkprint.operators import transfer as TR
from inkprint.operators.metrics import roc_auc
from inkprint.operators.ranking import stratified_split
from inkprint.plans import queries as Q
from inkprint.plans import views as V
from inkprint.sources import files

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rings(spark):
    """Label by distance from the origin: no linear model separates it."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 4))
    y = (np.hypot(x[:, 0], x[:, 1]) > 1.2).astype(int)
    rows = [(str(i), int(t), "m1" if i % 2 else "m2", *map(float, r)) for i, (t, r) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "id string, label int, source_model string, a double, b double, c double, d double")
    df = df.withColumn("source_model", F.when(F.col("label") == 0, "human").otherwise(F.col("source_model")))
    return stratified_split(df.repartition(8, "id")).cache()


@pytest.fixture(scope="module")
def trees(rings):
    stages = [D.assembler(COLUMNS), D.boosted_trees(6, 4, rate=0.3)]
    return Pipeline(stages=stages).fit(C.in_split(rings, "train"))


def test_baselines_find_the_rings(rings):
    models, metrics = D.train_baselines(
        rings,
        COLUMNS,
        {"boosted_trees": D.boosted_trees(8, 4, rate=0.3), "random_forest": D.forest(10)},
        {"folds": 2},
    )
    rows = {(r.model, r.split): r for r in metrics.collect()}
    assert set(rows) == {(m, s) for m in models for s in ("val", "test")}
    for r in rows.values():
        assert r.roc_auc > 0.85, r
        (tn, fp), (fn, tp) = r.confusion_matrix
        assert (tn + tp) / (tn + fp + fn + tp) == pytest.approx(r.accuracy)
    top = [r.feature for r in D.top_importances(models["boosted_trees"], rings.sparkSession, 2).collect()]
    assert set(top) == {"a", "b"}


def test_models_survive_storage(rings, trees, tmp_path):
    kernel = D.fit_kernel_machine(C.in_split(rings, "train"), COLUMNS, folds=2)
    for model in (trees, kernel):
        files.save_model(model, str(tmp_path / "m"))
        again = files.load_model(str(tmp_path / "m"))
        before, after = (
            {r.id: r.score for r in D.with_probability(m.transform(rings)).select("id", "score").collect()}
            for m in (model, again)
        )
        assert before == pytest.approx(after)


# --- attributions -------------------------------------------------------------------


def leaves_of(model, spark):
    """(value, features, low, high, cover) of every leaf: the bounds its path sets, and the share of rows within them."""
    nodes = {(r.tree, r.node): r for r in X.tree_nodes(model, spark).collect()}
    found, stack = [], [(nodes[key], {}) for key in nodes if key[1] == 0]
    while stack:
        node, path = stack.pop()
        if node.left < 0:
            found.append((node.value, tuple(path), *(zip(*path.values(), strict=True) if path else [(), (), ()])))
            continue
        low, high, cover = path.get(node.feature, (-np.inf, np.inf, 1.0))
        for child, bounds in ((node.left, (low, node.threshold)), (node.right, (node.threshold, high))):
            below = nodes[node.tree, child]
            stack.append((below, {**path, node.feature: (*bounds, cover * below.n / node.n)}))
    return found


def conditional_value(leaves, row, known):
    """Expected log-odds when only the known features are looked at."""
    total = 0.0
    for value, features, low, high, cover in leaves:
        weight = value
        for f, lo, hi, c in zip(features, low, high, cover):
            weight *= float(lo < row[f] <= hi) if f in known else c
        total += weight
    return total


def brute_shapley(leaves, row, n):
    out = np.zeros(n)
    for j in range(n):
        others = [f for f in range(n) if f != j]
        for size in range(n):
            weight = factorial(size) * factorial(n - size - 1) / factorial(n)
            for known in combinations(others, size):
                gain = conditional_value(leaves, row, {*known, j}) - conditional_value(leaves, row, set(known))
                out[j] += weight * gain
    return out


def test_attributions_equal_brute_force_and_add_up(rings, trees):
    scored = X.with_attributions(D.with_probability(trees.transform(C.in_split(rings, "test"))), trees)
    rows = scored.select("score", "shap", "base_value", *COLUMNS).collect()
    leaves = leaves_of(trees, rings.sparkSession)
    for r in rows[:10]:
        expected = brute_shapley(leaves, [r[c] for c in COLUMNS], 4)
        assert r.shap == pytest.approx(expected, abs=1e-9)
    for r in rows:
        log_odds = np.log(r.score / (1 - r.score))
        assert sum(r.shap) + r.base_value == pytest.approx(log_odds, abs=1e-6)


@pytest.mark.parametrize("nodes", [50, 500_000])
def test_forest_attributions_add_up_to_the_probability(rings, monkeypatch, nodes):
    # beyond the bound, groups of trees meet parts of the rows
    monkeypatch.setattr(X, "MAX_NODES", nodes)
    monkeypatch.setattr(X, "ROWS_PER_PART", 300)
    forest = RandomForestClassifier(featuresCol=D.VECTOR, numTrees=8, maxDepth=5, seed=42)
    model = D.fit_pipeline(forest, COLUMNS, C.in_split(rings, "train"))
    scored = X.with_attributions(D.with_probability(model.transform(rings)), model)
    rows = scored.select("score", "shap", "base_value", "unit", *COLUMNS).collect()
    leaves = leaves_of(model, rings.sparkSession)
    assert {r.unit for r in rows} == {X.PROBABILITY}
    assert [sum(r.shap) + r.base_value for r in rows] == pytest.approx([r.score for r in rows], abs=1e-9)
    for r in rows[:5]:
        assert r.shap == pytest.approx(brute_shapley(leaves, [r[c] for c in COLUMNS], 4), abs=1e-9)


def test_linear_attributions_add_up_to_the_log_odds(rings):
    model = D.fit_pipeline(LogisticRegression(featuresCol=D.VECTOR, regParam=0.01), COLUMNS, C.in_split(rings, "train"))
    for r in X.with_attributions(D.with_probability(model.transform(rings)), model).limit(50).collect():
        assert r.unit == X.LOG_ODDS
        assert sum(r.shap) + r.base_value == pytest.approx(np.log(r.score / (1 - r.score)), abs=1e-6)


def test_a_kernel_machine_gives_no_reasons(rings):
    model = D.fit_kernel_machine(C.in_split(rings, "train"), COLUMNS, folds=2)
    row = X.with_attributions(D.with_probability(model.transform(rings)), model).first()
    assert row.shap is None and row.unit is None and 0 <= row.score <= 1


def chain(depth, rng):
    """A tree that splits off one leaf at each of ``depth`` levels, features taken in turn."""
    left, right, feature, threshold, value, n = [], [], [], [], [], []
    rest = 2.0 * depth + 1
    for d in range(depth):
        left += [2 * d + 1, -1]
        right += [2 * d + 2, -1]
        feature += [d % 7, 0]
        threshold += [float(rng.normal()), 0.0]
        value += [0.0, float(rng.normal())]
        n += [rest, 2.0]
        rest -= 2
    parts = [*zip(left, right, feature, threshold, value, n, strict=True), (-1, -1, 0, 0.0, 1.5, rest)]
    left, right, feature, threshold, value, n = map(np.array, zip(*parts, strict=True))
    return left, right, feature, threshold, np.arange(len(left)) % 3 == 0, value, n


@pytest.mark.parametrize("depth", [1, 2, 9, 60, 1500])
def test_deep_trees_are_walked_exactly(depth):
    rng = np.random.default_rng(depth)
    tree = chain(depth, rng)
    left, right, feature, threshold, missing_left, value, n = tree
    x = rng.normal(size=(6, 8))
    x[5, 2] = np.nan
    shares = X.tree_shares(x, tree)
    assert not shares[:, 7].any()

    def goes_left(row, node):
        v = row[feature[node]]
        return bool(missing_left[node]) if np.isnan(v) else v <= threshold[node]

    def expected(row, known):
        total, weight, node = 0.0, 1.0, 0
        while left[node] >= 0:  # each left child is a leaf
            portion = float(goes_left(row, node)) if feature[node] in known else n[left[node]] / n[node]
            total += weight * portion * value[left[node]]
            weight, node = weight * (1 - portion), right[node]
        return total + weight * value[node]

    for row, share in zip(x, shares, strict=True):
        assert share.sum() == pytest.approx(expected(row, range(8)) - expected(row, ()), abs=1e-9)
        for j in range(7 if depth < 1000 else 1):
            others = [f for f in range(7) if f != j]
            brute = sum(
                factorial(size) * factorial(6 - size) / factorial(7) * (expected(row, {*known, j}) - expected(row, {*known}))
                for size in range(7)
                for known in combinations(others, size)
            )
            assert share[j] == pytest.approx(brute, abs=1e-9)


def test_global_importance_ranks_the_signal(rings, trees):
    scored = X.with_attributions(trees.transform(rings), trees)
    top = X.global_importance(scored, COLUMNS).limit(2).collect()
    assert {r.feature for r in top} == {"a", "b"}


def test_top_contributions_break_ties_in_feature_order(spark):
    df = spark.createDataFrame([([0.5, -0.5, 0.1, -2.0],)], "shap array<double>")
    top = df.select(X.top_contributions(F.col("shap"), COLUMNS, 3).alias("t")).first().t
    assert [(r.feature, r.direction) for r in top] == [
        ("d", "toward human-written"),
        ("a", "toward AI-generated"),
        ("b", "toward human-written"),
    ]


# --- evaluations --------------------------------------------------------------------


def test_transfer_matrix(spark, rings):
    rare = spark.createDataFrame(
        [(f"r{i}", 1, "rare", 9.0, 9.0, 0.0, 0.0, "train" if i < 5 else "test") for i in range(8)],
        "id string, label int, source_model string, a double, b double, c double, d double, split string",
    )
    df = rings.unionByName(rare).cache()
    estimator = D.boosted_trees(5, 3, rate=0.3, rows=1.0, columns=1.0)
    cells = TR.transfer_auc(df, COLUMNS, estimator)
    found = {(r.train_model, r.test_model): r.roc_auc for r in cells.collect()}
    names = ["m1", "m2", "rare"]
    assert set(found) == {(a, b) for a in names for b in names}
    assert all((v is None) == ("rare" in pair) for pair, v in found.items())
    assert min(v for v in found.values() if v is not None) > 0.8

    model = Pipeline(stages=[D.assembler(COLUMNS), estimator]).fit(
        TR.rows_for_model(C.in_split(df, "train"), "m1")
    )
    test = TR.rows_for_model(C.in_split(df, "test"), "m2")
    alone = roc_auc(D.with_probability(model.transform(test))).first().roc_auc
    assert found["m1", "m2"] == pytest.approx(alone)

    square = files.transfer_matrix(cells, names)
    assert square.columns == ["train_model", *names]
    assert [r.train_model for r in square.collect()] == names


def test_ensemble_weights_the_useful_score(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 800)
    rows = [(str(i), int(t), float(np.clip(rng.normal(0.3 + 0.4 * t, 0.2), 0, 1))) for i, t in enumerate(y)]
    df = stratified_split(spark.createDataFrame(rows, "id string, label int, score double")).cache()
    noise = df.select("id", F.rand(1).alias("score"))
    merged = E.merge_scores(df, df.select("id", "score"), noise, noise).cache()
    model, metrics = E.train_ensemble(merged)
    weights = {r.input: r.weight for r in E.learned_weights(model, df).collect()}
    assert weights["baseline_prob"] > 3 * abs(weights["lexical_prob"])
    assert metrics.first().roc_auc > 0.85

    # the optimum of sum(w * loss) + |b|^2 / 2 has a zero gradient
    train = E.with_balanced_weights(C.in_split(merged, "train")).collect()
    x = np.array([[r[c] for c in E.STACKED] for r in train])
    t, w = (np.array([r[c] for r in train]) for c in ("label", "weight"))
    b = np.array([weights[c] for c in E.STACKED])
    p = 1 / (1 + np.exp(-(x @ b + weights["intercept"])))
    assert np.abs(x.T @ (w * (p - t)) + b).max() < 0.05


@pytest.fixture(scope="module")
def code_model(spark, sf):
    return Q._code_model(spark, sf)


def test_robustness_rows(spark, sf, code_model):
    dataset = V.code_dataset(spark, sf)
    some = {r.attack: r for r in RB.robustness(code_model, dataset, 20).collect()}
    whole = {r.attack: r for r in RB.robustness(code_model, dataset, None).collect()}
    assert set(some) == set(whole) == set(ATTACKS)
    scored = S.score_snippets(C.in_split(dataset, "test"), code_model)
    right = scored.join(dataset.select("id", "label"), "id").where("prediction = label").count()
    total = C.in_split(dataset, "test").count()
    assert whole["none"].accuracy == pytest.approx(right / total)


def test_degradation_curve(spark, sf, code_model):
    dataset = V.code_dataset(spark, sf)
    plain = {r.attack: r for r in RB.robustness(code_model, dataset, 25).collect()}
    curve = RB.robustness(code_model, dataset, 25, strengths=[0.0, 0.5, 1.0]).collect()
    assert len(curve) == 3 * len(ATTACKS)
    for r in curve:
        expected = {0.0: plain["none"], 1.0: plain[r.attack]}.get(r.strength)
        if expected is not None:
            assert r.accuracy == pytest.approx(expected.accuracy)
            assert r.roc_auc == pytest.approx(expected.roc_auc)


def test_custom_attack_and_extractor(spark, programs):
    rows = RB.attack_rows(
        programs.withColumn("label", F.lit(1)), {"upper": lambda code, id_col, seed: F.upper(code)}
    )
    assert {r.attack for r in rows.collect()} == {"upper"}
    extractors = {"size": lambda df: df.withColumn("size", F.length("code").cast("double"))}
    assert FE.with_features(programs, extractors).columns[-1] == "size"


def test_every_baseline_scores_snippets(spark, sf):
    features = Q._code_features(spark, sf)
    estimators = {"boosted_trees": D.boosted_trees(3, 3), "random_forest": D.forest(4)}
    models, _ = D.train_baselines(features, FE.FEATURES, estimators, {"folds": 2})
    snippets = V.code_corpus(spark, sf).select("id", "code").limit(20)
    for name, unit in (("boosted_trees", X.LOG_ODDS), ("random_forest", X.PROBABILITY), ("kernel_machine", None)):
        rows = S.score_snippets(snippets, models[name]).collect()
        assert len(rows) == 20 and {r.unit for r in rows} == {unit}
        assert all((r.reasons is None) == (unit is None) for r in rows)


def test_scoring_output(spark, sf, code_model):
    snippets = V.code_corpus(spark, sf).select("id", "code")
    blank = spark.createDataFrame([("blank", " \n")], "id string, code string")
    rows = S.score_snippets(snippets.unionByName(blank), code_model).collect()
    assert len(rows) == snippets.count()
    for r in rows:
        assert r.prediction == int(r.score > 0.5)
        assert r.confidence == f"{100 * r.score:.1f}%"
        impacts = [abs(x.impact) for x in r.reasons]
        assert len(impacts) == 6 and impacts == sorted(impacts, reverse=True)


def test_streamed_scores_equal_batch_scores(spark, sf, code_model, tmp_path):
    from inkprint.streaming.scoring import score_stream

    source = str(tmp_path / "in")
    snippets = V.code_corpus(spark, sf).select("id", "code").limit(40)
    snippets.write.json(source)
    stream = spark.readStream.schema("id string, code string").json(source)
    out = str(tmp_path / "out")
    score_stream(stream, code_model, out, str(tmp_path / "state")).awaitTermination()
    batch = S.score_snippets(spark.read.schema("id string, code string").json(source), code_model)
    streamed = {r.id: r.score for r in spark.read.parquet(out).collect()}
    assert streamed == pytest.approx({r.id: r.score for r in batch.collect()})


def test_lexical_classifier_learns_tokens(spark):
    rows = [(str(i), i % 2, f"def f{i}(x):\n    return x {'+' if i % 2 else '-'} {i}\n") for i in range(300)]
    df = stratified_split(spark.createDataFrame(rows, "id string, label int, code string"))
    model, metrics = D.train_lexical(df, ngram=1)
    assert {r.split for r in metrics.collect()} == {"val", "test"}
    assert all(r.roc_auc > 0.95 for r in metrics.collect())
    assert D.score_lexical(model, df).count() == 300


def test_the_query_fits_every_baseline(spark, sf, monkeypatch):
    asked = []

    def fit(train, columns, **options):
        asked.append(options)
        return D.fit_pipeline(LogisticRegression(featuresCol=D.VECTOR, maxIter=1), columns, train)

    # the kernel machine is asked for at its defaults; the stand-ins only keep the test short
    monkeypatch.setattr(D, "fit_kernel_machine", fit)
    monkeypatch.setattr(D, "forest", lambda trees: LogisticRegression(featuresCol=D.VECTOR, maxIter=1))
    rows = Q.train_baselines(spark, sf).collect()
    models = ("boosted_trees", "random_forest", "kernel_machine")
    assert asked == [{}] and sorted((r.model, r.split) for r in rows) == sorted((m, s) for m in models for s in ("val", "test"))
