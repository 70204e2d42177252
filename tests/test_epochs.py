"""Training by epochs: all tasks take the steps that one process would, and the best epoch stays."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprint.operators import epochs as EP
from inkprint.sources import files

SIZE = 64


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = []
    for i in range(330):
        label = i % 2
        held = [rng.randrange(SIZE) for _ in range(rng.randrange(0, 9))] + [label] * rng.randrange(0, 3)
        data.append((str(i), label, held))
    return spark.createDataFrame(data, "id string, label int, buckets array<int>").cache()


@pytest.mark.parametrize("per_task", [10_000, 100])
def test_an_epoch_takes_the_steps_of_one_process(spark, rows, per_task, monkeypatch):
    monkeypatch.setattr(EP, "_ROWS_PER_TASK", per_task)
    weights = EP.bucket_weights(rows, SIZE)
    n_tasks = 330 // per_task + 1
    state = (*(np.zeros(SIZE + 1) for _ in range(3)), 0)
    expected = state
    for epoch in range(3):
        state = EP.train_epoch(rows, state, weights, epoch, 16, 0.05, 0.01, 42)
        # the same deal, order and batches, all in this process
        dealt = rows.repartition(n_tasks, F.xxhash64(F.lit(42), "id")).sortWithinPartitions(F.xxhash64(F.lit(42), F.lit(epoch), "id"), "id")
        parts = {}
        for r in dealt.select(F.spark_partition_id().alias("p"), "label", "buckets").collect():
            parts.setdefault(r.p, []).append((np.array(r.buckets, dtype=int), r.label))
        for begin in range(0, max(map(len, parts.values())), 16):
            some = [x for p in sorted(parts) for x in parts[p][begin : begin + 16]]
            dense = np.zeros((len(some), SIZE + 1))
            for x, (held, _) in zip(dense, some, strict=True):
                np.add.at(x, held, 1.0)
                x[:SIZE] *= weights
                x /= max(np.linalg.norm(x), 1e-300)
            dense[:, -1] = 1
            error = 1 / (1 + np.exp(-dense @ expected[0])) - np.array([t for _, t in some])
            expected = EP.step(expected, dense.T @ error / len(some), 0.05, 0.01)
        assert state[3] == expected[3] == -(-max(map(len, parts.values())) // 16) * (epoch + 1)
        assert state[0] == pytest.approx(expected[0], abs=1e-9)
    assert len(parts) == n_tasks


@pytest.mark.parametrize("n", [330, 3_300])
def test_the_number_of_exchanges_does_not_grow_with_the_rows(spark, n, monkeypatch):
    monkeypatch.setattr(EP, "_ROWS_PER_TASK", 100)
    monkeypatch.setattr(EP, "_EXCHANGES", 6)
    data = [(str(i), i % 2, [i % 2, 2 + i % 7]) for i in range(n)]
    many = spark.createDataFrame(data, "id string, label int, buckets array<int>")
    start = (*(np.zeros(SIZE + 1) for _ in range(3)), 0)
    w, _, _, steps = EP.train_epoch(many, start, np.ones(SIZE), 0, 16, 0.05, 0.01, 42)
    assert 5 <= steps <= 8 and w[1] > 0.1 > -0.1 > w[0]


def test_the_steps_of_larger_mini_batches_use_every_row(spark, rows, monkeypatch):
    monkeypatch.setattr(EP, "_ROWS_PER_TASK", 100)
    monkeypatch.setattr(EP, "_EXCHANGES", 1)
    weights, start = EP.bucket_weights(rows, SIZE), (*(np.zeros(SIZE + 1) for _ in range(3)), 0)
    # the longest task decides; one exchange holds six mini-batches of 16 rows of each task
    dealt = rows.repartition(4, F.xxhash64(F.lit(42), "id")).sortWithinPartitions(F.xxhash64(F.lit(42), F.lit(0), "id"), "id")
    parts = {}
    for r in dealt.select(F.spark_partition_id().alias("p"), "label", "buckets").collect():
        parts.setdefault(r.p, []).append((np.array(r.buckets, dtype=int), r.label))
    expected = start
    for begin in range(0, max(map(len, parts.values())), 96):
        some = [x for p in sorted(parts) for x in parts[p][begin : begin + 96]]
        where, sums = EP.gradient([b for b, _ in some], np.array([t for _, t in some]), weights, expected[0])
        mean = np.zeros(SIZE + 1)
        mean[where] = sums / len(some)
        expected = EP.step(expected, mean, 0.05, 0.01)
    found = EP.train_epoch(rows, start, weights, 0, 16, 0.05, 0.01, 42)
    assert found[3] == expected[3] and found[0] == pytest.approx(expected[0], abs=1e-9)


def test_no_epoch_follows_a_perfect_one(dataset):
    model, _ = EP.train_lexical(dataset, ngram=1, n_features=1024, batch=4)
    assert model.history[-1] == 1.0 and max(model.history[:-1], default=0.0) < 1.0


def test_weights_of_buckets(rows):
    held = [set(r.buckets) for r in rows.collect()]
    weights = EP.bucket_weights(rows, SIZE)
    assert [weights[b] for b in range(5)] == pytest.approx([np.log(331 / (sum(b in h for h in held) + 1)) + 1 for b in range(5)])


@pytest.fixture(scope="module")
def dataset(spark):
    code = [f"def f{i}(x):\n    return x {'+' if i % 2 else '-'} {i}\n" for i in range(120)]
    data = [(str(i), i % 2, ("train", "val", "test")[min(i // 40, 2)], None if i == 5 else c) for i, c in enumerate(code)]
    return spark.createDataFrame(data, "id string, label int, split string, code string").cache()


def test_the_best_epoch_stays_and_training_ends_two_later(dataset, monkeypatch):
    scores, asked = [0.5, 0.6, 0.9, 0.9, 0.7, 1.0, 1.0], []
    states, real = [], EP.train_epoch

    def epoch(*args):
        states.append(real(*args))
        return states[-1]

    def f1(scored, by):
        if by:
            return asked
        return type("Row", (), {"first": staticmethod(lambda: {"f1": scores[len(states) - 1]})})

    monkeypatch.setattr(EP, "train_epoch", epoch)
    monkeypatch.setattr(EP, "evaluate", f1)
    model, metrics = EP.train_lexical(dataset, epochs=7)
    assert len(states) == 5 and model.history == scores[:5] and metrics is asked
    assert np.array_equal(model.state, states[2][0]) and not np.array_equal(model.state, states[4][0])


def test_a_model_survives_storage(spark, dataset, tmp_path):
    model, metrics = EP.train_lexical(dataset, ngram=1, n_features=1024, batch=4)
    assert {r.split: r.f1 for r in metrics.collect()} == {"val": 1.0, "test": 1.0}
    files.save_model(model, str(tmp_path / "m"))
    again = EP.LexicalModel.load(str(tmp_path / "m"))
    before, after = ([r.probability[1] for r in m.transform(dataset.na.drop()).orderBy("id").collect()] for m in (model, again))
    assert before == after and len(set(before)) > 2
    assert EP.with_buckets(dataset.where("id = '5'")).first().buckets in (None, [])
