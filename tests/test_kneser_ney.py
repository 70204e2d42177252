"""N-gram probabilities against a plain version; they sum to one in any context."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from inkprint.operators import kneser_ney as KN
from inkprint.operators import likelihood as L


class Plain:
    def __init__(self, texts, order):
        self.order, self.tables = order, {}
        counts = Counter()
        for text in texts:
            t = [""] * (order - 1) + text.split()
            counts.update((tuple(t[i : i + order - 1]), t[i + order - 1]) for i in range(len(t) - order + 1))
        for n in range(order, 0, -1):
            of = Counter(counts.values())
            d = [0.5, 1.0, 1.5]
            if of[1] and of[2]:
                y = of[1] / (of[1] + 2 * of[2])
                d = [k - (k + 1) * y * of[k + 1] / of[k] if of[k] else 0.5 * k for k in (1, 2, 3)]
                d = [min(max(x, 0.1 * k), 0.9 * k) for k, x in zip((1, 2, 3), d, strict=True)]
            totals, left = Counter(), defaultdict(float)
            for (h, _), c in counts.items():
                totals[h] += c
                left[h] += d[min(c, 3) - 1]
            self.tables[n] = (dict(counts), d, totals, left)
            counts = Counter((h[1:], w) for h, w in counts)
        self.words = {w for _, w in self.tables[1][0]}

    def p(self, h, w, n=None):
        n = self.order if n is None else n
        if n == 0:
            return 1 / (len(self.words) + 1)
        counts, d, totals, left = self.tables[n]
        h = tuple(h)[len(h) - n + 1 :]
        shorter = self.p(h, w, n - 1)
        if h not in totals:
            return shorter
        c = counts.get((h, w), 0)
        return max(0.0, c - d[min(c, 3) - 1] if c else 0.0) / totals[h] + left[h] / totals[h] * shorter


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    phrases = [" ".join(f"w{min(rng.randrange(12), rng.randrange(12))}" for _ in range(4)) for _ in range(15)]
    return [" ".join(rng.choice(phrases) for _ in range(rng.randrange(1, 8))) for _ in range(60)] + ["", "alone", "\t", None]


@pytest.mark.parametrize(("order", "hot"), [(1, 100_000), (2, 5), (3, 100_000), (5, 3)])
def test_probabilities_equal_a_plain_version_and_sum_to_one(spark, texts, order, hot, monkeypatch):
    monkeypatch.setattr(KN, "HOT_PAIRS", hot)
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, code string")
    model = KN.fit_ngrams(df, order)
    plain = Plain([t or "" for t in texts], order)
    words = [*sorted(plain.words), "never-seen"]
    known = [h for h in plain.tables[order][2]][:6]
    strange = [("w1",) * (order - 1), ("never", "w2", "w3", "w4")[: order - 1], ("w0", "never", "w1", "w2")[: order - 1]]
    contexts = list(dict.fromkeys(tuple(h) for h in known + strange))
    rows = [(" ".join(h), w) for h in contexts for w in words]
    priced = KN.price_windows(spark.createDataFrame(rows, "h string, w string"), model).collect()
    found = {(r.h, r.w): r.p for r in priced}
    assert len(priced) == len(rows)
    for h in contexts:
        assert sum(found[" ".join(h), w] for w in words) == pytest.approx(1.0)
        assert [found[" ".join(h), w] for w in words] == pytest.approx([plain.p(h, w) for w in words])


def test_likelihood_of_texts(spark, texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, code string")
    train = df.where(F.col("id").cast("int") % 2 == 0)
    model = KN.fit_ngrams(train, 4)
    plain = Plain([t or "" for t in texts[::2]], 4)
    for r in KN.log_likelihood(df, model).collect():
        t = (texts[int(r.id)] or "").split()
        padded = [""] * 3 + t
        logs = [math.log(plain.p(padded[i : i + 3], padded[i + 3])) for i in range(1, len(t))]
        assert r.n_predicted == len(logs)
        assert r.ll == (pytest.approx(sum(logs) / len(logs)) if logs else None)


def test_longer_contexts_predict_better(spark, texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, code string")
    train, held_out = df.where("id % 2 = 0"), df.where("id % 2 = 1")

    def mean(scores):
        return scores.agg(F.sum(F.col("ll") * F.col("n_predicted")) / F.sum("n_predicted")).first()[0]

    bigrams = mean(L.log_likelihood(held_out, L.fit_bigrams(train)))
    assert mean(KN.log_likelihood(held_out, KN.fit_ngrams(train, 5))) > bigrams + 0.1


def test_nothing_to_fit(spark):
    empty = spark.createDataFrame([], "id string, code string")
    model = KN.fit_ngrams(empty, 3)
    row = KN.log_likelihood(spark.createDataFrame([("a", "x y z")], "id string, code string"), model).first()
    assert row.n_predicted == 2 and row.ll == pytest.approx(0.0)


def test_frequent_keys_are_found_without_sorting_a_table(spark, texts, monkeypatch):
    """Nor are tables written that hold a row for each scored window of full length."""
    stored, written = KN.stored, []
    monkeypatch.setattr(KN, "stored", lambda df, label, *a: written.append(label) or stored(df, label, *a))
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate([*texts, "w1 " * 2_000])], "id string, code string")
    model = KN.fit_ngrams(df, 3)
    assert len(written) == 6
    scored = KN.log_likelihood(df, model)
    plan = scored._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan
    assert sorted(written[6:]) == ["priced-1", "priced-2", "windows-1", "windows-2"]
    # one word's rows are most of all and are dealt by keys of their own
    plain = Plain([*(t or "" for t in texts), "w1 " * 2_000], 3)
    padded = ["", "", *["w1"] * 2_000]
    expected = sum(math.log(plain.p(padded[i : i + 2], "w1")) for i in range(1, 2_000)) / 1_999
    row = scored.where(f"id = '{len(texts)}'").first()
    assert (row.n_predicted, row.ll) == (1_999, pytest.approx(expected))


def test_hot_rows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(KN, "HOT_PAIRS", 2)
    rows = spark.range(4_000).selectExpr("id", "if(id % 100 = 0, 'rare', 'hot') AS w")
    table = spark.createDataFrame([("hot", 9), ("rare", 1)], "w string, c long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        met = KN._looked_up(rows, table, ["w"], ["c"], "c", 10)
        held = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
        assert max(held) < 1_500
        assert {(r.w, r.c) for r in met.collect()} == {("hot", 9), ("rare", 1)} and met.count() == 4_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
