"""Scores of perturbed texts without the texts: the same as those of the texts that ``perturbations`` builds."""

import random

from pyspark.sql import functions as F

from inkprint.operators import likelihood as L


def corpus(spark):
    rng = random.Random(8)
    words = ["a", "bb", "c\nd", "e", "f", "", "g\t", "h"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 14))) for _ in range(60)]
    texts += [None, "", "   ", "a a a a a a", "one", "a   b  c", " a b c d e"]
    rows = [(str(i), t) for i, t in enumerate(texts)]
    # ids that repeat, and none at all
    rows += [("3", "a bb e f h a bb"), ("3", "f f e"), (None, "a bb e f h"), (None, "e f")]
    return spark.createDataFrame(rows, "id string, code string")


def key(r):
    return r.id, r.round


def test_scores_are_those_of_the_perturbed_texts(spark):
    df = corpus(spark)
    model = L.fit_bigrams(df.where("id < '4'"))
    built = L.perturbations(df).unionByName(df.select("id", F.lit(0).alias("round"), "code"))
    expected = {key(r): r for r in L.log_likelihood(built, model, ("id", "round")).collect()}
    found = {key(r): r for r in L.perturbed_likelihood(df, model).collect()}
    assert found.keys() == expected.keys() and len(found) > 11 * 60
    for k, r in found.items():
        assert r.n_predicted == expected[k].n_predicted
        assert (r.ll is None) == (expected[k].ll is None)
        assert r.ll is None or abs(r.ll - expected[k].ll) < 1e-9


def test_a_perturbed_text_is_scored_by_its_changes(spark):
    """A swap changes six pairs at most, so rows do not grow with the length of a text times its rounds."""
    rng = random.Random(9)
    text = " ".join(f"w{rng.randint(0, 999)}" for _ in range(3_000))
    df = spark.createDataFrame([("1", text)], "id string, code string")
    rows = L._term_rows(df, L.fit_bigrams(df), ("id",), "code", 10, 5, 42, None, 1)
    assert rows.where("_round > 0 AND k1 IS NOT NULL").count() <= 10 * 5 * 6
