"""Definitions checked against plain Python on generated inputs, and invariances."""

import math
import random
import re
from collections import Counter
from statistics import fmean, median, pstdev

import pytest
from pyspark.sql import functions as F

from inkprint.functions import pysyntax, text
from inkprint.functions.attacks import reformat_whitespace, strip_comments
from inkprint.operators import corpus as C
from inkprint.operators import likelihood as L
from inkprint.operators import metrics as M
from inkprint.operators import ranking as R

ALPHABET = ["a", "Z", "_", "9", " ", "\t", "\n", "\r", "#", "'", '"', "é", "²", "　", "\x1c",
            "́", "漢", "😀", "\x0b", " "]


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(400)]
    texts += ["", "\n", " ", "#", "a", "'''\"\"\"", "\n\n", "a\n", " \tx", "# c", "\t# c #"]
    return spark.createDataFrame(
        [(str(i), t) for i, t in enumerate(texts)], "id string, code string"
    ).cache()


# Fixed value: what counts as an identifier.
IDENTIFIER = re.compile(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b")


def mean(values):
    values = list(values)
    return fmean(values) if values else 0.0


def entropy(text):
    """log2 n minus the mean of log2 of each character's own count."""
    counts = Counter(text)
    return math.log2(len(text)) - mean(math.log2(counts[x]) for x in text) if text else 0.0


def python_style(code):
    words, rows, tokens = IDENTIFIER.findall(code), code.split("\n"), code.split()
    remarks = [row for row in rows if row.lstrip()[:1] == "#"]
    quotes = len(code.split('"""')) + len(code.split("'''")) - 2
    return {
        "name_avg_len": mean(map(len, words)),
        "name_snake_case_ratio": mean("_" in w and w == w.lower() for w in words),
        "name_single_char_ratio": mean(w[1:] == "" for w in words),
        "comment_density": len(remarks) / len(rows),
        "docstring_count": quotes / len(rows),
        "avg_comment_length": mean(len(row.strip("# ").strip()) for row in remarks),
        "trailing_whitespace_ratio": mean(row[-1:].isspace() for row in rows),
        "mixed_indent_ratio": mean(row[:1] == " " and "\t" in row for row in rows),
        "blank_line_ratio": mean(not row or row.isspace() for row in rows),
        "line_length_std": pstdev(map(len, rows)),
        "char_entropy": entropy(code),
        "token_entropy": entropy(" ".join(tokens)),
        "n_tokens": len(tokens),
        "unique_token_ratio": mean(tokens.index(t) == i for i, t in enumerate(tokens)),
    }


def test_style_features_follow_python(samples):
    rows = text.with_style_features(samples, tokens="space").collect()
    for row in rows:
        expected = python_style(row.code)
        found = {name: row[name] for name in expected}
        assert found == pytest.approx(expected, abs=1e-9), repr(row.code)


def test_single_feature_columns_agree_with_the_vector(samples):
    c = F.col("code")
    alone = samples.select(
        "id",
        text.name_avg_len(c).alias("name_avg_len"),
        text.name_snake_case_ratio(c).alias("name_snake_case_ratio"),
        text.name_single_char_ratio(c).alias("name_single_char_ratio"),
        text.char_entropy(c).alias("char_entropy"),
        text.unique_ratio(text.space_tokens(c)).alias("unique_token_ratio"),
    )
    vector = {r.id: r for r in text.with_style_features(samples, tokens="space").collect()}
    for row in alone.collect():
        for name in alone.columns[1:]:
            assert row[name] == pytest.approx(vector[row.id][name], abs=1e-9)


def test_tokenizer_path_entropies(samples):
    for row in text.with_style_features(samples, tokens="python").collect():
        assert row.char_entropy == pytest.approx(entropy(row.code), abs=1e-9)
        tokens = pysyntax.tokens_of(row.code)
        assert row.n_tokens == len(tokens)
        assert row.token_entropy == pytest.approx(entropy(" ".join(tokens)), abs=1e-9)


def test_whitespace_class_is_pythons(spark):
    points = spark.createDataFrame([(i, "x" + chr(i)) for i in range(1, 0x3100)], "id int, t string")
    stripped = points.select("id", (text.py_strip(F.col("t")) == "x").alias("is_space"))
    assert {r.id for r in stripped.where("is_space").collect()} == {
        i for i in range(1, 0x3100) if chr(i).isspace()
    }


def test_fences(spark):
    cases = {
        "```python\nx\n```": "x",
        "```\nx\ny": "x\ny",
        "```": "",
        "```python\n```": "",
        "  plain \n": "plain",
        "```\na\n  ``` trailing": "a",
        "```\na\n```\nb": "a\n```\nb",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    found = {r.t: r.c for r in df.select("t", text.strip_code_fence(F.col("t")).alias("c")).collect()}
    assert found == cases


def test_prompt_keeps_special_characters(spark):
    df = spark.createDataFrame([("100% of {language}",)], "s string")
    prompt = df.select(text.render_prompt(F.lit("python"), F.col("s")).alias("p")).first().p
    assert prompt.startswith("Write a python solution") and "100% of {language}\n" in prompt


def test_strip_comments_is_idempotent(samples):
    once = samples.select(strip_comments(F.col("code")).alias("c"))
    assert once.where(strip_comments(F.col("c")) != F.col("c")).count() == 0


def test_reformat_changes_only_edges(samples):
    out = samples.select("code", reformat_whitespace(F.col("code"), F.col("id")).alias("c"))
    for row in out.collect():
        kept = [x.rstrip() for x in row.c.split("\n") if x.strip()]
        assert kept == [x.rstrip() for x in row.code.split("\n") if x.strip()]


def test_perturb_keeps_tokens(spark, samples):
    df = samples.select("id", F.concat_ws(" ", "code", F.lit("a b c d e"), "code").alias("code"))
    for row in L.perturbations(df).join(df.withColumnRenamed("code", "o"), "id").collect():
        assert Counter(row.code.split(" ")) == Counter(row.o.split(" "))
    short = spark.createDataFrame([("1", "a b c")], "id string, code string")
    assert {r.code for r in L.perturbations(short).collect()} == {"a b c"}


# --- ranks, splits, duplicates ------------------------------------------------------


def labelled(spark, n, positives):
    return spark.range(n).select(
        F.col("id").cast("string").alias("id"), (F.col("id") < positives).cast("int").alias("label")
    )


@pytest.mark.parametrize(
    "n, test, val", [(100, 15, 16), (11, 2, 2), (87, 14, 13), (512, 77, 77), (2000, 300, 300)]
)
def test_split_sizes(spark, n, test, val):
    split = R.stratified_split(labelled(spark, n, n // 3))
    sizes = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert sizes == {"test": test, "val": val, "train": n - test - val}
    assert split.select("id").distinct().count() == n
    for name, size in sizes.items():
        share = split.where((F.col("split") == name) & (F.col("label") == 1)).count()
        assert abs(share - size * (n // 3) / n) <= 1.5


def test_split_and_sample_ignore_partitioning(spark):
    df = labelled(spark, 500, 200)
    one, many = (
        {(r.id, r.split) for r in R.stratified_split(df.repartition(k)).collect()} for k in (1, 17)
    )
    assert one == many
    assert {r.id for r in R.seeded_sample(df.repartition(1), 50).collect()} == {
        r.id for r in R.seeded_sample(df.repartition(17), 50).collect()
    }


def test_split_accepts_more_strata(spark):
    df = labelled(spark, 400, 100).withColumn("m", F.col("id").cast("int") % 4)
    split = R.stratified_split(df, strata=["label", "m"])
    assert split.where("split = 'test'").count() == 60


def test_dedup_prefers_the_first_source(spark):
    human = spark.createDataFrame([("h", 0, "same"), ("h2", 0, "x")], "id string, label int, code string")
    rows = [(f"a{i}", 1, "same") for i in range(500)] + [("b", 1, "y")]
    ai = spark.createDataFrame(rows, "id string, label int, code string").repartition(8)
    kept = C.dedup_keep_first(C.union_sources(human, ai))
    assert {r.id for r in kept.collect()} == {"h", "h2", "b"}
    assert kept.columns == ["id", "label", "code", "src_ord"]
    again = C.dedup_keep_first(kept)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, kept.collect()))


def pair_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    if not pos or not neg:
        return None
    won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return won / (len(pos) * len(neg))


def test_auc_with_ties(spark):
    rows = [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (0.4, 1), (0.9, 0)]
    df = spark.createDataFrame(rows, "score double, label int")
    assert M.roc_auc(df).first().roc_auc == pytest.approx(5 / 9)
    assert M.roc_auc(df.where("label = 1")).first().roc_auc is None


@pytest.mark.parametrize("buckets", [2, 7, 200])
def test_auc_and_median_with_a_dominant_group_and_heavy_ties(spark, buckets):
    rng = random.Random(buckets)
    rows = []
    for _ in range(3000):
        group = "hot" if rng.random() < 0.6 else rng.choice("abc")
        # a third of the rows share one score, the rest lie in a narrow band with outliers
        score = 0.5 if rng.random() < 0.33 else rng.choice([rng.gauss(0.5, 1e-6), rng.gauss(0, 1e6)])
        rows.append((group, score, rng.randint(0, 1)))
    rows.append(("lonely", 0.25, 1))
    df = spark.createDataFrame(rows, "g string, score double, label int").repartition(8)
    found = {r.g: r.roc_auc for r in M.roc_auc(df, ["g"], buckets=buckets).collect()}
    medians = {r.g: r.median for r in R.exact_median(df, "score", ["g"], buckets=buckets).collect()}
    for g in {r[0] for r in rows}:
        group = [(s, y) for k, s, y in rows if k == g]
        assert found[g] == (pytest.approx(pair_auc(group)) if pair_auc(group) is not None else None)
        assert medians[g] == pytest.approx(median(s for s, _ in group))
    flipped = M.roc_auc(df.withColumn("score", -F.col("score")), ["g"], buckets=buckets)
    for r in flipped.where("roc_auc is not null").collect():
        assert r.roc_auc + found[r.g] == pytest.approx(1)
    whole = R.exact_median(df, "score", buckets=buckets).first().median
    assert whole == pytest.approx(median(s for _, s, _ in rows))


def test_evaluate_agrees_with_separate_metrics(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), round(rng.random(), 2), rng.randint(0, 1)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    judged = df.withColumn("prediction", M.threshold_prediction(F.col("score")))
    parts = {r.g: r for r in M.binary_metrics(judged, ["g"]).collect()}
    for r in M.evaluate(df, ["g"]).collect():
        for name in ("accuracy", "precision", "recall", "f1", "confusion_matrix"):
            assert r[name] == parts[r.g][name]
        assert r.roc_auc == pytest.approx(pair_auc([(s, y) for g, s, y in rows if g == r.g]))


# --- likelihood ---------------------------------------------------------------------


def brute_likelihood(train, code):
    pairs, firsts, words = Counter(), Counter(), Counter()
    for t in train:
        tokens = t.split()
        words.update(tokens)
        for a, b in zip(tokens, tokens[1:]):
            pairs[a, b] += 1
            firsts[a] += 1
    n, v = sum(words.values()), len(words)
    tokens = code.split()
    logs = [
        math.log((pairs[a, b] + (words[b] + 1) / (n + v + 1)) / (firsts[a] + 1))
        for a, b in zip(tokens, tokens[1:])
    ]
    return sum(logs) / len(logs) if logs else None


@pytest.mark.parametrize("hot_pairs", [1, 5, 100_000])
def test_likelihood_with_a_hot_pair(spark, hot_pairs):
    rng = random.Random(5)
    vocabulary = ["the", "the", "the", "of", "a", "b", "c", "dd"]
    train = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(60)]
    scored = [" ".join(rng.choices([*vocabulary, "new"], k=rng.randint(0, 30))) for _ in range(60)]
    scored += ["", "one", "the " * 2000, "the " * 600 + "rare", "the " * 600 + "of"]
    model = L.fit_bigrams(spark.createDataFrame([(t,) for t in train], "code string"))
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(scored)], "id string, code string")
    rows = L.log_likelihood(df, model, hot_pairs=hot_pairs).collect()
    assert len(rows) == len(scored)
    for r in rows:
        expected = brute_likelihood(train, scored[int(r.id)])
        assert r.ll == (pytest.approx(expected) if expected is not None else None)


def test_curvature_of_unperturbable_text_is_zero(spark):
    df = spark.createDataFrame([("1", "a b c"), ("2", "a b c a b c a b d e")], "id string, code string")
    rows = {r.id: r for r in L.curvature(df, L.fit_bigrams(df)).collect()}
    assert rows["1"].score == 0
    assert rows["2"].std_ll > 0
