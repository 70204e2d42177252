"""Zero-shot scoring: bigram likelihood, perplexity and curvature, by joins and aggregates.

The language model is count tables. A log-probability is a sum of terms: one of the pair, one of each of its two words, each
zero where training had no count. So a text's sum needs the terms of its own pairs and words alone: the most frequent terms (a fixed number)
are sent to every task, the rest meet the table of terms in one shuffle, and what was never counted drops out there. A perturbed text
is scored by the terms in which it differs from its original.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.functions.attacks import draw
from inkprint.functions.text import space_tokens
from inkprint.operators.corpus import drop_null_code, in_split
from inkprint.operators.metrics import median_predictions, roc_auc
from inkprint.operators.ranking import seeded_sample
from inkprint.storage import stored

SMOOTHING = 1.0
# pairs whose terms are sent to tasks: at most this many rows, whatever the data
HOT_PAIRS = 100_000
# words looked up by broadcast: the most frequent ones own most pairs
HOT_WORDS = 10_000
# longer words and pairs are never broadcast, so that the two tables above stay small
_HOT_CHARS = 64
# equal perturbations must have exactly equal scores, whatever order their terms were added in
_SCORE_DIGITS = 12
# rows that a task hands over at once; a text may have many
_ROWS_OUT = 65_536


@dataclass(frozen=True)
class BigramModel:
    """words(w, n_word, n_first), pairs(w1, w2, n_pair), totals(n_tokens, n_words), terms(k1, k2, value, uses, h) and
    ``unseen``, the log-probability of a pair without terms.

    A pair's term is under both words, a word's under itself and '': first of a pair (w, ''), second ('', w).
    """

    words: DataFrame
    pairs: DataFrame
    totals: DataFrame
    terms: DataFrame
    unseen: float


def _pairs_of(tokens: Column) -> Column:
    """Adjacent token pairs as an array of structs; empty below two tokens."""
    n = F.size(tokens)
    return F.arrays_zip(
        F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))).alias("w1"),
        F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))).alias("w2"),
    )


def fit_bigrams(train: DataFrame, code: str = "code") -> BigramModel:
    """Counts over whole texts of the training rows.

    The count tables are the fitted model: they are written once, so scoring reads them
    instead of tokenizing the training texts again for every use.
    """
    tokens = train.select(space_tokens(F.col(code)).alias("t"))
    pairs = stored(
        tokens.select(F.inline(_pairs_of(F.col("t"))))
        .groupBy("w1", "w2")
        .agg(F.count("*").alias("n_pair")),
        "bigram-pairs",
    )
    n_word = tokens.select(F.explode("t").alias("w")).groupBy("w").agg(F.count("*").alias("n_word"))
    n_first = pairs.groupBy(F.col("w1").alias("w")).agg(F.sum("n_pair").alias("n_first"))
    words = stored(n_word.join(n_first, "w", "left").na.fill(0, ["n_first"]), "bigram-words")
    totals = words.agg(
        F.coalesce(F.sum("n_word"), F.lit(0)).alias("n_tokens"), F.count("*").alias("n_words")
    )
    terms, unseen = _terms(words, pairs, totals)
    return BigramModel(words, pairs, totals, terms, unseen)


def _with_count(pairs: DataFrame, key: str, words: DataFrame, count: str) -> DataFrame:
    """Append a word's count. The most frequent words, which own most pairs, come by broadcast of a
    fixed number of short rows; only pairs of rarer words are shuffled on the word."""
    counts = words.select(F.col("w").alias(key), F.col(count).alias(f"_{count}"))
    short = counts.where(F.length(key) <= _HOT_CHARS)
    hot = short.orderBy(F.col(f"_{count}").desc(), key).limit(HOT_WORDS)
    met = pairs.join(F.broadcast(hot), key, "left")
    near = met.where(F.col(f"_{count}").isNotNull())
    far = met.where(F.col(f"_{count}").isNull()).drop(f"_{count}").join(counts, key, "left")
    return near.unionByName(far).withColumnRenamed(f"_{count}", count)


def _terms(words: DataFrame, pairs: DataFrame, totals: DataFrame) -> tuple[DataFrame, float]:
    """The terms of log p(w2|w1), stored, and what it is without any of them.

    p(w2|w1) = (n(w1,w2) + mu q(w2)) / (n_first(w1) + mu) with q(w) = (n(w) + 1) / (N + V + 1), so its logarithm is
    log(1 + n(w1,w2) / (mu q(w2))) - log(1 + n_first(w1) / mu) + log(n(w2) + 1) - log(N + V + 1).
    """
    sizes = totals.first()
    size = float(sizes["n_tokens"] + sizes["n_words"] + 1)
    q = (F.col("n_word") + 1.0) / size
    both = _with_count(pairs, "w2", words, "n_word").select(
        F.col("w1").alias("k1"), F.col("w2").alias("k2"), F.log1p(F.col("n_pair") / (SMOOTHING * q)).alias("value"), F.col("n_pair").alias("uses")
    )
    first = words.where("n_first > 0").select(F.col("w").alias("k1"), F.lit("").alias("k2"), (-F.log1p(F.col("n_first") / SMOOTHING)).alias("value"), "n_word")
    second = words.select(F.lit("").alias("k1"), F.col("w").alias("k2"), F.log(F.col("n_word") + 1.0).alias("value"), "n_word")
    every = both.union(first).union(second).withColumn("h", F.xxhash64("k1", "k2"))
    return stored(every, "bigram-terms"), -float(np.log(size))


def _hot_terms(model: BigramModel, hot_pairs: int) -> dict[tuple[str, str], float]:
    """The terms that go to every task: fixed numbers of short ones."""
    of_words = (F.col("k1") == "") | (F.col("k2") == "")
    short = model.terms.where(F.length("k1") + F.length("k2") <= _HOT_CHARS)
    order = [F.col("uses").desc(), "k1", "k2"]
    hot = short.where(~of_words).orderBy(*order).limit(hot_pairs).union(short.where(of_words).orderBy(*order).limit(2 * HOT_WORDS))
    return {(r.k1, r.k2): r.value for r in hot.collect()}


def _counts(tokens: list[str]) -> Counter:
    """How often a text has each term."""
    counts = Counter(zip(tokens, tokens[1:]))
    counts.update(Counter((w, "") for w in tokens[:-1]))
    counts.update(Counter(("", w) for w in tokens[1:]))
    return counts


def _changes(code: str, name: str, turn: int, n_swaps: int, seed: int, words: list[list[str]]) -> dict[tuple[str, str], int]:
    """What ``perturb`` adds to a text's ``_counts`` in a round; ``words`` are the tokens of each part between blanks."""
    parts, found = list(words), defaultdict(int)
    last = len(parts) - 1
    for swap in range(1, min(n_swaps, len(parts) // 2) + 1):
        digest = md5(f"{seed}|{name}|{turn}|{swap}".encode()).digest()
        at = int.from_bytes(digest[:4], "big") % last
        one, two = parts[at], parts[at + 1]
        parts[at], parts[at + 1] = two, one
        if not one or not two or one == two:
            continue
        before, after = at - 1, at + 2
        while before >= 0 and not parts[before]:
            before -= 1
        while after <= last and not parts[after]:
            after += 1
        left = parts[before][-1:] if before >= 0 else []
        right = parts[after][:1] if after <= last else []
        for run, n in ((left + one + two + right, -1), (left + two + one + right, 1)):
            for pair in zip(run, run[1:]):
                found[pair] += n
            # an end of the text: its first word is no second one, its last no first one
            if not left:
                for w in run[1:]:
                    found["", w] += n
            if not right:
                for w in run[:-1]:
                    found[w, ""] += n
    return found


def _term_rows(
    df: DataFrame, model: BigramModel, keys: tuple[str, ...], code: str, rounds: int, n_swaps: int, seed: int, max_tokens: int | None, hot_pairs: int
) -> DataFrame:
    """(keys, _round, k1, k2, n, near, steps) in one pass over the texts.

    Round 0 is the text; later ones hold what a perturbation adds to it. A row is either the sum of the terms at hand with the number of
    predicted tokens (k1 is null), or one of the other terms and how often it occurs.
    """
    shared = df.sparkSession.sparkContext.broadcast(_hot_terms(model, hot_pairs))
    unseen = model.unseen
    named = F.col("id").cast("string") if rounds else F.lit(None).cast("string")
    texts = df.select(*keys, named.alias("_name"), F.col(code).alias("_code"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            row, turn, k1, k2, times, near, steps = out

            def add(i: int, r: int, counts: dict, n: int) -> None:
                total = n * unseen
                for key, k in counts.items():
                    value = hot.get(key) if k else 0.0
                    if value is not None:
                        total += k * value
                        continue
                    row.append(i), turn.append(r), k1.append(key[0]), k2.append(key[1]), times.append(k), near.append(0.0), steps.append(0)
                row.append(i), turn.append(r), k1.append(None), k2.append(None), times.append(0), near.append(total), steps.append(n)

            def flushed() -> pa.RecordBatch:
                at = pa.array(row, pa.int64())
                kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64())
                made = [pa.array(x, k) for x, k in zip(out[1:], kinds, strict=True)]
                whole = pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(at) for c in keys), *made], names=[*keys, "_round", "k1", "k2", "n", "near", "steps"]
                )
                for x in out:
                    x.clear()
                return whole

            for i, (name, text) in enumerate(zip(batch.column("_name").to_pylist(), batch.column("_code").to_pylist(), strict=True)):
                tokens = (text or "").split()[:max_tokens]
                n = max(0, len(tokens) - 1)
                own = _counts(tokens)
                add(i, 0, own, n)
                parts = (text or "").split(" ") if rounds else []
                words = [part.split() for part in parts] if len(parts) >= 4 else []
                for r in range(1, rounds + 1):
                    if not words:
                        add(i, r, {}, 0)
                    elif name is None:
                        # a perturbation of a text without an id is null
                        add(i, r, {key: -k for key, k in own.items()}, -n)
                    else:
                        add(i, r, _changes(text, name, r, n_swaps, seed, words), 0)
                    if len(row) >= _ROWS_OUT:
                        yield flushed()
            if row:
                yield flushed()

    types = {f.name: f.dataType.simpleString() for f in texts.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keys), "_round int, k1 string, k2 string, n long, near double, steps long"])
    return texts.mapInArrow(run, schema)


def _sums(
    df: DataFrame, model: BigramModel, keys: tuple[str, ...], code: str, rounds: int = 0, n_swaps: int = 0, seed: int = 0,
    max_tokens: int | None = None, hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """(keys, _round, _sum, _steps): summed log-probabilities and predicted tokens, of later rounds less those of round 0."""
    rows = _term_rows(df, model, keys, code, rounds, n_swaps, seed, max_tokens, hot_pairs)
    # rows without a term meet none, wherever their hash sends them
    rows = rows.withColumn("h", F.when(F.col("k1").isNull(), F.xxhash64(*keys, "_round")).otherwise(F.xxhash64("k1", "k2")))
    # the hash leads the key, so that sorting compares longs
    met = rows.join(model.terms.select("h", "k1", "k2", "value"), ["h", "k1", "k2"], "left")
    met = met.where("k1 IS NULL OR value IS NOT NULL")
    value = F.col("near") + F.coalesce(F.col("n") * F.col("value"), F.lit(0.0))
    return met.groupBy(*keys, "_round").agg(F.sum(value).alias("_sum"), F.sum("steps").alias("_steps"))


def _mean(total: Column, steps: Column) -> Column:
    return F.round(F.try_divide(total, steps), _SCORE_DIGITS)


def log_likelihood(
    df: DataFrame,
    model: BigramModel,
    keys: tuple[str, ...] = ("id",),
    code: str = "code",
    max_tokens: int | None = None,
    hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """(keys, n_predicted, ll): mean log-probability per predicted token of whole texts, or of their
    first ``max_tokens`` tokens; null when no token is predicted."""
    sums = _sums(df, model, keys, code, max_tokens=max_tokens, hot_pairs=hot_pairs)
    return sums.select(*keys, F.col("_steps").alias("n_predicted"), _mean(F.col("_sum"), F.col("_steps")).alias("ll"))


def perturbed_likelihood(
    df: DataFrame, model: BigramModel, n_perturbations: int = 10, n_swaps: int = 5, seed: int = 42
) -> DataFrame:
    """(id, round, n_predicted, ll) of each text as round 0, and of its ``perturbations``.

    As ``log_likelihood`` of the perturbed texts, but these are never built: a swap changes few terms of a text's sum.
    """
    sums = _sums(df, model, ("id",), "code", n_perturbations, n_swaps, seed)
    # a text has one row per round here
    rounds = sums.groupBy("id").agg(
        F.sum(F.when(F.col("_round") == 0, F.col("_sum"))).alias("_own"),
        F.sum(F.when(F.col("_round") == 0, F.col("_steps"))).alias("_n"),
        F.collect_list(F.struct("_round", "_sum", "_steps")).alias("_rounds"),
    )
    each = rounds.select("id", "_own", "_n", F.inline("_rounds"))
    later = F.col("_round") > 0
    total = F.col("_own") + F.when(later, F.col("_sum")).otherwise(0.0)
    steps = F.col("_n") + F.when(later, F.col("_steps")).otherwise(0)
    return each.select("id", F.col("_round").alias("round"), steps.alias("n_predicted"), _mean(total, steps).alias("ll"))


def perplexity(ll: Column) -> Column:
    return F.exp(-ll)


def perturb(code: Column, id_col: Column, round_col: Column, n_swaps: int = 5, seed: int = 42) -> Column:
    """min(n_swaps, n/2) adjacent swaps of space-split tokens at hashed positions.

    Swaps follow each other and may overlap; fewer than four tokens stay as they are.
    """
    tokens = F.split(code, " ", -1)
    prefix = F.concat(
        F.lit(f"{seed}|"), id_col.cast("string"), F.lit("|"), round_col.cast("string"), F.lit("|")
    )

    def swap(words: Column, step: Column) -> Column:
        digest = F.md5(F.concat(prefix, step.cast("string")))
        at = (F.pmod(draw(digest, 0), (F.size(words) - 1).cast("bigint")) + 1).cast("int")
        return F.concat(
            F.slice(words, F.lit(1), at - 1),
            F.array(F.element_at(words, at + 1), F.element_at(words, at)),
            F.slice(words, at + 2, F.size(words)),
        )

    count = F.least(F.lit(n_swaps), F.floor(F.size(tokens) / 2).cast("int"))
    swapped = F.aggregate(F.sequence(F.lit(1), count), tokens, swap)
    return F.when(F.size(tokens) < 4, code).otherwise(F.array_join(swapped, " "))


def perturbations(
    df: DataFrame, n_perturbations: int = 10, n_swaps: int = 5, seed: int = 42
) -> DataFrame:
    """One row per (id, round) with the perturbed text."""
    numbers = F.explode(F.sequence(F.lit(1), F.lit(n_perturbations))).alias("round")
    changed = perturb(F.col("code"), F.col("id"), F.col("round"), n_swaps, seed)
    return df.select("id", "code", numbers).select("id", "round", changed.alias("code"))


def perturbation_stats(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of perturbed scores per id."""
    return scores.groupBy("id").agg(
        F.avg("ll").alias("mean_ll"), F.stddev_pop("ll").alias("std_ll")
    )


def curvature(
    df: DataFrame,
    model: BigramModel,
    n_perturbations: int = 10,
    n_swaps: int = 5,
    seed: int = 42,
) -> DataFrame:
    """(id, ll, mean_ll, std_ll, score): how far the text sits above its perturbations.

    Original and perturbed texts are scored together, the original as round 0, so the
    model tables are joined once.
    """
    scores = perturbed_likelihood(df, model, n_perturbations, n_swaps, seed)
    perturbed = F.when(F.col("round") > 0, F.col("ll"))
    per_id = scores.groupBy("id").agg(
        F.max(F.when(F.col("round") == 0, F.col("ll"))).alias("ll"),
        F.avg(perturbed).alias("mean_ll"),
        F.stddev_pop(perturbed).alias("std_ll"),
    )
    score = (F.col("ll") - F.col("mean_ll")) / (F.col("std_ll") + 1e-8)
    return per_id.withColumn("score", score)


def zero_shot_eval(
    dataset: DataFrame,
    model: BigramModel,
    n_samples: int | None = None,
    n_perturbations: int = 10,
    seed: int = 42,
) -> DataFrame:
    """(roc_auc, accuracy, threshold, n_scored, n_unscored) of the curvature score on all test snippets, or
    on a seeded sample of them, predicting AI strictly above the median score. Snippets too short
    for a score are counted, not judged."""
    test = drop_null_code(in_split(dataset, "test")).select("id", "label", "code")
    if n_samples is not None:
        # a top-n ends in one task; spread its rows before the costly part
        test = seeded_sample(test, n_samples, "id", seed).repartition("id")
    scores = curvature(test, model, n_perturbations, seed=seed)
    # the scores feed an AUC, a median, a comparison with it and two counts
    every = stored(scores.join(test.select("id", "label"), "id").select("id", "label", "score"), "curvature")
    judged = every.where(F.col("score").isNotNull())
    sizes = every.agg(F.count("score").alias("n_scored"), F.count_if(F.col("score").isNull()).alias("n_unscored"))
    predicted = median_predictions(judged)
    rates = predicted.agg(
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
        F.first("threshold").alias("threshold"),
    )
    return roc_auc(judged).crossJoin(F.broadcast(rates)).crossJoin(F.broadcast(sizes))  # one row each
