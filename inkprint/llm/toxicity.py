"""Toxicity: a linear-chain conditional random field tags toxic tokens; marginals give scores and offsets."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.llm.tables import hash_share, row_count, slices, words
from inkprint.storage import stored

# Labelled rows the field is fitted on, about, and segments of SEGMENT tokens of them at most.
FIT_ROWS = 6_000
FIT_SEGMENTS = 24_000
SEGMENT = 32
# Hashed features of a token; the last one is always on.
FEATURES = 1 << 18
# A word or stem marks toxic tokens if it has so many contexts in toxic texts, and that share of all its contexts there.
MIN_CONTEXTS = 4
MIN_SHARE = 0.7
STEMS = (4, 5, 6)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
_CACHED_WORDS = 500_000


def lowered(text: str) -> str:
    """A-Z lower-cased; no character moves."""
    return text.lower() if text.isascii() else text.translate(_UPPER)


def _features(word: str) -> list[int]:
    """Feature numbers of a token: its word, its stems, its ending and a bias."""
    names = [f"w{word}", f"e{word[-3:]}", *[f"p{word[:n]}" if len(word) >= n else f"s{n}" for n in STEMS]]
    return [zlib.crc32(n.encode("utf-8", "replace")) % (FEATURES - 1) for n in names] + [FEATURES - 1]


def chain_marginals(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Log-odds of state 1 for every token by the forward-backward recursion.

    ``emission`` has the tokens of all sequences one after another: the log-odds that a token adds. Both messages are
    kept as log-odds, and each step runs over all sequences that are still going on.
    """
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    begin, size = starts[order], lengths[order]
    (t00, t01), (t10, t11) = transition
    forward, backward = emission.astype(np.float64), np.zeros(len(emission))
    # sequences still going on at each step, longest first
    going = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
    for step in range(1, len(going)):
        at = begin[: going[step]] + step
        before = forward[at - 1]
        forward[at] += np.logaddexp(t01, t11 + before) - np.logaddexp(t00, t10 + before)
    for step in range(1, int(size[0]) if len(size) else 0):
        n = going[step]
        at = begin[:n] + size[:n] - 1 - step
        after = backward[at + 1] + emission[at + 1]
        backward[at] = np.logaddexp(t10, t11 + after) - np.logaddexp(t00, t01 + after)
    return forward + backward


@dataclass(frozen=True)
class ToxicityModel:
    """Feature weights for state 1, transition scores, and the calibration of a document's score."""

    weights: np.ndarray
    transition: np.ndarray
    calibration: np.ndarray


class _Emissions(dict):
    """Emission log-odds by word, filled on demand."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self._weights = weights

    def __missing__(self, word: str) -> float:
        value = float(self._weights[_features(word)].sum())
        if len(self) < _CACHED_WORDS:
            self[word] = value
        return value


def markers(sample: DataFrame, min_contexts: int = MIN_CONTEXTS, min_share: float = MIN_SHARE) -> DataFrame:
    """(marker) of (text, toxic): words ("=word") and stems ("^stem") found in ever new contexts, but in toxic texts.

    Contexts are told apart by the word before, in 64 classes; so copies of one text add none.
    """
    own = F.col("w")
    before = F.concat(F.array(F.lit("")), F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))))
    tokens = sample.select("toxic", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    tokens = tokens.select("toxic", F.inline(F.arrays_zip(own.alias("word"), before.alias("before"))))
    seen = F.expr("shiftleft(1L, cast(pmod(xxhash64(before), 64) as int))")
    by_word = tokens.groupBy("word").agg(
        F.bit_or(F.when(F.col("toxic") == 1, seen).otherwise(F.lit(0).cast("long"))).alias("in_toxic"),
        F.bit_or(F.when(F.col("toxic") == 1, F.lit(0).cast("long")).otherwise(seen)).alias("in_clean"),
    )
    names = [F.concat(F.lit("="), "word"), *[F.when(F.char_length("word") >= n, F.concat(F.lit("^"), F.substring("word", 1, n))) for n in STEMS]]
    counts = (
        by_word.select(F.explode(F.array(*names)).alias("marker"), "in_toxic", "in_clean")
        .where("marker IS NOT NULL")
        .groupBy("marker")
        .agg(F.bit_count(F.bit_or("in_toxic")).alias("toxic"), F.bit_count(F.bit_or("in_clean")).alias("clean"))
    )
    enough = (F.col("toxic") >= min_contexts) & (F.col("toxic") >= min_share * (F.col("toxic") + F.col("clean") + 1))
    return counts.where(enough).select("marker")


def _segments(sample: DataFrame, marked: frozenset[str]) -> DataFrame:
    """(order, words, tags): consecutive tokens of the sample; in toxic texts the marked ones are tagged 1."""

    def tags(tokens: list[str]) -> list[int]:
        return [int(f"={t}" in marked or any(f"^{t[:n]}" in marked for n in STEMS if len(t) >= n)) for t in tokens]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                tokens = _WORD.findall(lowered(text or ""))
                for i in range(0, len(tokens), SEGMENT):
                    part = tokens[i : i + SEGMENT]
                    tag = tags(part) if toxic == 1 else [0] * len(part)
                    # segments with a toxic token come first, then a hash order
                    out.append((0 if any(tag) else 1, zlib.crc32(" ".join(part).encode("utf-8", "replace")), part, tag))
            yield pd.DataFrame(out, columns=["kind", "place", "words", "tags"])

    return sample.mapInPandas(run, "kind int, place long, words array<string>, tags array<int>")


def _fit_chain(segments: list, steps: int = 60, rate: float = 0.3, penalty: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions of the highest penalised likelihood, by AdaGrad on the whole sample."""
    weights, transition = np.zeros(FEATURES), np.zeros((2, 2))
    if not segments:
        return weights, transition
    lengths = np.array([len(r["words"]) for r in segments])
    vocabulary: dict[str, int] = {}
    word_of = np.array([vocabulary.setdefault(w, len(vocabulary)) for r in segments for w in r["words"]])
    features = np.array([_features(w) for w in vocabulary])
    tags = np.array([t for r in segments for t in r["tags"]], dtype=np.float64)
    n = len(tags)
    first = np.zeros(n, dtype=bool)
    first[np.cumsum(lengths) - lengths] = True
    inner = np.flatnonzero(~first)
    seen = np.zeros((2, 2))
    np.add.at(seen, (tags[inner - 1].astype(int), tags[inner].astype(int)), 1)
    squares, pair_squares = np.full(FEATURES, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(steps):
        emission = weights[features].sum(axis=1)[word_of]
        odds = chain_marginals(emission, lengths, transition)
        p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        by_word = np.bincount(word_of, weights=p - tags, minlength=len(vocabulary)) / n
        gradient = penalty * weights
        for column in features.T:
            gradient += np.bincount(column, weights=by_word, minlength=FEATURES)
        # pair marginals, from the messages on either side of a step
        joint = _pair_marginals(emission, odds, lengths, inner, transition)
        pair_gradient = (joint - seen) / n + penalty * transition
        squares += gradient**2
        pair_squares += pair_gradient**2
        weights -= rate * gradient / np.sqrt(squares)
        transition -= rate * pair_gradient / np.sqrt(pair_squares)
    return weights, transition


def _pair_marginals(emission: np.ndarray, odds: np.ndarray, lengths: np.ndarray, inner: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Expected counts of each transition, from single marginals and what each token gets from its left."""
    if not len(inner):
        return np.zeros((2, 2))
    # messages from the right: what a token's marginal has beyond its forward message
    forward = _forward(emission, lengths, transition)
    after = odds[inner] - forward[inner] + emission[inner]
    before = forward[inner - 1]
    logs = np.stack([transition[a, b] + a * before + b * after for a in (0, 1) for b in (0, 1)])
    shares = np.exp(logs - logs.max(axis=0))
    return (shares / shares.sum(axis=0)).sum(axis=1).reshape(2, 2)


def _forward(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> np.ndarray:
    starts = np.cumsum(lengths) - lengths
    (t00, t01), (t10, t11) = transition
    forward = emission.astype(np.float64)
    for step in range(1, int(lengths.max())):
        at = starts[lengths > step] + step
        before = forward[at - 1]
        forward[at] += np.logaddexp(t01, t11 + before) - np.logaddexp(t00, t10 + before)
    return forward


def _signals(strongest: np.ndarray, expected: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(strongest)), np.clip(strongest, -12, 12), np.log1p(expected)], axis=1)


def _fit_calibration(signals: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    beta = np.zeros(signals.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(signals @ beta, -40, 40)))
        hessian = signals.T @ (signals * (p * (1 - p))[:, None]) + 0.5 * np.eye(len(beta))
        beta -= np.linalg.solve(hessian, signals.T @ (p - toxic) + 0.5 * beta)
    return beta


def fit_toxicity(labelled: DataFrame, fit_rows: int = FIT_ROWS, fit_segments: int = FIT_SEGMENTS) -> ToxicityModel:
    """From (id, text, toxic): a hash sample of about ``fit_rows`` rows with a label, whole texts.

    Tokens of toxic texts are labelled by ``markers`` found in the sample; the field is fitted on at most
    ``fit_segments`` segments, those with toxic tokens first; the sample's labels calibrate document scores. Without labelled
    rows all scores are 0.5.
    """
    usable = labelled.where(F.col("toxic").isin(0, 1)).select("id", "text", "toxic")
    share = min(1.0, fit_rows / max(1, row_count(usable)))
    sample = stored(usable.where(hash_share(F.col("id")) < share), "toxicity-sample")
    marked = frozenset(r[0] for r in markers(sample).collect())
    chosen = _segments(sample.select("text", "toxic"), marked).orderBy("kind", "place", "words").limit(fit_segments).collect()
    weights, transition = _fit_chain(chosen)
    model = ToxicityModel(weights, transition, np.zeros(3))
    rows = tag(sample.withColumnRenamed("id", "doc_id"), model, carry=("toxic",)).select("strongest", "expected", "toxic").toPandas()
    signals = _signals(rows["strongest"].to_numpy(), rows["expected"].to_numpy())
    return ToxicityModel(weights, transition, _fit_calibration(signals, rows["toxic"].to_numpy(dtype=np.float64)))


def tag(docs: DataFrame, model: ToxicityModel, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carry..., score, strongest, expected, spans): every whole text tagged.

    ``strongest`` is the highest log-odds of a token to be toxic, ``expected`` the sum of the marginals above one half, ``spans`` the offending tokens'
    (start, end, probability) in code points with the end exclusive. Texts without words, null ones included, have the lowest ``strongest`` and no
    spans.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        emissions = _Emissions(model.weights)
        for batch in (part for whole in batches for part in slices(whole)):
            texts = [lowered(t or "") for t in batch["text"]]
            tokens = [_WORD.findall(t) for t in texts]
            lengths = np.array([len(t) for t in tokens], dtype=np.int64)
            emission = np.fromiter((emissions[w] for own in tokens for w in own), dtype=np.float64, count=int(lengths.sum()))
            odds = chain_marginals(emission, lengths, model.transition)
            strongest, expected, spans = np.full(len(texts), -12.0), np.zeros(len(texts)), [[] for _ in texts]
            filled = np.flatnonzero(lengths)
            starts = np.cumsum(lengths) - lengths
            if len(filled):
                strongest[filled] = np.maximum.reduceat(odds, starts[filled])
            for i in np.flatnonzero(strongest > 0):
                own = odds[starts[i] : starts[i] + lengths[i]]
                p = 1 / (1 + np.exp(-np.clip(own, -40, 40)))
                expected[i] = p[own > 0].sum()
                spans[i] = [(m.start(), m.end(), float(q)) for m, q in zip(_WORD.finditer(texts[i]), p, strict=True) if q > 0.5]
            score = 1 / (1 + np.exp(-np.clip(_signals(strongest, expected) @ model.calibration, -40, 40)))
            yield batch[["doc_id", *carry]].assign(score=score, strongest=strongest, expected=expected, spans=spans)

    types = dict(docs.dtypes)
    own = ", ".join(f"`{c}` {types[c]}" for c in ("doc_id", *carry))
    schema = f"{own}, score double, strongest double, expected double, spans array<struct<start:int,end:int,probability:double>>"
    return docs.select("doc_id", *carry, "text").mapInPandas(run, schema)


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))
