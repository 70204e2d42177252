"""Small fixtures and brute-force versions of the operators, in plain Python."""

from __future__ import annotations

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def docs_of(spark, texts, ids=None, **more):
    """Documents of these texts, ids from 0 unless given; ``more`` adds constant columns."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, None, None, None, *more.values()) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", `{c}` string" for c in more))


def lowered_words(text):
    return WORDS.findall((text or "").translate(UPPER))


def grams(text, n=5):
    w = lowered_words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def sentences(seed, count, words=60, vocabulary=400):
    """Texts of random words, the same ones for a seed."""
    import random

    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words)) for _ in range(count)]
