"""Runs of repeated words: the grammar, the runs and the query against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import docs_of
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect

from inkprint.llm import periodic
from inkprint.llm.queries import op13_periodic_runs


def brute_runs(words, min_length=24, min_exponent=3):
    n, best = len(words), {}
    for q in range(1, n // min_exponent + 1):
        start = 0
        for i in range(n - q + 1):
            if i == n - q or words[i] != words[i + q]:
                if i - start + q >= max(min_length, min_exponent * q):
                    best.setdefault((start, i + q), q)  # smallest period first
                start = i + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def brute_kept(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in dropped]


def found(documents, **options):
    width = max((max(d, default=0) for d in documents), default=0) + 1
    runs = periodic.runs_of([np.array(d, dtype=np.int64) for d in documents], width, **options)
    return [[tuple(map(int, r)) for r in of] for of in runs]


@st.composite
def repetitive(draw):
    """Words dealt in blocks that are repeated, nested and broken here and there."""
    letters = st.integers(0, draw(st.integers(0, 3)))
    words = []
    for _ in range(draw(st.integers(1, 4))):
        block = draw(st.lists(letters, min_size=1, max_size=7))
        block = block * draw(st.integers(1, 6)) + draw(st.lists(letters, max_size=3))
        words += block * draw(st.integers(1, 5))
    return words


@settings(max_examples=300, deadline=None)
@given(st.lists(repetitive(), min_size=1, max_size=4), st.sampled_from([1, 2, 6, 24]), st.sampled_from([3, 4]))
def test_runs_match_brute_force(documents, min_length, min_exponent):
    options = {"min_length": min_length, "min_exponent": min_exponent}
    assert found(documents, **options) == [brute_runs(d, **options) for d in documents]


def test_a_grammar_derives_its_documents():
    rng = random.Random(3)
    documents = [np.array([rng.randrange(3) for _ in range(n)]) for n in (1, 2, 50, 400)] + [np.zeros(300, dtype=int)]
    grammar = periodic.compress(documents, 3)

    def derive(symbol):
        if symbol < 3:
            return [symbol]
        return derive(grammar.left[symbol - 3]) + derive(grammar.right[symbol - 3])

    assert [derive(r) for r in grammar.roots] == [list(d) for d in documents]
    symbols, places = periodic.derivation(grammar)
    assert len(symbols) == sum(len(d) - 1 for d in documents)
    text = np.concatenate(documents)
    assert all(derive(s) == list(text[p : p + grammar.size[s]]) for s, p in zip(symbols, places, strict=True))
    # what repeats is derived by one symbol: ten copies of a text need few more symbols than one
    copies = periodic.compress([documents[3]] * 10, 3)
    assert len(copies.left) < len(periodic.compress([documents[3]], 3).left) + 50


def test_long_runs_take_no_square_of_their_length():
    same = found([[0] * 200_000, [0, 1] * 100_000])
    assert same == [[(0, 200_000, 1)], [(0, 200_000, 2)]]
    fibonacci, before = [0, 1], [0]
    while len(fibonacci) < 2_000:
        fibonacci, before = fibonacci + before, fibonacci
    assert found([fibonacci]) == [brute_runs(fibonacci)]


def test_fingerprints_that_collide_lose_nothing(monkeypatch):
    monkeypatch.setattr(periodic, "_BASE", np.uint64(0))  # all fingerprints of like first words are equal
    rng = random.Random(8)
    documents = [[rng.randrange(2) for _ in range(60)] + [0, 1, 1] * 12 + [rng.randrange(2) for _ in range(60)] for _ in range(5)]
    assert found(documents) == [brute_runs(d) for d in documents]


def test_rows_are_judged_by_themselves(spark):
    line = "spam and  eggs\t" * 10
    texts = [line, None, "", " \n ", "a " * 24, "a " * 23, "A " * 24 + "b", line, "x\x1cy\xa0z " * 24, "é " * 30_000]
    docs = docs_of(spark, texts, ids=[0, 1, 2, 3, 4, 5, None, 0, 8, 9], runs="x", n_words="y")
    rows = periodic.collapse_runs(docs, batch_bytes=100).collect()
    assert len(rows) == len(texts)
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.text) for r in rows)
    expected = []
    for i, t in zip([0, 1, 2, 3, 4, 5, None, 0, 8, 9], texts, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        expected.append((str(i), len(words), runs, " ".join(brute_kept(words, runs))))
    assert got == sorted(expected)
    assert periodic.collapse_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.runs_of([], 0, min_exponent=2)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_matches_brute_force(spark, sf):
    expected = {}
    for doc_id, text in connect(sf).execute("SELECT doc_id, text FROM documents").fetchall():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words) if n < 3_000 else None
        if runs is None:
            continue
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))
        expected[doc_id] = (len(runs), *first, sha(listed), sha(" ".join(brute_kept(words, runs))))
    rows = op13_periodic_runs(spark, sf).collect()
    found = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in rows}
    assert len(rows) == len(found) and {k: found[k] for k in expected} == expected
    assert sum(v[0] > 0 for v in expected.values()) > 5
