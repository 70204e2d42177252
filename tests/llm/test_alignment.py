"""Tokenizer alignment: fragments compose in any bracketing, and rows equal a plain two-pointer version."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import docs_of, sentences
from oracle import connect
from pyspark.sql import functions as F

from inkprint.llm import alignment as A
from inkprint.llm.queries import op12_alignment


def spans(ids, entries):
    found, at = [], 0
    for i in ids:
        found.append((int(i), at, at + len(entries[i])))
        at += len(entries[i])
    return found


@pytest.fixture(scope="module")
def encoders():
    return A.left_encoder(), A.right_encoder()


def exact_left(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = exact_left.__dict__.setdefault("t", Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(f" {text}", add_special_tokens=False).ids


def brute(texts, encoders):
    """Per text n_a, n_b, n_groups, n_links, n_best, count_sum, groups text; by token spans alone."""
    (_, bytes_a), (encode_b, bytes_b) = encoders
    rows, docs_with = [], Counter()
    for text in texts:
        a = spans(exact_left(text), bytes_a) if text else []
        b = spans(encode_b([text])[0], bytes_b) if text else []
        whole = f" {text}".encode()
        if any(b"".join(entries[i] for i, _, _ in side) != whole for side, entries in ((a, bytes_a), (b, bytes_b))):
            a, b = [], []
        links = [(x, y) for x, s, e in a for y, t, u in b if s < u and t < e]
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        grouped, low = [], 0
        for cut in cuts:
            grouped.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= cut) for side in (a, b)))
            low = cut
        rows.append((len(a), len(b), len(cuts), links, ";".join(grouped)))
        docs_with.update(set(links))
    most = defaultdict(int)
    for (x, _), n in docs_with.items():
        most[x] = max(most[x], n)
    return [
        (n_a, n_b, n_groups, len(links), sum(docs_with[p] == most[p[0]] for p in links), sum(docs_with[p] for p in links), groups)
        for n_a, n_b, n_groups, links, groups in rows
    ]


def as_tuple(f):
    return (
        [list(map(int, x)) for x in (*f.prefix.parts(), *f.suffix.parts())], f.cut, f.n_groups, ";".join(f.groups),
        sorted(zip(f.pairs.tolist(), f.times.tolist(), strict=True)),
    )


def test_fragments_are_a_monoid(encoders):
    (encode_a, bytes_a), (encode_b, bytes_b) = encoders
    text = "Überraschung: tokenization, antidisestablishmentarianism!\n\n  日本語 x=0x41 😀😀 " * 4
    a, b = encode_a([text])[0], encode_b([text])[0]
    ends = [np.cumsum([len(entries[i]) for i in ids]) for ids, entries in ((a, bytes_a), (b, bytes_b))]
    whole = as_tuple(A.fragment(A.Tokens(a, ends[0], b, ends[1]), True))
    rng = random.Random(1)
    for chunk in (1, 2, 3, 5, 8, 13, 60, 10_000):
        parts = A.fragments(a, ends[0], b, ends[1], chunk)
        assert as_tuple(sum(parts[1:], parts[0])) == whole
        while len(parts) > 1:  # neighbours in random order
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert as_tuple(parts[0]) == whole
    assert not whole[0][0] and not whole[0][4]


TEXTS = [
    "The quick brown fox", "", None, " ", "  two  blanks\t\tand tabs\r\n", "a▁b", "naïve Ünïcode — 日本語 😀", "<|endoftext|> <s> <0x41>", "x" * 500,
    "\x00\x1f control", "The quick brown fox", "▁", "antidisestablishmentarianism " * 30,
]


@pytest.mark.parametrize(("chunk", "bound"), [(A.CHUNK_BYTES, 500_000), (7, 500_000), (100, 5), (3, 0)])
def test_rows_match_brute_force(spark, encoders, chunk, bound):
    texts = TEXTS + sentences(3, 3)
    ids = [*range(len(texts) - 2), None, 0]
    docs = docs_of(spark, texts, ids=ids, _row="x", n_a="y", groups="z", chunk="c")
    aligned = A.align(docs, chunk_bytes=chunk)
    scores = {r._row: (r.n_links, r.n_best, r.count_sum) for r in A.link_scores(aligned, max_broadcast=bound).collect()}
    rows = [(str(r.doc_id), r.n_a, r.n_b, r.n_groups, *scores.get(r._row, (0, 0, 0)), r.groups) for r in aligned.collect()]
    assert sorted(rows) == sorted((str(i), *r) for i, r in zip(ids, brute(texts, encoders), strict=True))


def test_nothing_to_align(spark):
    aligned = A.align(docs_of(spark, []))
    assert aligned.count() == 0 and A.link_scores(aligned).count() == 0
    aligned = A.align(docs_of(spark, [None, ""]))
    assert [(r.n_a, r.n_groups, r.groups) for r in aligned.collect()] == [(0, 0, "")] * 2


def test_a_very_long_document(spark, encoders):
    text = " ".join(sentences(5, 2_000))
    aligned = A.align(docs_of(spark, [text]))
    row = aligned.first()
    (encode_a, bytes_a), (encode_b, bytes_b) = encoders
    a, b = encode_a([text])[0], encode_b([text])[0]
    whole = A.fragment(A.Tokens(a, np.cumsum([len(bytes_a[i]) for i in a]), b, np.cumsum([len(bytes_b[i]) for i in b])), True)
    assert len(text) > 16 * A.CHUNK_BYTES
    assert (row.n_a, row.n_b, row.n_groups, row.groups) == (len(a), len(b), whole.n_groups, whole.groups[0])
    assert sum(row.link_n) == len(a) + len(b) - whole.n_groups


def test_each_sixteen_ranges_are_composed_where_they_are_made(spark, encoders):
    texts = ["word " * n for n in (1, 100, 1_000)]
    docs = docs_of(spark, texts).withColumn("_row", F.monotonically_increasing_id())
    rows = A.document_fragments(docs, chunk_bytes=20).collect()
    left = [math.ceil(math.ceil(len(f" {t}") / 20) / A.FAN_IN) for t in texts]
    assert sorted((r.doc_id, r.chunk, r.n_chunks) for r in rows) == [(i, k, n) for i, n in enumerate(left) for k in range(n)]


def test_few_small_files_are_written(spark, monkeypatch):
    """Each written file starts a process that counts an executor's memory twice for a moment."""
    files = {}

    def kept(df, label, *a):
        out = stored(df, label, *a)
        files[label] = len(out.inputFiles())
        return out

    stored = A.stored
    monkeypatch.setattr(A, "stored", kept)
    docs = docs_of(spark, [f"text {i} {'of more words ' * 4_000}" for i in range(20)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert A.link_scores(A.align(docs)).count() == 20
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(files) == {"fragments", "pairs"} and files["pairs"] <= spark.sparkContext.defaultParallelism


def test_query_matches_brute_force(spark, sf, encoders):
    kept = connect(sf).execute("SELECT doc_id, text FROM documents").fetchall()
    # links of token pairs are quadratic in the brute version: long texts count only by their digest
    (encode_a, bytes_a), (encode_b, bytes_b) = encoders
    docs_with, of = Counter(), {}
    for doc_id, text in kept:
        a, b = spans(exact_left(text), bytes_a), spans(encode_b([text])[0], bytes_b)
        links, i, j = [], 0, 0
        cuts = []
        while i < len(a) and j < len(b):
            links.append((a[i][0], b[j][0]))
            end_a, end_b = a[i][2], b[j][2]
            if end_a == end_b:
                cuts.append((i + 1, j + 1))
            i, j = i + (end_a <= end_b), j + (end_b <= end_a)
        grouped, begin = [], (0, 0)
        for cut in cuts:
            grouped.append("|".join(",".join(str(t[0]) for t in side[x:y]) for side, x, y in zip((a, b), begin, cut, strict=True)))
            begin = cut
        of[doc_id] = (len(a), len(b), len(cuts), links, hashlib.sha256(";".join(grouped).encode()).hexdigest())
        docs_with.update(set(links))
    most = defaultdict(int)
    for (x, _), n in docs_with.items():
        most[x] = max(most[x], n)
    expected = {
        d: (n_a, n_b, n, len(links), sum(docs_with[p] == most[p[0]] for p in links), sum(docs_with[p] for p in links), h)
        for d, (n_a, n_b, n, links, h) in of.items()
    }
    rows = op12_alignment(spark, sf).collect()
    found = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows}
    assert len(rows) == len(found) and found == expected
