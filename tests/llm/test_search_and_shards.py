"""Top-k search, sharding and packing."""

import zlib

import numpy as np
import pytest
from helpers import docs_of, sentences
from pyspark.sql import functions as F

from inkprint.llm import packing, sharding, topk

VECTORS = "vec_id long, embedding array<float>, label int, score string, _vector int"


def brute_top(rows, k):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vectors.setdefault(i, []).append([int(np.floor(1024 * float(np.float32(x)))) for x in v])
    out = []
    for q, own in vectors.items():
        if q % 100 == 0:
            scored = [(-sum(a * b for a, b in zip(own[0], v)), i) for i, vs in vectors.items() if i != q for v in vs]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [3, 1000])
def test_top_k_matches_brute_force(spark, block):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(240)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, [float("inf")]), (304, []), (305, rows[5][1]), (400, [0.5]), (None, [1.0])]
    rows += [rows[7]]
    frame = spark.createDataFrame([(*r, None, "x", 1) for r in rows], VECTORS)
    found = topk.top_k(frame, F.col("vec_id") % 100 == 0, 10, query_block=2 if block == 3 else 1000, candidate_block=block * 10)
    assert sorted(tuple(r) for r in found.collect()) == brute_top(rows, 10)


def test_top_k_of_an_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0).count() == 0


def test_capacity_tree_finds_the_tightest():
    tree, held, rng = sharding.CapacityTree(), set(), np.random.default_rng(1)
    for step in range(2000):
        key = (int(rng.integers(0, 60)), step)
        tree.add(key)
        held.add(key)
        if step % 3 == 0:
            gone = sorted(held)[int(rng.integers(0, len(held)))]
            tree.remove(gone)
            held.remove(gone)
        size = int(rng.integers(0, 70))
        assert tree.tightest(size) == min((k for k in held if k[0] >= size), default=None)


def naive_best_fit(sizes, capacity):
    left, placed = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(room, b) for b, room in enumerate(left) if room >= sizes[i]]
        if fits:
            placed[i] = min(fits)[1]
        else:
            placed[i] = len(left)
            left.append(capacity)
        left[placed[i]] -= sizes[i]
    return placed


def test_best_fit_decreasing_matches_a_scan_of_all_bins():
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.integers(1, 100, 500)] + [150, 100]
    assert sharding.best_fit_decreasing(sizes, 100) == naive_best_fit(sizes, 100)
    assert max(sharding.pack_into(sizes, 8)) <= 7


def test_shards_keep_groups_and_are_even(spark):
    texts = sentences(3, 400, 40) + ["the same again"] * 90 + [None, "", "é" * 50, "x" * 20_000]
    placed = sharding.shard_documents(docs_of(spark, texts, shard="s", slot="t", group="u"), n_shards=8).collect()
    assert sorted(r.doc_id for r in placed) == list(range(len(texts)))
    where = {}
    for r in placed:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        where.setdefault(data, set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    for shard in range(8):
        slots = sorted(r.slot for r in placed if r.shard == shard)
        assert slots == list(range(len(slots)))
    sizes = np.bincount([r.shard for r in placed], weights=[r["size"] for r in placed], minlength=8)
    rest = np.delete(sizes, sizes.argmax())
    assert sizes.max() <= 21_000 and rest.max() - rest.min() <= 400


def test_shards_of_fixed_capacity_and_of_nothing(spark):
    docs = docs_of(spark, ["a" * 9] * 3 + ["b" * 14, "c" * 4], ids=[1, 1, None, 4, 5])
    placed = sharding.shard_documents(docs, n_shards=None, capacity=30).collect()
    assert len(placed) == 5 and {r.shard for r in placed} == {0, 1}
    assert len({r.shard for r in placed if r["size"] == 10}) == 1
    assert sharding.shard_documents(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("per_chunk", [200, 16])
def test_no_shard_exceeds_the_capacity(spark, monkeypatch, per_chunk):
    # many more groups than max_chunks, in one run or in many, gathered by hash where they are small
    monkeypatch.setattr(sharding, "RUN_PER_CHUNK", per_chunk, raising=False)
    texts = [f"{i:05d}" + "x" * (i * 7 % 60) for i in range(1500)] + ["y" * 6_000, "z" * 300] + ["same"] * 40
    placed = sharding.shard_documents(docs_of(spark, texts), n_shards=None, capacity=4_000, max_chunks=10).collect()
    assert sorted(r.doc_id for r in placed) == list(range(len(texts)))
    sizes = np.bincount([r.shard for r in placed], weights=[r["size"] for r in placed])
    assert sorted(sizes)[-1] == 6_001 and sorted(sizes)[-2] <= 4_000
    # one underfull shard for each run of 160 or 2,000 items
    assert len(sizes) <= 1 + -(-(sizes.sum() - 6_001) // 4_000) + 1600 // (10 * per_chunk) + 1
    assert len({r.shard for r in placed if texts[r.doc_id] == "same"}) == 1


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*exact.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_packing_places_every_id_once(spark):
    texts = sentences(5, 60, 150) + [None, "", "plain <|endoftext|> text", "naïve Ångström — 東京　 x", "long " * 3000, "tab\tnew\r\nline  "]
    ids = reference_ids(texts)
    placed = packing.best_fit_packing(docs_of(spark, texts, sequence_id="x", length="y"), window=256, keep_ids=True, group_pieces=40).collect()
    by_doc, by_sequence = {}, {}
    for r in placed:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) and len(r.ids) == r.length
    for i, own in enumerate(ids):
        cut = sorted(by_doc[i], key=lambda r: r.piece)
        assert [x for r in cut for x in r.ids] == own
        assert [r.piece for r in cut] == list(range(len(cut))) and all(r.length == 256 for r in cut[1:])
        assert [r.start for r in cut] == list(np.cumsum([0, *[r.length for r in cut[:-1]]]))
    for held in by_sequence.values():
        held.sort(key=lambda r: r.offset)
        ends = list(np.cumsum([r.length for r in held]))
        assert [r.offset for r in held] == [0, *ends[:-1]] and ends[-1] <= 256


def test_packing_without_ids_and_of_nothing(spark):
    docs = docs_of(spark, ["a b c", "a b c", None], ids=[3, 3, None])
    found = packing.best_fit_packing(docs)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted(r.offset for r in found.collect()) == [0, 1, 5] or found.agg(F.sum("length")).first()[0] == 9
    assert packing.best_fit_packing(docs_of(spark, [])).count() == 0


def test_local_search_empties_bins():
    # best fit leaves 6+5, 4+4+4 open; exchanges reach three full bins of 12
    rng = np.random.default_rng(4)
    for _ in range(30):
        lengths = rng.integers(200, 700, 80)
        bins = packing.Bins(lengths, 1024)
        for item in np.argsort(-lengths, kind="stable"):
            bins.place(int(item))
        before = sum(f * f for f in bins.fill)
        packing.local_search(bins)
        assert sum(f * f for f in bins.fill) >= before and max(bins.fill) <= 1024
        assert sorted(i for held in bins.items for i in held) == list(range(80))
        assert all(f == sum(lengths[i] for i in held) for f, held in zip(bins.fill, bins.items))
    # best fit needs three bins here, an exchange empties one of them
    lengths = np.array([6, 5, 4, 3, 2])
    assert len(packing.pack_lengths(lengths, 10)) == 2


def test_local_search_ends_only_where_no_step_is_left():
    rng = np.random.default_rng(11)
    for _ in range(60):
        lengths = rng.integers(100, 800, 60)
        bins = packing.Bins(lengths, 1024)
        for item in np.argsort(-lengths, kind="stable"):
            bins.place(int(item))
        packing.local_search(bins)
        fills, held = list(bins.fill), [set(x) for x in bins.items]
        packing.local_search(bins)
        assert fills == bins.fill and held == bins.items
        # no move, one-for-one or two-for-one exchange into a bin as full or fuller
        open_bins = [b for b, f in enumerate(bins.fill) if 0 < f < 1024]
        for a in open_bins:
            own = [int(lengths[i]) for i in bins.items[a]]
            out = own + [x + y for n, x in enumerate(own) for y in own[n + 1 :]]
            for b in open_bins:
                if a != b and bins.fill[a] <= bins.fill[b]:
                    room = 1024 - bins.fill[b]
                    assert not any(x <= room for x in own)
                    assert not any(0 < x - int(lengths[i]) <= room for x in out for i in bins.items[b])


def test_bins_of_equal_lengths_are_packed_alike():
    lengths = np.array([300] * 10 + [424] * 5 + [1023, 1])
    first, second = packing.pack_lengths(lengths, 1024), packing.pack_lengths(lengths, 1024)
    assert first == second and sorted(i for held in first for i in held) == list(range(17))
    assert len(first) == 6 and [15, 16] in first
