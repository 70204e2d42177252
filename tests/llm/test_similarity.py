"""N-gram join, components, toxicity and language identification."""

import math
import random
import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from helpers import docs_of, grams, sentences
from pyspark.sql import functions as F

from inkprint.llm import graphs, language, near_duplicates, toxicity


def edited(text, seed, edits):
    rng, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def brute_links(texts, threshold=0.8):
    sets = [grams(t) for t in texts]
    links = [set() for _ in texts]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= threshold * len(a | b):
                links[i].add(j)
                links[j].add(i)
    return links


def brute_classes(links):
    least = list(range(len(links)))
    for start in range(len(links)):
        stack = [start] if least[start] == start else []
        while stack:
            x = stack.pop()
            for y in links[x]:
                if least[y] > start:
                    least[y] = start
                    stack.append(y)
    return least


@pytest.fixture(scope="module")
def similar_texts():
    base = sentences(21, 12, 160, vocabulary=3000)
    texts = [edited(t, 7 * i + k, k) for i, t in enumerate(base) for k in (0, 1, 2, 4, 9)]
    texts += [base[0], base[0].upper(), base[0] + "!"] + [edited(base[1], 900 + k, k % 4) for k in range(40)]
    return texts + [None, "", "?!", "two words", "Two, words", "one two three four", base[2] + " " + base[3], base[2] * 30, base[2] * 30 + " end"]


@pytest.mark.parametrize("block", [8, 512])
def test_join_matches_brute_force(spark, monkeypatch, similar_texts, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    links = brute_links(similar_texts)
    classes = brute_classes(links)
    sets = [grams(t) for t in similar_texts]
    found = near_duplicates.similarity_join(docs_of(spark, similar_texts, row="r", bucket="b", class_row="c")).collect()
    got = {r.doc_id: (r.class_id, r.n_links, r.n_linked_texts) for r in found}
    near = [len({frozenset(sets[j]) for j in own if sets[j] != sets[i]}) for i, own in enumerate(links)]
    assert got == {i: (classes[i], len(links[i]), near[i]) for i in range(len(similar_texts))}


def test_open_members_are_compared_without_leaders(spark, monkeypatch, similar_texts):
    # no star round at all: block comparison alone must connect the same classes
    monkeypatch.setattr(near_duplicates, "STAR_ROUNDS", 1)
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)
    classes = brute_classes(brute_links(similar_texts))
    found = near_duplicates.similarity_join(docs_of(spark, similar_texts)).collect()
    assert {r.doc_id: r.class_id for r in found} == dict(enumerate(classes))


def test_pairs_behind_a_failed_pair_are_met_again(spark, monkeypatch):
    # equal signatures promise that all are similar; the sets of four groups say otherwise
    monkeypatch.setattr(near_duplicates, "STAR_ROUNDS", 1)
    base = sentences(8, 4, 100, vocabulary=3000)
    texts = [edited(base[i % 4], i, 1) for i in range(16)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    marks = rows.select("row", F.lit(bytes(252)).alias("signature"))
    found = near_duplicates.links(rows.select(F.lit(1).cast("long").alias("bucket"), "row"), marks, rows).collect()
    assert {r.node: r.component for r in found} == {i: i % 4 for i in range(16)}


def test_a_lower_threshold_has_bands_for_it(spark):
    base = sentences(31, 30, 160, vocabulary=3000)
    texts = base + [edited(t, 50 + i, 9) for i, t in enumerate(base)]
    links = brute_links(texts, 0.5)
    found = near_duplicates.similarity_join(docs_of(spark, texts), threshold=0.5).collect()
    assert sum(map(len, links)) >= 40
    assert {r.doc_id: (r.class_id, r.n_links) for r in found} == {i: (c, len(links[i])) for i, c in enumerate(brute_classes(links))}


def test_one_of_each_class_stays(spark, similar_texts):
    docs = docs_of(spark, similar_texts, row="r", _row="s", _all="t")
    kept = near_duplicates.deduplicate(docs)
    classes = brute_classes(brute_links(similar_texts))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(classes))
    repeated = docs_of(spark, ["a b c d e f"] * 4, ids=[5, None, 3, 3])
    assert [r.doc_id for r in near_duplicates.deduplicate(repeated).collect()] == [3]
    assert near_duplicates.deduplicate(docs_of(spark, [])).count() == 0
    assert near_duplicates.similarity_join(docs_of(spark, [])).count() == 0


def test_bands_reach_the_target_recall():
    n = near_duplicates.bands_for(0.8, 0.998, 6)
    assert 1 - (1 - 0.8**6) ** n >= 0.998 > 1 - (1 - 0.8**6) ** (n - 1)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)]
    nodes = sorted({x for e in edges for x in e})
    place = {x: i for i, x in enumerate(nodes)}
    links = [set() for _ in nodes]
    for a, b in edges:
        if a != b:
            links[place[a]].add(place[b])
            links[place[b]].add(place[a])
    least = brute_classes(links)
    found = graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {x: nodes[least[i]] for x, i in place.items() if links[i]}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_marginals(emission, transition):
    n, weights = len(emission), {}
    for tags in np.ndindex(*[2] * n):
        score = sum(e for e, t in zip(emission, tags) if t) + sum(transition[a][b] for a, b in zip(tags, tags[1:]))
        weights[tags] = np.exp(score)
    total = sum(weights.values())
    return [sum(w for t, w in weights.items() if t[i]) / total for i in range(n)], {
        (a, b): sum(w * sum(x == (a, b) for x in zip(t, t[1:])) for t, w in weights.items()) / total for a in (0, 1) for b in (0, 1)
    }


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(6)
    lengths = np.array([3, 1, 7, 5, 1, 4])
    emission, transition = rng.normal(size=lengths.sum()), rng.normal(size=(2, 2))
    odds = toxicity.chain_marginals(emission, lengths, transition)
    ends = np.cumsum(lengths)
    pairs = np.zeros((2, 2))
    for end, n in zip(ends, lengths):
        single, double = brute_marginals(emission[end - n : end], transition)
        assert np.allclose(1 / (1 + np.exp(-odds[end - n : end])), single)
        pairs += np.array([[double[a, b] for b in (0, 1)] for a in (0, 1)])
    first = np.zeros(len(emission), dtype=bool)
    first[ends - lengths] = True
    assert np.allclose(toxicity._pair_marginals(emission, odds, lengths, np.flatnonzero(~first), transition), pairs)
    assert len(toxicity.chain_marginals(np.zeros(0), np.zeros(0, dtype=np.int64), transition)) == 0


def toxic_documents(count, seed):
    rng, out = random.Random(seed), []
    insults = [f"vile{e}" for e in ("us", "ant", "or", "en", "ix")] + ["scorn"]
    for i in range(count):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(10, 80))]
        toxic = int(i % 6 == 0)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        out.append((i, " ".join(words), toxic))
    return out


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_documents(600, 1)
    train = spark.createDataFrame(rows[:400], "id long, text string, toxic int")
    model = toxicity.fit_toxicity(train.unionByName(spark.createDataFrame([(9, "x", None), (8, None, 0)], train.schema)))
    texts = [t for _, t, _ in rows[400:]] + [None, "", "?!", "VILEOUS words Vilest scorn", "long clean " * 5000]
    scored = {r.doc_id: r for r in toxicity.tag(docs_of(spark, texts, score="s", spans="x"), model).collect()}
    truth = [y for _, _, y in rows[400:]] + [0, 0, 0, 1, 0]
    assert len(scored) == len(texts) and all(0 <= r.score <= 1 for r in scored.values())
    wrong = [i for i, y in enumerate(truth) if (scored[i].score >= 0.5) != bool(y)]
    assert len(wrong) <= 4 and not set(wrong) & set(range(200, 205))
    assert {texts[203][s.start : s.end] for s in scored[203].spans} >= {"VILEOUS", "Vilest"}
    assert toxicity.tag(docs_of(spark, []), model).count() == 0


def test_toxicity_without_labels(spark):
    model = toxicity.fit_toxicity(spark.createDataFrame([], "id long, text string, toxic int"))
    assert [r.score for r in toxicity.tag(docs_of(spark, ["a b"]), model).collect()] == [0.5]


def test_held_out_rows_are_those_of_the_contract(spark):
    import zlib

    rows = spark.range(200).select("id", toxicity.is_held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


FIELDS = "id long, text string, declared string, host string, domain string, suffix string"


@pytest.fixture(scope="module")
def text_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text", "lang")
    return language.fit_text_model(docs)


def test_languages_of_documents_and_pages(spark, sf, text_model):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = language.identify(language.document_fields(docs), text_model).join(docs.where("n_chars > 60"), F.col("id") == F.col("doc_id"))
    assert found.where("NOT kept").count() == 0
    assert found.where("language <> lang").count() <= 0.02 * found.count()
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    called = language.identify(language.page_fields(pages), text_model)
    declared = pages.select("page_id", F.regexp_extract("html", 'lang="(..)"', 1).alias("d"))
    assert called.join(declared, F.col("id") == F.col("page_id")).where("language <> d").count() <= 0.02 * pages.count()


def test_evidence_decides_where_text_does_not(spark, text_model):
    german = "der die das und nicht"
    rows = [(i, "Der, und das. Sch dieer. Chver. " * 6, "de", "a.example.de", "example.de", "de") for i in range(30)]
    rows += [(50, "e", "de", "a.example.de", "example.de", "de"), (51, "e", "en", "b.test.com", "test.com", "com"), (52, "e", None, None, None, None)]
    rows += [(53, None, "de", "a.example.de", None, None), (54, "", None, None, None, None), (55, "12 !! 34", "en", None, None, None), (56, german, "xx", "n", "n", "n")]
    rows += [(57, "zqxj kvwqz xqzzj qjxvk " * 20, "en", None, None, None), (50, "e", "de", "a.example.de", "example.de", "de")]
    found = language.identify(spark.createDataFrame(rows, FIELDS), text_model).collect()
    assert len(found) == len(rows)
    by = {r.id: r for r in found}
    assert by[50].language == "de" and by[51].language == "en" and by[0].kept and by[56].language == "de"
    assert all(by[i].language == "und" and not by[i].kept for i in (53, 54, 55, 57))
    assert by[52].posterior < 1
    assert language.identify(spark.createDataFrame([], FIELDS), text_model).count() == 0


def test_page_fields(spark):
    html = '<HTML class=x Lang="FR-ca"><script>var no = 1;</script><p>oui&amp;<!-- non --></p></html>'
    pages = [(1, "https://u:p@WWW.Example.co:80/x?y", html), (2, None, None), (3, "nothing", "plain")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.id: r for r in language.page_fields(frame).collect()}
    assert (found[1].declared, found[1].host, found[1].domain, found[1].suffix) == ("fr", "www.example.co", "example.co", "co")
    assert found[1].text.split() == ["oui"] and found[2].host is None and found[3].declared is None


def test_pages_of_a_megabyte_are_read_in_one_pass(spark):
    unclosed = ["<script " * 130_000, "<html lang " * 90_000, "<!-- <style " * 85_000, "&a" * 500_000, "<" * 1_000_000, "<p" * 500_000]
    pages = [(i, "https://www.a.co.uk/", f"<p>word{i}</p>" + html) for i, html in enumerate(unclosed)]
    pages.append((9, "https://b.com/", "<html lang=de><script>a</script >x < y <b>z</b><style>c</style>" + " wort" * 200_000))
    begin = time.monotonic()
    found = {r.id: r for r in language.page_fields(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert time.monotonic() - begin < 60
    assert all(found[i].text.split()[0].startswith(f"word{i}") for i in range(len(unclosed)))
    assert (found[0].host, found[0].domain, found[0].suffix) == ("www.a.co.uk", "a.co.uk", "co.uk")
    assert found[9].declared == "de" and found[9].text.split()[:4] == ["x", "<", "y", "z"] and found[9].text.count("wort") == 200_000
    assert found[0].text.split() == ["word0"]


def test_languages_are_those_that_rows_declare(spark):
    stems = {"aa": "bado keru misa", "bb": "zuff yorg wext", "cc": "quill shran plov", "rare": "ixis oxos uxus"}
    rows = [(f"{lang}{i}", f"{words} " * 8, lang) for lang, words in stems.items() for i in range(300 if lang != "rare" else 6)]
    rows += [(f"t{i}", "typo " * 9, f"typo{i}") for i in range(4)] + [("u", "und", "und")] * 9 + [("n", "no", None), ("e", "", ""), ("x", None, "aa")]
    docs = spark.createDataFrame(rows, "id string, text string, lang string")
    model = language.fit_text_model(docs)
    assert model.languages == ("aa", "bb", "cc", "rare")
    fields = docs.select("id", "text", *[F.lit(None).cast("string").alias(c) for c in ("declared", "host", "domain", "suffix")])
    found = language.identify(fields, model).join(docs, "id").where("lang IN ('aa', 'bb', 'cc', 'rare') AND text IS NOT NULL")
    assert found.count() == 906 and found.where("language <> lang OR NOT kept").count() == 0
    # a sample so small that each language has some three rows
    assert language.fit_text_model(docs, fit_rows=100).languages == model.languages
    nothing = language.fit_text_model(docs.where("false"))
    assert nothing.languages == () and language.identify(fields, nothing).where("language = 'und' AND NOT kept").count() == len(rows)


def brute_posteriors(rows, k, weight=language.PRIOR_WEIGHT):
    """log posteriors of (evidence, n_grams, declared, host, domain, suffix) rows from counts kept in dictionaries."""
    called = [max(range(k), key=lambda i: (e[i], -i)) if n else k - 1 for e, n, *_ in rows]
    overall = [called.count(i) + 0.5 for i in range(k)]
    total = sum(overall)

    def counts(key, value):
        own = [0.0] * k
        for row, best in zip(rows, called):
            if row[key] == value:
                own[best] += 1
        return own

    out = []
    for evidence, n, declared, host, domain, suffix in rows:
        fused = list(evidence)
        for key, value in ((2, declared), (5, suffix)):
            if value is not None:
                own = counts(key, value)
                fused = [f + math.log((c + weight * sum(own) / total) / (m + weight)) for f, c, m in zip(fused, own, overall)]
        prior = [m / total for m in overall]
        if host is not None and domain is not None:
            for key, value in ((4, domain), (3, host)):
                own = counts(key, value)
                prior = [(c + weight * p) / (sum(own) + weight) for c, p in zip(own, prior)]
        fused = [f + math.log(p) for f, p in zip(fused, prior)]
        top = max(fused)
        out.append((fused.index(top), 1 / sum(math.exp(f - top) for f in fused), n))
    return out


def test_fused_posteriors_match_brute_force(spark, sf, text_model):
    docs = language.document_fields(spark.read.parquet(f"{sf}/documents.parquet"))
    pages = language.page_fields(spark.read.parquet(f"{sf}/pages.parquet"))
    odd = spark.createDataFrame(
        [(-1, None, "de", "h", "d", "x"), (-2, "", None, None, None, None), (-3, "der und die", None, "h", None, "x"), (-3, "the of and", "xx", "h", "d", None)],
        FIELDS,
    )
    for fields in (docs, pages.unionByName(odd)):
        carried = ("id", "declared", "host", "domain", "suffix")
        told = language.text_evidence(fields, text_model, carried).collect()
        rows = [(r.log_likelihood, r.n_grams, r.declared, r.host, r.domain, r.suffix) for r in told]
        names = [*text_model.languages, "und"]
        wanted = sorted(
            (r.id, names[best] if n else "und", round(p, 4) if n else 1.0)
            for r, (best, p, n) in zip(told, brute_posteriors(rows, len(names)))
        )
        got = sorted((r.id, r.language, round(r.posterior, 4)) for r in language.identify(fields, text_model).collect())
        assert [g[:2] for g in got] == [w[:2] for w in wanted]
        assert np.allclose([g[2] for g in got], [w[2] for w in wanted], atol=2e-4)


def test_a_block_of_near_copies_takes_little_memory():
    """Every pair of two full blocks is likely and none is sure: all are offered, and held as numbers only."""
    rng = np.random.default_rng(5)
    common, n = rng.integers(0, 2**16, 126), 2 * near_duplicates.BLOCK
    marks = np.where(rng.random((n, 126)) < 0.86, common, rng.integers(0, 2**16, (n, 126))).astype("<u2")
    group = pd.DataFrame({"bucket": 7, "row": np.arange(n) * 3, "signature": [m.tobytes() for m in marks], "_i": 0, "_j": 1, "_block": np.arange(n) % 2})
    tracemalloc.start()
    found = near_duplicates._similar_within(0.8)(group)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    agree = (marks[::2, None] == marks[None, 1::2]).mean(axis=2)
    x, y = np.nonzero((agree >= 0.8 - near_duplicates.MARGIN) & (agree < 0.8 + near_duplicates.MARGIN / 2))
    assert (agree < 0.8 + near_duplicates.MARGIN / 2).all() and len(x) > 0.99 * near_duplicates.BLOCK**2
    assert {*zip(found["a"], found["b"])} == {(min(a, b), max(a, b)) for a, b in zip(x * 6, y * 6 + 3)}
    assert not found["sure"].any() and len(found) == len(x)
    assert peak < 40e6


def test_a_small_graph_is_written_as_one_file(spark):
    """However many partitions a shuffle has; the result is that of any number of files."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        links = [(i, i + 7) for i in range(100)] + [(500, 501)]
        found = graphs.components(spark.createDataFrame(links, "a long, b long"))
        assert len(found.inputFiles()) == 1 and found.rdd.getNumPartitions() == 1
        expected = {i: i % 7 for i in range(107)} | {500: 500, 501: 500}
        assert sorted(found.collect()) == sorted(expected.items())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
