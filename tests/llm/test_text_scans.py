"""Decontamination, secret scans, line dedup and suffix dedup against brute force."""

import hashlib
import re

import numpy as np
import pytest
from helpers import docs_of, lowered_words, sentences
from pyspark.sql import functions as F

from inkprint.llm import decontamination, lines, secrets, suffixes

BENCHMARK = "item_id long, text string, items string"


def brute_contamination(text, items, n=10):
    w, hit, held = lowered_words(text), set(), set()
    for item, t in items:
        own = lowered_words(t)
        size = min(n, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(w) - size + 1):
            if size and tuple(w[i : i + size]) in windows:
                hit.update(range(i, i + size))
                held.add(str(item))
    return len(w), len(hit), sorted(held)


@pytest.mark.parametrize("bound", [{}, {"max_broadcast": 3}, {"max_bytes": 100}])
def test_contamination_matches_brute_force(spark, bound):
    passages = sentences(1, 4, 30)
    items = [(10, passages[0]), (2, passages[1].upper()), (3, "Ünïque wörds"), (4, None), (5, "..."), (6, passages[0])]
    clean = sentences(2, 6, 50, vocabulary=100_000)
    first = passages[0].split()
    texts = [
        *clean, None, "", "?!", passages[0], f"{clean[0]} {passages[1]}, {clean[1]}", " ".join(first[:9]), "-".join(first[3:13]),
        "said ünïque WÖRDS, ünïque wörds", " ".join(first[:12] + ["gap"] + first[15:27]), " ".join(first * 40), "é È ünïque Wörds"
    ]
    docs = docs_of(spark, texts, at="x", hash="y", items="z")
    bench = spark.createDataFrame([(*i, "b") for i in items], BENCHMARK)
    found = decontamination.contamination(docs, bench, **bound)
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in found.collect()}
    assert got == {i: brute_contamination(t, items) for i, t in enumerate(texts)}
    assert all(r.n_hit == sum(s["to"] - s["from"] for s in r.hit_spans) for r in found.collect())


def test_a_large_set_of_windows_moves_no_text_with_the_places(spark):
    passages = sentences(21, 40, 14)
    bench = spark.createDataFrame([(i, p, "x") for i, p in enumerate(passages)], BENCHMARK)
    long = " ".join(sentences(22, 1, 20_000, vocabulary=50_000) + [passages[7]])
    texts = [long, passages[3], "own words only", None, "", long.upper(), *sentences(23, 20, 40, vocabulary=9_000)]
    docs = docs_of(spark, texts, _row="r", at="x", _window="w", length="l", items="i")
    for remove in ("documents", "spans"):
        few = decontamination.decontaminate(docs, bench, remove=remove).collect()
        many = decontamination.decontaminate(docs, bench, remove=remove, max_broadcast=5)
        assert many.columns == docs.columns and sorted(map(str, few)) == sorted(map(str, many.collect()))
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), "text")
    assert decontamination._narrow_places(numbered, [3, 10]).columns == ["_row", "length", "at", "hash"]
    empty = decontamination.decontaminate(docs_of(spark, []), bench, max_broadcast=5)
    assert empty.count() == 0


def test_a_window_that_many_items_hold_is_not_broadcast(spark):
    shared = sentences(24, 1, 10)[0]
    bench = spark.createDataFrame([(i, shared, "x") for i in range(3_000)], BENCHMARK)
    docs = docs_of(spark, [f"so {shared} on", "nothing here"])
    few = decontamination.contamination(docs, bench).collect()
    many = decontamination.contamination(docs, bench, max_bytes=10_000)
    assert sorted(map(str, few)) == sorted(map(str, many.collect()))
    assert {(r.doc_id, r.n_hit, r.n_items) for r in few} == {(0, 10, 3_000), (1, 0, 0)}


def test_words_of_documents_do_not_enter_the_aggregate(spark, monkeypatch):
    # beyond this many groups the aggregate sorts its input; it held every document's words, which spilled or ended the executor
    monkeypatch.setattr(decontamination, "stored", lambda df, label: df)
    passage = sentences(31, 1, 14)[0]
    bench = spark.createDataFrame([(i, passage, "x") for i in range(3)], BENCHMARK)
    texts = [*sentences(32, 40, 30), passage, f"a {passage} b {passage}", None, ""]
    found = decontamination.contamination(docs_of(spark, texts), bench)
    plan = found._jdf.queryExecution().optimizedPlan()
    nodes = [plan]
    for node in nodes:
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    by_row = [n for n in nodes if n.nodeName() == "Aggregate" and "_row" in n.groupingExpressions().toString()]
    assert by_row and all("_words" not in n.references().toString() for n in by_row)
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in found.collect()}
    assert got == {i: brute_contamination(t, [(k, passage) for k in range(3)]) for i, t in enumerate(texts)}


def test_decontaminate_cuts_spans_or_documents(spark):
    passage = sentences(4, 1, 12)[0]
    texts = ["clean text, Here", f"Before!  {passage.upper()}. After", None, passage]
    docs, bench = docs_of(spark, texts, _row="r"), spark.createDataFrame([(1, passage, "x")], BENCHMARK)
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2]
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench, remove="spans").collect()}
    assert cut == {0: texts[0], 1: "Before!  . After", 2: None, 3: ""}
    nothing = spark.createDataFrame([], BENCHMARK)
    assert decontamination.decontaminate(docs, nothing).count() == 4
    assert decontamination.contamination(docs_of(spark, []), bench).count() == 0


# either case of a letter is a-z or A-Z: no long s or Kelvin sign, hence re.ASCII below
BASE = {
    "assign": (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}


def brute_secrets(text):
    order, spans = list(BASE), []
    for kind, (pattern, group, least) in BASE.items():
        spans += [(m.start(), order.index(kind), m.end()) for m in re.finditer(pattern, text or "", re.ASCII) if len(m[group]) >= least]
    return ",".join(f"{order[k]}:{s}:{e}" for s, k, e in sorted(spans))


def test_base_secrets_match_brute_force(spark):
    key, digest = "AKIA" + "Q7" * 9, "0f" * 20
    texts = [
        None, "", "none here", f"PassWord = 'abc.def=' {digest}", "secret:token:abcdefgh token=x secret=token=abcdefgh", f"é𝄞 {key} {key}Z AKIAAKIA",
        f"token: \"{digest}\" api_key={digest[:23]} APIKEY:{digest[:24]}g", digest * 30 + "g" + digest, "password=" * 50 + "abcdef", "ſecret=abcdef",
        "\n".join(f"token={i:06d}" for i in range(700)),
    ]
    found = secrets.scan_secrets(docs_of(spark, texts, kind="k", row="r", start="s")).collect()
    assert {r.doc_id: r.base for r in found} == {i: brute_secrets(t) for i, t in enumerate(texts)}
    for r in found:
        kinds = [s.split(":")[0] for s in r.base.split(",") if s]
        assert [r.n_assign, r.n_access, r.n_hex] == [kinds.count(k) for k in BASE]


def test_weak_parts_need_their_complement(spark):
    key, weak, url = "AKIA" + "Q7" * 9, "Zz9/" * 10, "https://store.example.com/bucket"
    far = " word" * 200
    texts = [
        f"{key} and {weak}", weak, f"{weak}{far} {key}", f"{url} {key} {weak}", f"{url} {key}", f"{url} {weak}", f"{key}{far} {url} {weak}",
        f"{url} {key} token=abcdefg", f"{'x ' * 199}{weak} {'y ' * 190}{key}",
    ]
    found = {r.doc_id: [s.split(":")[0] for s in r.spans.split(",") if s] for r in secrets.scan_secrets(docs_of(spark, texts)).collect()}
    assert [("secret" in found[i], "endpoint" in found[i]) for i in range(len(texts))] == [
        (True, False), (False, False), (False, False), (True, True), (False, False), (False, False), (False, False), (False, True), (True, False),
    ]
    assert secrets.scan_secrets(docs_of(spark, [])).count() == 0


def test_repeated_rows_keep_a_row_each(spark):
    docs = docs_of(spark, ["token=abcdefg"] * 3 + ["x"], ids=[1, 1, None, 1])
    assert sorted((r.doc_id or -1, r.n_assign) for r in secrets.scan_secrets(docs).collect()) == [(-1, 1), (1, 0), (1, 1), (1, 1)]


def brute_lines(texts, least):
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")] for t in texts]
    count = {}
    for own in keys:
        for k in set(own):
            count[k] = count.get(k, 0) + 1
    out = []
    for t, own in zip(texts, keys):
        kept = [x for x, k in zip((t or "").split("\n"), own) if not k or count[k] < least]
        out.append((len(own), len(own) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches", [1, 7])
def test_line_dedup_matches_brute_force(spark, batches):
    texts = [f"Header\n{i}\n\n  footer \t" for i in range(12)] + ["HEADER\r", "header\nheader\nheader", None, "", "\n\n", "É\né\nfooter "]
    texts += [f"rare {i % 7}\nÉtude\nx" for i in range(9)] + ["étude\nX"]
    docs = docs_of(spark, texts, _row="r", _drop="d", n_lines="n", h1="h")
    rows = lines.dedup_lines(docs, batches=batches).collect()
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in rows}
    assert got == dict(enumerate(brute_lines(texts, 10)))
    assert [r._row for r in rows] == ["r"] * len(texts) and rows[0].__fields__.count("n_lines") == 1
    assert [r.text for r in rows if r.doc_id == texts.index(None)] == [None]


def test_runs_are_levelled_and_sorted(spark):
    runs = lines.LineRuns(spark, min_docs=3, fanout=2)
    for _ in range(5):
        runs.add(docs_of(spark, ["a\nb", "b\nc"]))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert runs.frequent().count() == 3
    for level in runs.levels:
        for run in level:
            # one sorted file a bucket
            files = {}
            for r in run.select("h1", "h2", F.input_file_name().alias("file")).collect():
                files.setdefault(r.file, []).append((r.h1, r.h2))
            assert len(files) <= runs.buckets and all(keys == sorted(keys) for keys in files.values())
    runs.drop()
    assert lines.dedup_lines(docs_of(spark, [])).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_are_merged_and_met_without_a_shuffle(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        runs = lines.LineRuns(spark, min_docs=3, fanout=3)
        for i in range(2):
            runs.add(docs_of(spark, [f"a\nb{i}\na", "b0\nc"]))
        assert "Exchange" not in plan_of(runs._merged(runs.levels[0])) and plan_of(runs._merged(runs.levels[0])).count("Scan parquet") == 2
        batch = lines.hash_lines(docs_of(spark, ["a\nd", "b0"]))
        # the batch is counted by one shuffle; either run stays where it is
        assert plan_of(runs._unseen(batch)).count("Exchange") == 1 and plan_of(runs._unseen(batch)).count("SortMergeJoin") == 2
        assert runs._unseen(batch).count() == 2  # b0 was in three documents; a in two
        runs.add_hashed(batch)
        assert [len(level) for level in runs.levels] == [0, 1] and runs.frequent().count() == 2
        names = list(runs._names)
        runs.drop()
        assert names and not any(spark.catalog.tableExists(n) for n in names)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_the_query_compacts_runs(spark, monkeypatch):
    levels = []
    compact = lines.LineRuns._compact

    def watched(self):
        compact(self)
        levels.append([len(level) for level in self.levels])

    monkeypatch.setattr(lines.LineRuns, "_compact", watched)
    docs = docs_of(spark, [f"head\n{i}" for i in range(30)])
    assert {r.n_dropped for r in lines.dedup_lines(docs).collect()} == {1}
    assert levels == [[1], [0, 1], [1, 1]]


def test_lines_of_a_megabyte(spark):
    long = "\n".join(f"own {i}" for i in range(120_000))
    texts = [f"{long}\nshared", *["shared"] * 9, "x" * 2_000_000]
    got = {r.doc_id: r for r in lines.dedup_lines(docs_of(spark, texts)).collect()}
    assert got[0].text == long and (got[0].n_lines, got[0].n_dropped) == (120_001, 1) and got[10].text == texts[10]


def test_repeated_rows_are_documents(spark):
    docs = docs_of(spark, ["same line\nown"] * 10, ids=[1] * 5 + [None] * 5)
    assert {(r.n_lines, r.n_dropped, r.text) for r in lines.dedup_lines(docs).collect()} == {(2, 2, "")}


def brute_repeats(texts, length):
    data, seen = [(t or "").encode() for t in texts], {}
    for b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in data:
        covered = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                covered[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        out.append((len(b), int(covered.sum()), runs, bytes(np.frombuffer(b, dtype=np.uint8)[~covered])))
    return out


@pytest.mark.parametrize(("length", "gram", "crowd"), [(40, 20, 1000), (40, 20, 2), (24, 12, 1000)])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, length, gram, crowd):
    monkeypatch.setattr(suffixes, "MAX_REGIONS", crowd)
    shared, own = sentences(8, 3, 20), sentences(9, 20, 15, vocabulary=5000)
    texts = [f"{a} {shared[i % 3]} {b}" for i, (a, b) in enumerate(zip(own, own[::-1]))] + [own[0]] * 3
    texts += [None, "", "a" * 200, "ab" * 90, "é" * 60, own[1][:39], shared[0][:40], "x" + shared[0][:39], "long " * 2000 + own[2]]
    texts += [own[3].replace("w1", "v1", 1), own[3].replace("w2", "v2", 1), own[3]]
    found = suffixes.remove_repeats(docs_of(spark, texts, row="r", spans="s", anchor="a"), length, gram).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found}
    assert got == dict(enumerate(brute_repeats(texts, length)))


def test_suffix_dedup_of_long_texts_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 64)
    texts = sentences(10, 3, 60) * 2 + sentences(11, 2, 80)
    got = {r.doc_id: r.n_removed for r in suffixes.remove_repeats(docs_of(spark, texts), 40, 20).collect()}
    assert got == {i: x[1] for i, x in enumerate(brute_repeats(texts, 40))}
    assert suffixes.remove_repeats(docs_of(spark, [])).count() == 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(12)
    for size in [1, 2, 3, 4, 5, 6, 7, 40, 200]:
        for letters in (1, 2, 5):
            for _ in range(10):
                s = rng.integers(1, letters + 1, size)
                assert list(suffixes.suffix_array(s)) == sorted(range(size), key=lambda i: tuple(s[i:]))


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(13)
    shared = rng.integers(97, 100, 40).astype(np.uint8)
    powers = suffixes._Powers(suffixes._BASE)
    prints = set()
    for n in range(0, 30, 3):
        text = np.concatenate([rng.integers(97, 123, n).astype(np.uint8), shared, rng.integers(97, 123, 9).astype(np.uint8)])
        anchor, _, low, starts = suffixes.anchored(text, powers, 40, 20)
        at = np.flatnonzero((low <= n) & (n < low + starts))
        prints.add(int(anchor[at[0]]))
        assert int(starts.sum()) == len(text) - 39
    assert len(prints) == 1


def test_kept_bytes_digest(spark):
    row = suffixes.remove_repeats(docs_of(spark, ["unique"])).first()
    assert hashlib.sha256(bytes(row.kept)).hexdigest() == hashlib.sha256(b"unique").hexdigest()
