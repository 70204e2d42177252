"""The pipeline: every stage against brute force on what its predecessor kept, and on odd input."""

from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from helpers import docs_of, grams, sentences
from test_search_and_shards import reference_ids
from test_text_scans import brute_contamination, brute_lines

from inkprint.storage import stored

BENCH = "item_id long, text string"


def brute_least_ids(rows):
    """Ids that stay of (doc_id, text): the least of each class that links of 0.8 connect."""
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                parent[root(i)] = root(j)
    classes = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        classes[root(i)].append(doc_id)
    return sorted(min(ids) for ids in classes.values())


@pytest.fixture(scope="module")
def planted(spark, sf, tmp_path_factory):
    """(folder, ids of the planted documents): given documents, and copies, near copies, shared lines, leaks and rejects among them."""
    folder = str(tmp_path_factory.mktemp("tables"))
    given = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    long = [r for r in given if len(r.text) > 400]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in given]
    leak = " ".join(sentences(31, 1, 14))
    words = long[1].text.split()
    extra = {
        "copy": [(1_000_001, long[0].text, long[0].lang), (1_000_001, long[0].text, long[0].lang)],
        "near": [(1_000_002, " ".join([*words[:-1], "elsewhere"]), long[1].lang)],
        "lines": [(1_000_100 + i, f"Subscribe Now\n{r.text}\n  subscribe now ", r.lang) for i, r in enumerate(long[2:14])],
        "leak": [(1_000_200, f"{long[14].text} {leak.upper()}. {long[15].text}", long[14].lang)],
        "reject": [(1_000_300, None, "en"), (1_000_301, "", None), (1_000_302, "12 34 !!", "en"), (1_000_303, "zqxj kvwqz xqzzj qjxvk " * 40, None)],
        "long": [(1_000_400, " ".join(r.text for r in given if r.lang == "en") * 4, "en")],
    }
    rows += [(i, t, lang, None, None) for own in extra.values() for i, t, lang in own]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None), (3, "")], BENCH).write.parquet(f"{folder}/benchmark.parquet")
    return folder, {name: {i for i, *_ in own} for name, own in extra.items()}


def test_every_stage_matches_brute_force(spark, planted):
    folder, ids = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        docs = stored(stage(spark, docs, folder), f"test-{name}")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        steps[name] = before, sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    before, after = steps["language_id"]
    assert {i for i, _ in before} - {i for i, _ in after} >= ids["reject"]
    assert {i for i, t in before if t and len(t) > 200} - ids["reject"] <= {i for i, _ in after}
    before, after = steps["line_dedup"]
    kept = [t for _, _, t in brute_lines([t for _, t in before], 10)]
    assert after == sorted(((i, t) for (i, _), t in zip(before, kept, strict=True)), key=str) and before != after
    before, after = steps["near_duplicates"]
    assert sorted(i for i, _ in after) == brute_least_ids(before)
    assert not {i for i, _ in after} & (ids["copy"] | ids["near"] | ids["lines"])
    before, after = steps["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert after == [(i, t) for i, t in before if not brute_contamination(t, items)[1]]
    assert {i for i, _ in before} - {i for i, _ in after} == ids["leak"]
    # the last stage, through run() over the same tables
    placed = corpus_pipeline.run(spark, folder).collect()
    wanted = {i: len(own) for (i, _), own in zip(after, reference_ids([t for _, t in after]), strict=True)}
    lengths, sequences = defaultdict(int), defaultdict(list)
    for r in placed:
        lengths[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert dict(lengths) == wanted and ids["long"] <= set(wanted)
    for held in sequences.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(sequences) <= 1.05 * sum(wanted.values()) / 1024 + 2


def test_stages_on_nulls_repeats_clashes_and_nothing(spark, planted):
    folder, _ = planted
    text = "the house and the garden are old but the door is new and the roof was made by them " * 3
    rows = [(None, text, "en"), (5, text, "en"), (5, text, "en"), (6, None, None), (7, "", "en"), (8, "Wörter und Sätze in einem Buch " * 9, None)]
    clashing = {c: c for c in ("_row", "_all", "row", "id", "n_lines", "at", "sequence_id", "_batch", "language")}
    for count in (len(rows), 0):
        docs = docs_of(spark, [t for _, t, _ in rows[:count]], ids=[i for i, *_ in rows[:count]], **clashing)
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, docs, folder)
            kept = sorted((str(r.doc_id) for r in out.collect()))
            if name != "packing":
                assert set(corpus_pipeline.COLUMNS) <= set(out.columns)
            if name == "near_duplicates":
                assert kept == (["5", "6", "7", "8"] if count else [])
            else:
                assert kept == sorted(str(i) for i, *_ in rows[:count])
        # no row declares a language here: all are undetermined and go
        assert corpus_pipeline.STAGES[0][1](spark, docs, folder).count() == 0
