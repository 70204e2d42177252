"""Files in and out."""

import json

import pytest
from pyspark.sql import functions as F

from inkprint.functions.pysyntax import function_table
from inkprint.operators import corpus as C
from inkprint.sources import files

LONG = "def long(a):\n" + "".join(f"    x{i} = a\n" for i in range(6)) + "    return a\n"


def test_problem_array(spark, tmp_path):
    problems = [{"id": "p1", "statement": "one\ntwo"}, {"id": "p2", "statement": "ünï"}]
    (tmp_path / "problems.json").write_text(json.dumps(problems, indent=2))
    rows = files.read_problems(spark, str(tmp_path / "problems.json")).collect()
    assert [r.asDict() for r in rows] == problems


def test_jsonl_skips_blank_lines_and_fails_on_bad_ones(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"id": "1", "code": "x", "label": 0}\n\n{"id": "2", "code": null, "label": 1}\n')
    rows = files.read_jsonl(spark, str(good)).collect()
    assert [(r.id, r.code, r.source_file) for r in rows] == [("1", "x", None), ("2", None, None)]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id": "1"}\n{"id": \n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(bad)).collect()


def test_csv_keeps_the_code(spark, tmp_path, programs):
    rows = programs.withColumn("code", F.concat("code", F.lit(' "q", \\ \n\n')))
    files.write_csv(rows, str(tmp_path / "csv"))
    back = files.read_csv(spark, str(tmp_path / "csv"), "id string, k int, code string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_source_tree_to_snippets(spark, tmp_path):
    nested = tmp_path / "pkg" / "deep"
    nested.mkdir(parents=True)
    (nested / "a.py").write_bytes(LONG.replace("\n", "\r\n").encode() + b"# \xff\xfe end\n")
    (nested / "broken.py").write_text("def f(:\n")
    (tmp_path / "b.txt").write_text(LONG)
    tree = files.read_source_tree(spark, str(tmp_path))
    assert tree.count() == 2
    found = C.human_snippets(function_table(tree)).collect()
    assert [r.code for r in found] == [LONG.rstrip("\n")]
    assert found[0].id.startswith("human_") and len(found[0].id) == 18
    assert found[0].problem_id is None and found[0].source_file.endswith("a.py")
    assert C.limit_snippets(C.human_snippets(function_table(tree)), 1).count() == 1


def test_other_languages_give_no_snippets(spark, tmp_path):
    (tmp_path / "A.java").write_text("class A {}\n")
    tree = files.read_source_tree(spark, str(tmp_path), "java")
    assert tree.count() == 1 and function_table(tree).count() == 0


def test_dataset_layout_prunes_splits(spark, tmp_path):
    rows = [(str(i), i % 2, f"c{i}") for i in range(100)]
    human = spark.createDataFrame(rows[::2], "id string, label int, code string")
    ai = spark.createDataFrame(rows[1::2], "id string, label int, code string")
    path = str(tmp_path / "dataset")
    C.write_dataset(C.prepare_dataset(human, ai), path)
    test = C.in_split(spark.read.parquet(path), "test")
    assert test.count() == 15
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_metrics_sink(spark, tmp_path):
    df = spark.createDataFrame([("m", 0.5, [[1, 2], [3, 4]])], "model string, f1 double, confusion_matrix array<array<bigint>>")
    files.write_metrics(df, str(tmp_path / "m"))
    line = json.loads(spark.read.text(str(tmp_path / "m")).first().value)
    assert line == {"model": "m", "f1": 0.5, "confusion_matrix": [[1, 2], [3, 4]]}


def test_requests_and_completions(spark):
    problems = spark.createDataFrame([("p1", "s1"), ("p2", "s2")], "id string, statement string")
    requests = C.generate_requests(problems, ["python"], ["m0", "nobody"], ["m0", "m1"])
    assert {r.id for r in requests.collect()} == {"p1_python_m0", "p2_python_m0"}
    answers = spark.createDataFrame([("p1_python_m0", "```\nx = 1\n```")], "id string, completion string")
    rows = C.attach_completions(requests, answers).collect()
    assert [(r.id, r.label, r.code) for r in rows] == [("p1_python_m0", 1, "x = 1")]
    assert [r.id for r in C.failed_requests(requests, answers).collect()] == ["p2_python_m0"]
