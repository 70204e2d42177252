"""Arrays read in many tasks: the same rows as a whole-file reader, wherever ranges end."""

import json
import random

import pytest

from inkprint.sources import files
from inkprint.sources import json_arrays as JA

SCHEMA = "id string, statement string, nested struct<a: array<int>, b: map<string, string>>"
NASTY = ['quote " and \\ slash', "}{][,", '\\"}', "ünï }😀", "line\nbreak", "", "\\\\", '{"id": "x"}', "]", "tab\t\\u0022}"]


def problems(n, seed=0):
    rng = random.Random(seed)
    return [
        {"id": f"p{i}", "statement": rng.choice(NASTY) * rng.randrange(1, 4), "nested": {"a": [i, 2], "b": {rng.choice(NASTY): "}"}}}
        for i in range(n)
    ]


def rows_of(df):
    return sorted((json.dumps(r.asDict(recursive=True), sort_keys=True) for r in df.collect()))


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of so many bytes, for this test."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def use(size):
        for n in names:
            spark.conf.set(n, str(size))

    yield use
    for n, value in before.items():
        spark.conf.set(n, value)


@pytest.mark.parametrize("size", [40, 97, 1000, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_rows_do_not_depend_on_ranges(spark, tmp_path, small_ranges, size, indent):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps(problems(12, k), indent=indent, ensure_ascii=k > 0) + "\n" * k)
    small_ranges(size)
    expected = sorted(json.dumps(p, sort_keys=True) for k in range(3) for p in problems(12, k))
    assert rows_of(JA.read_json_array(spark, str(tmp_path), SCHEMA)) == expected


def test_a_large_array_is_read_in_eight_tasks(spark, tmp_path, small_ranges):
    path = tmp_path / "large.json"
    path.write_text(json.dumps([{"id": f"p{i}", "statement": NASTY[i % len(NASTY)] + str(i)} for i in range(100_000)]))
    small_ranges(path.stat().st_size // 8 + 1)
    found = files.read_problems(spark, str(path))
    lines = spark.read.text(str(path), lineSep="}")
    assert lines.rdd.getNumPartitions() >= 8
    whole = spark.read.schema(files.PROBLEM_SCHEMA).option("multiLine", True).json(str(path))
    assert found.count() == 100_000 and found.exceptAll(whole).count() == 0 and whole.exceptAll(found).count() == 0


@pytest.mark.parametrize("text", ["", "[]", " [ \n ] ", '[{}]', '[{"id": null}]'])
def test_small_arrays(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    assert files.read_problems(spark, str(tmp_path)).count() == text.count("{")


@pytest.mark.parametrize(
    "text",
    ['[{"id": "1"}, {"id": ', '[{"id": "1"}', '[{"id": "1"} {"id": "2"}]', '{"id": "1"}', '[{"id": "1"}, 7]', '[{"id": "1"}]]',
     '[{"id": "}]', '[[{"id": "1"}]]', '[{"id": "1"}, {id}]', '[{"id": "1"},]x', "x[]"],
)
@pytest.mark.parametrize("size", [12, 1 << 20])
def test_broken_input_fails(spark, tmp_path, small_ranges, text, size):
    (tmp_path / "a.json").write_text(text)
    small_ranges(size)
    with pytest.raises(Exception):
        files.read_problems(spark, str(tmp_path)).collect()
