"""Golden values of the six small programs."""

import pytest
from pyspark.sql import functions as F

from inkprint.functions import pysyntax
from inkprint.operators import features as FE

# Fixed values, from the golden table: one column per program.
GOLDEN = {
    "ast_parse_success": [1, 1, 1, 0, 1, 1],
    "ast_depth": [5, 8, 6, 0, 0, 8],
    "ast_n_nodes": [17, 47, 18, 0, 1, 34],
    "ast_n_functions": [1, 1, 1, 0, 0, 2],
    "ast_n_branches": [0, 2, 0, 0, 0, 1],
    "ast_n_try_except": [0, 0, 1, 0, 0, 0],
    "ast_n_comprehensions": [0, 1, 0, 0, 0, 1],
    "ast_avg_function_args": [2.0, 1.0, 1.0, 0, 0, 1.5],
    "ast_max_nesting": [0, 0, 0, 0, 0, 0],
    "ast_frac_Name": [0.235294, 0.212766, 0.111111, 0, 0, 0.176471],
    "name_avg_len": [3.25, 2.380952, 3.928571, 1.0, 0, 2.826087],
    "name_snake_case_ratio": [0.083333, 0, 0, 0, 0, 0],
    "name_single_char_ratio": [0.333333, 0.333333, 0.285714, 1.0, 0, 0.391304],
    "comment_density": [0.2, 0, 0, 0, 0, 0],
    "docstring_count": [0, 0, 0.285714, 0, 0, 0],
    "avg_comment_length": [11.0, 0, 0, 0, 0, 0],
    "trailing_whitespace_ratio": [0, 0.142857, 0, 0, 0, 0],
    "mixed_indent_ratio": [0, 0, 0, 0.5, 0, 0],
    "blank_line_ratio": [0.2, 0.142857, 0.142857, 0, 1.0, 0.222222],
    "line_length_std": [6.829348, 10.404081, 8.033095, 1.0, 0, 12.239382],
    "char_entropy": [3.829813, 3.634235, 4.041028, 2.739572, 0, 3.775829],
    "token_entropy": [3.852513, 3.833694, 4.246833, 2.450826, 0, 4.057842],
    "n_tokens": [16, 40, 24, 6, 0, 40],
    "unique_token_ratio": [0.8125, 0.625, 0.791667, 0.833333, 0, 0.65],
}


@pytest.fixture(scope="module")
def matrix(spark, programs):
    return {r.id: r for r in FE.feature_matrix(programs).collect()}


@pytest.mark.parametrize("name", GOLDEN)
def test_feature(matrix, name):
    found = [matrix[f"g{k}"][name] for k in range(6)]
    assert found == pytest.approx(GOLDEN[name], abs=1e-6)


def test_complexity(matrix):
    found = [matrix[f"g{k}"].ast_cyclomatic_complexity for k in range(5)]
    assert found == [1, 5, 2, 0, 0]


def test_grouped_counts_agree_with_narrow_ones(spark, programs, matrix):
    nodes = pysyntax.ast_node_table(programs)
    for row in FE.ast_counts(programs.select("id"), nodes).collect():
        for name in FE.AST_COUNT_FEATURES:
            assert row[name] == pytest.approx(matrix[row.id][name]), (row.id, name)


def test_complexity_by_block_agrees(spark, programs, matrix):
    nodes = pysyntax.ast_node_table(programs)
    for row in FE.mean_cyclomatic(programs, nodes).collect():
        assert row.ast_cyclomatic_complexity == matrix[row.id].ast_cyclomatic_complexity


def test_fractions_sum_to_one(spark, programs, matrix):
    for k in (0, 1, 2, 4, 5):
        total = sum(matrix[f"g{k}"][c] for c in FE.AST_FRACTION_FEATURES)
        assert total == pytest.approx(1.0)
    maps = FE.fraction_maps(pysyntax.ast_node_table(programs)).collect()
    assert len(maps) == 5
    assert all(sum(r.ast_frac.values()) == pytest.approx(1.0) for r in maps)


def test_renamed_program(spark, programs):
    renamed = programs.where("id = 'g1'").select(pysyntax.rename_variables(F.col("code")).alias("c"))
    assert renamed.first().c.splitlines()[1:3] == ["    v0 = []", "    for v1 in v2:"]


@pytest.mark.parametrize(
    "code, expected",
    [
        ("x = 1\ndel x\nprint(x)", "v0 = 1\ndel x\nv1(v0)"),
        ("__all__ = []\n_y = __all__", "__all__ = []\nv0 = __all__"),
        ("def f(a):\n    return a", "def f(a):\n    return v0"),
        ("not python at all", "not python at all"),
    ],
)
def test_rename_rules(code, expected):
    assert pysyntax.rename_identifiers(code) == expected


SOURCE = '''import os

class Box:
    @property
    def size(self):
        """Größe."""
        def inner(x):
            return "é" + x
        return inner

async def later(): return 1
'''


def test_function_segments():
    first, second, third = pysyntax.function_segments(SOURCE)
    assert first == "async def later(): return 1"
    assert second.startswith("def size(self):\n") and second.endswith("return inner")
    assert third == 'def inner(x):\n            return "é" + x'
    assert list(pysyntax.function_segments("def broken(:")) == []


def test_deeply_nested_text_is_a_parse_failure(spark):
    deep = "(" * 5000 + ")" * 5000
    chain = "x = " + "-" * 3000 + "1"
    null = "x = 1\0"
    rows = [(str(i), c) for i, c in enumerate((deep, chain, null))]
    df = spark.createDataFrame(rows, "id string, code string")
    found = {r.id: r.ast_parse_success for r in FE.with_ast_features(df).collect()}
    assert found["0"] == 0 and found["2"] == 0
