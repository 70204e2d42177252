"""Style features with one Arrow pass equal those without Python; both against a plain version of line ends."""

import random

import pytest
from pyspark.sql import functions as F

from inkprint.functions.text import STYLE_FEATURES, trailing_whitespace_ratio, with_style_features
from inkprint.plans import queries as Q

TEXTS = [
    "",
    " ",
    "\n",
    "\t\n \x0b\n\u2003",
    "a",
    "_",
    "snake_case camelCase x _ A_B a1_ 9a __ é_x xé naïve x² x\u0301",
    "日本 語\u3000text 中 _a日",
    "tail \nnone\n\u00a0\n  mixed\t\n# a comment  \nx = 1  # b\n\x85end\x85",
    "if x:\n \ty = '''z'''\n",
]


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(4)
    made = ["".join(rng.choice("ab_Z09 \t\n#\u00a0\u2028\x85é²日\r") for _ in range(rng.randrange(80))) for _ in range(150)]
    return spark.createDataFrame([(str(i), t) for i, t in enumerate([*TEXTS, *made, None])], "id string, code string").cache()


def test_the_arrow_pass_gives_the_values_of_the_plan_without_python(samples):
    a, b = ({r.id: r for r in with_style_features(samples, tokens=t).collect()} for t in ("space", "arrow"))
    assert a.keys() == b.keys()
    for key, row in a.items():
        for name in STYLE_FEATURES:
            assert b[key][name] == (None if row[name] is None else pytest.approx(row[name], abs=1e-12)), (key, name, row.code)


def test_trailing_whitespace_by_line_ends(samples):
    for r in samples.where("code IS NOT NULL").select("code", trailing_whitespace_ratio(F.col("code")).alias("share")).collect():
        lines = r.code.split("\n")
        assert r.share == pytest.approx(sum(x[-1:].isspace() for x in lines) / len(lines)), r.code


def test_code_points_beyond_the_first_plane_count_once(spark):
    rows = spark.createDataFrame([("a", "\U0001f600\U0001f601 \U0001f600")], "id string, code string")
    row = with_style_features(rows, tokens="arrow").first()
    assert row.char_entropy == pytest.approx(1.5) and row.token_entropy == pytest.approx(1.5) and row.n_tokens == 2


def test_the_flagship_takes_names_tokens_and_entropies_in_one_python_pass(spark, sf):
    plan = Q.flagship(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
