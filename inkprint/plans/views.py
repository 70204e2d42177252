"""Snippet-shaped views over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.operators.ranking import stratified_split
from inkprint.sources.files import read_table, spread

# Six small programs, one of which does not parse and one of which is empty.
PROGRAMS = [
    "def add_two(a, b):\n    # sum of both\n    total = a + b\n    return total\n",
    "def f(xs):\n    out = []\n    for x in xs:\n        if x > 1 and x < 9:\n"
    "            out.append(x)  \n\n    return [y * 2 for y in out]",
    'async def g(u, *, k=1):\n    """Doc."""\n    try:\n        return await u\n'
    "    except ValueError:\n        return None\n",
    "x = (1\n  \ty = 2",
    "",
    "class A:\n    def m(self, q):\n        while q:\n            q -= 1\n"
    "        return {i for i in range(3)}\n\n    def n(self):\n"
    "        return 'é' if self else \"b\"\n",
]
LANGUAGES = ["python", "java"]
MODELS = ["m0", "m1", "unlisted"]
DISPATCH = ["m0", "m1", "m2"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, without negative zero."""
    return df.selectExpr(
        *[
            f"round(`{c}`, {digits}) + 0D as `{c}`" if t in ("double", "float") else f"`{c}`"
            for c, t in df.dtypes
        ]
    )


def snippets(spark: SparkSession, sf: str) -> DataFrame:
    """User and assistant turns as human and AI snippets."""
    turns = table(spark, sf, "conversations").where(F.col("role").isin("user", "assistant"))
    is_ai = F.col("role") == "assistant"
    return spread(
        turns.select(
            F.concat_ws("_", "conv_id", "turn").alias("id"),
            is_ai.cast("int").alias("label"),
            F.when(is_ai, "assistant").otherwise("human").alias("source_model"),
            F.col("text").alias("code"),
        ),
        "id",
    )


def labelled_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents; the language stands for the generator of the AI class."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("quality").alias("label"),
        F.when(F.col("quality") == 0, "human").otherwise(F.col("lang")).alias("source_model"),
        F.col("text").alias("code"),
    )


def _program(k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PROGRAMS)), (k + 1).cast("int"))


def code_corpus(spark: SparkSession, sf: str, flips: bool = True) -> DataFrame:
    """Small programs, one per part, each with a comment that makes it distinct.

    The program decides the label, which ``flips`` turns around for one part in sixteen.
    """
    key = F.col("p_partkey").cast("string")
    k = F.col("p_partkey") % 6
    label = k.isin(0, 2, 5).cast("int")
    flipped = F.when(F.startswith(F.md5(key), F.lit("0")), 1 - label).otherwise(label)
    parts = table(spark, sf, "part").select(
        key.alias("id"),
        k.cast("int").alias("k"),
        (flipped if flips else label).alias("label"),
        "p_size",
        F.concat(_program(k), F.lit("\n# id "), key).alias("code"),
    )
    model = F.concat(F.lit("m"), (F.col("p_size") % 3).cast("string"))
    return spread(
        parts.select(
            "id",
            "k",
            "label",
            F.when(F.col("label") == 0, "human").otherwise(model).alias("source_model"),
            F.lit("python").alias("language"),
            "code",
        ),
        "id",
    )


def code_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return stratified_split(code_corpus(spark, sf)).drop("k")


def planted_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """The same programs under the labels that they decide: a fit's right answers are known."""
    return stratified_split(code_corpus(spark, sf, flips=False)).drop("k")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Prose and programs together: (id, code)."""
    prose = snippets(spark, sf).select(F.concat(F.lit("s"), "id").alias("id"), "code")
    programs = code_corpus(spark, sf).select(F.concat(F.lit("p"), "id").alias("id"), "code")
    return prose.unionByName(programs)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with a score taken from their length, grouped by source."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("model"),
        "lang",
        F.col("quality").alias("label"),
        ((F.col("n_chars") % 97) / F.lit(97.0)).alias("score"),
    )


def raw_sources(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents as two sources with copies, blank texts and nulls."""
    doc = F.col("doc_id")
    code = (
        F.when(doc % 101 == 0, F.lit(None))
        .when(doc % 97 == 0, F.lit("\t\u00a0"))
        .otherwise(F.col("text"))
    )
    rows = table(spark, sf, "documents").select(
        doc.cast("string").alias("id"), (doc % 2).cast("int").alias("label"), "source", code.alias("code")
    )
    human = rows.where("label = 0").select("id", "label", F.lit("human").alias("source_model"), "code")
    ai = rows.where("label = 1").select("id", "label", F.col("source").alias("source_model"), "code")
    return human, ai


def problems(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("id"), F.col("text").alias("statement")
    )


def completions(spark: SparkSession, sf: str, requests: DataFrame) -> DataFrame:
    """An answer per request: fenced for odd problems, bare for even, none for each seventh."""
    number = F.col("problem_id").cast("bigint")
    answers = requests.join(
        problems(spark, sf).withColumnRenamed("id", "problem_id"), "problem_id"
    ).where(number % 7 != 0)
    fenced = F.concat(F.lit("```python\n"), F.col("statement"), F.lit("\n```\n"))
    text = F.when(number % 2 == 1, fenced).otherwise(F.concat(F.lit("  "), "statement", F.lit("\n")))
    return answers.select("id", text.alias("completion"))


def contributions(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """Embedding components standing for per-feature contributions: (id, shap array)."""
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"),
        F.col("embedding").cast("array<double>").alias("shap"),
    )
    width = len(rows.first()["shap"])
    return rows, [f"f{i}" for i in range(width)]
