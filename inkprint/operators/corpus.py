"""Building the dataset: unions, filters, deduplication, prompts and completions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.functions.text import (
    composite_id,
    content_id,
    is_nonblank,
    length_band,
    render_prompt,
    strip_code_fence,
)
from inkprint.operators.ranking import stratified_split
from inkprint.storage import broadcast_bounded, stored

SNIPPET_SCHEMA = (
    "id string, problem_id string, language string, source_model string, label int, "
    "code string, source_file string"
)
META_COLUMNS = ["id", "label", "split", "source_model", "language"]
NON_FEATURE_COLUMNS = {*META_COLUMNS, "code"}
_MAX_BROADCAST_MODELS = 10_000


def drop_null_code(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=["code"])


def nonblank(df: DataFrame) -> DataFrame:
    return df.where(is_nonblank(F.col("code")))


def in_split(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("split") == split)


def meta_columns(df: DataFrame) -> list[str]:
    return [c for c in META_COLUMNS if c in df.columns]


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NON_FEATURE_COLUMNS]


def tag_source(df: DataFrame, label: int, source_model: str, language: str) -> DataFrame:
    return df.withColumns(
        {
            "label": F.lit(label),
            "source_model": F.lit(source_model),
            "language": F.lit(language),
        }
    )


def union_sources(human: DataFrame, ai: DataFrame) -> DataFrame:
    """Human rows, then AI rows; ``src_ord`` keeps that order for deduplication."""
    return human.withColumn("src_ord", F.lit(0)).unionByName(
        ai.withColumn("src_ord", F.lit(1)), allowMissingColumns=True
    )


def dedup_keep_first(df: DataFrame, order: Sequence[str] = ("src_ord", "id")) -> DataFrame:
    """One row per code, the first in ``order``.

    The 64-bit hash leads the grouping key so that sorting compares longs and rarely
    reaches the text, which stays part of the key: the result is exact. Copies collapse
    before the shuffle, so a text that fills a third of the table costs one row per task.
    """
    rest = [c for c in df.columns if c != "code"]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    kept = df.groupBy(F.xxhash64("code").alias("_h"), "code").agg(first)
    return kept.select(*[F.col("code") if c == "code" else F.col(f"_first.{c}") for c in df.columns])


def class_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("label") == 0).alias("human"),
        F.count_if(F.col("label") == 1).alias("ai"),
    )


def split_label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split", "label").agg(F.count("*").alias("n"))


def distinct_source_models(df: DataFrame) -> DataFrame:
    return (
        df.where((F.col("label") == 1) & F.col("source_model").isNotNull())
        .select("source_model")
        .distinct()
        .orderBy("source_model")
    )


def prepare_dataset(
    human: DataFrame,
    ai: DataFrame,
    test_size: float = 0.15,
    val_size: float = 0.15,
    seed: int = 42,
    strata: Sequence[str] = ("label",),
) -> DataFrame:
    """Union, deduplicate, drop blank code, split.

    Blank rows go before the deduplication, which gives the same rows and a smaller
    shuffle. The deduplicated table is written once because the split reads it three times.
    """
    kept = dedup_keep_first(nonblank(union_sources(human, ai)))
    return stratified_split(
        stored(kept, "deduplicated"), "id", strata, test_size, val_size, seed
    )


def write_dataset(dataset: DataFrame, path: str) -> None:
    """Parquet by split, so that readers of one split prune the others."""
    dataset.write.partitionBy("split").parquet(path)


# --- collected functions ------------------------------------------------------------


def human_snippets(functions: DataFrame, low: int = 5, high: int = 120) -> DataFrame:
    """Extracted functions within the length band, as human snippet records."""
    code = F.col("code")
    kept = functions.where(length_band(code, low, high))
    return tag_source(kept, 0, "human", "python").select(
        content_id(code).alias("id"),
        F.lit(None).cast("string").alias("problem_id"),
        "language",
        "source_model",
        "label",
        "code",
        "source_file",
        "position",
    )


def limit_snippets(df: DataFrame, max_snippets: int = 1000) -> DataFrame:
    """The first snippets in file order, as a top-n."""
    return df.orderBy("source_file", "position").limit(max_snippets)


# --- generation requests ------------------------------------------------------------


def _names(spark: SparkSession, column: str, values: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def prompt_grid(
    problems: DataFrame, languages: Sequence[str], models: Sequence[str]
) -> DataFrame:
    """One row per problem x language x model. The two short argument lists are spread over
    each problem in place, so nothing is shuffled or joined."""
    return problems.withColumn(
        "language", F.explode(F.array(*map(F.lit, languages)))
    ).withColumn("source_model", F.explode(F.array(*map(F.lit, models))))


def known_models(grid: DataFrame, dispatch: DataFrame) -> DataFrame:
    """Rows whose model is in the dispatch table; others are skipped.

    A few model names are shared by all rows, so the grid must not be shuffled by them."""
    listed = broadcast_bounded(dispatch.select("source_model"), _MAX_BROADCAST_MODELS)
    return grid.join(listed, "source_model", "left_semi")


def generate_requests(
    problems: DataFrame,
    languages: Sequence[str],
    models: Sequence[str],
    dispatch: Sequence[str],
) -> DataFrame:
    """One prompt per request, with its composite id."""
    spark = problems.sparkSession
    grid = prompt_grid(problems, languages, models)
    grid = known_models(grid, _names(spark, "source_model", dispatch))
    return grid.select(
        composite_id(F.col("id"), F.col("language"), F.col("source_model")).alias("id"),
        F.col("id").alias("problem_id"),
        "language",
        "source_model",
        render_prompt(F.col("language"), F.col("statement")).alias("prompt"),
    )


def attach_completions(requests: DataFrame, completions: DataFrame) -> DataFrame:
    """AI snippet records for requests that were answered; the fence is stripped."""
    answered = requests.join(completions.select("id", "completion"), "id")
    return answered.select(
        "id",
        "problem_id",
        "language",
        "source_model",
        F.lit(1).alias("label"),
        strip_code_fence(F.col("completion")).alias("code"),
    )


def failed_requests(requests: DataFrame, completions: DataFrame) -> DataFrame:
    return requests.join(completions, "id", "left_anti")
