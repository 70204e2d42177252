"""Readers and writers of the pipeline's files. Parquet is the hand-off between stages;
JSON and CSV are for interchange."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.functions.pysyntax import decode_utf8
from inkprint.operators.corpus import SNIPPET_SCHEMA
from inkprint.sources.json_arrays import read_json_array

PROBLEM_SCHEMA = "id string, statement string"
# File suffix per language; an unknown language is read as Python.
SUFFIXES = {"python": "*.py", "java": "*.java", "cpp": "*.cpp", "javascript": "*.js"}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a plain scan over all cores, when its files give fewer splits than that.

    Text work costs far more per byte than reading, so a table in one row group would
    occupy one core. A table with enough splits is returned as it is, without a shuffle.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted, key) if df.rdd.getNumPartitions() < wanted else df


def read_problems(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold one JSON array of {id, statement}, large ones in many tasks."""
    return read_json_array(spark, path, PROBLEM_SCHEMA)


def read_jsonl(spark: SparkSession, path: str, schema: str = SNIPPET_SCHEMA) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def read_source_tree(
    spark: SparkSession, path: str, language: str = "python", glob: str | None = None
) -> DataFrame:
    """(path, source) for every matching file below a folder, each file one text.

    Undecodable bytes are dropped and line ends become line feeds. The bytes of a file
    that is valid UTF-8 never leave the JVM.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob or SUFFIXES.get(language, SUFFIXES["python"]))
        .load(path)
    )
    whole = F.col("content").cast("string")
    repaired = decode_utf8(F.when(~F.is_valid_utf8(whole), F.col("content")))
    text = F.coalesce(repaired, whole)
    return files.select("path", F.regexp_replace(text, r"\r\n?", "\n").alias("source"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that keeps line breaks, quotes and edge whitespace of the code."""
    (
        df.write.option("header", True)
        .option("escape", '"')
        .option("quoteAll", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def save_model(model: PipelineModel, path: str) -> None:
    """The bundle: fitted stages, with the feature columns in the assembler."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.json(path)


def transfer_matrix(long: DataFrame, models: list[str]) -> DataFrame:
    """Square form of (train_model, test_model, roc_auc), columns in the given order."""
    square = long.groupBy("train_model").pivot("test_model", models).agg(F.first("roc_auc"))
    return square.orderBy("train_model")


def write_matrix(matrix: DataFrame, path: str) -> None:
    matrix.write.option("header", True).csv(path)
