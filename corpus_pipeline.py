"""A training corpus from raw documents: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.llm import decontamination, language, lines, near_duplicates, packing
from inkprint.llm.tables import table
from inkprint.storage import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_identified_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose fused evidence speaks for none of the declared languages go, null and empty texts with them."""
    # written first: a row keeps its number when a lost executor's part is read again
    whole = stored(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered-documents")
    model = language.fit_text_model(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    fields = language.document_fields(whole.drop("doc_id").withColumnRenamed("_row", "doc_id"))
    rejected = language.identify(fields, model).where(~F.col("kept")).select(F.col("id").alias("_row"))
    return whole.join(rejected, "_row", "left_anti").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least ten documents go; the documents stay."""
    return lines.dedup_lines(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents that links of similarity 0.8 connect, the one of the least id stays."""
    return near_duplicates.deduplicate(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontamination.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("language_id", keep_identified_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# Likelihoods, sketches and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
