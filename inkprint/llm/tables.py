"""Shared helpers: reading the given tables and normalising text."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of digits, a-z (after lower-casing A-Z) and characters above U+007F; this stands between them.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is exact, and faster, where every character is ASCII."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    mapped = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(ascii_only, F.lower(text)).otherwise(mapped)


def words(text: Column) -> Column:
    """Words of a whole text in order; an empty array for null."""
    # splitting between words takes a sixth of the time of extracting them
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), BETWEEN_WORDS, -1), "")


def hash_share(key: Column) -> Column:
    """The key's hash as a number from 0 to 1: rows below a share are a sample of it, however small it is."""
    return F.shiftrightunsigned(F.xxhash64(key), 1) / F.lit(float(1 << 63))


def row_count(df: DataFrame) -> int:
    return df.agg(F.count("*")).first()[0]


def slices(batch: pd.DataFrame, chars: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Consecutive rows of a batch with about ``chars`` characters of ``text`` each, to bound what is held for them."""
    begin, total = 0, 0
    for end, text in enumerate(batch["text"], start=1):
        total += len(text or "")
        if total >= chars or end == len(batch):
            yield batch.iloc[begin:end]
            begin, total = end, 0
