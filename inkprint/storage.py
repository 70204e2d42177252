"""Where a job may cut its lineage: written tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="inkprint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/inkprint/{label}-{uuid.uuid4().hex}"


def drop_at_end(spark: SparkSession, path: str) -> None:
    """Delete what was written at ``path`` when the session's JVM ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


# rows that a written table of known size has in a file, about
ROWS_A_FILE = 50_000


def stored(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write once as Parquet and read back.

    Later passes then prune columns, survive lost executors, and see the same rows even
    if the plan above is not deterministic. Zstandard takes a third less room than the default codec where rows hold texts.
    ``rows``: no more come than these; a small table is then a few files, however many partitions a shuffle has. On a local file system
    each file costs its executor a process as well (``chmod``), which for a moment counts the executor's memory twice.
    """
    if rows is not None:
        df = df.coalesce(rows // ROWS_A_FILE + 1)
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    drop_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """A side for a map-side join, if it is checked to have at most ``max_rows`` rows.

    The side is evaluated once, here. One that fits is broadcast as a literal table; a larger
    one is read back and joined by shuffle.
    """
    # evaluated here and nowhere else, also where it is too large
    df = stored(df, "side")
    rows = df.take(max_rows + 1)
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


# groups whose table is sent to every task; beyond this a group's rows are spread over salted keys
MAX_BROADCAST_GROUPS = 10_000
_SALTS = 64


def join_groups(df: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the other columns of ``groups``, which has one row per group of ``by``; null groups match.

    A bounded table is broadcast, so no row of ``df`` moves. A larger one is repeated per salt and joined by group and
    salt, so a group with most of the rows is spread over many tasks.
    """
    if not by:
        return df.crossJoin(F.broadcast(groups))  # exactly one row
    renamed = groups.withColumnsRenamed({c: f"_g_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by]
    keys = [f"_g_{c}" for c in by]
    side = stored(renamed, "groups")
    if len(side.select(*keys).take(MAX_BROADCAST_GROUPS + 1)) <= MAX_BROADCAST_GROUPS:
        return df.join(F.broadcast(side), same, "left").drop(*keys)
    salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)))
    repeated = side.withColumn("_g_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    met = salted.join(repeated, [*same, F.col("_salt") == F.col("_g_salt")], "left")
    return met.drop(*keys, "_salt", "_g_salt")
