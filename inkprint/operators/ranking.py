"""Exact ranks, splits, samples and order statistics without one-partition windows.

A rank over a whole table is never computed as one window. Rows are counted per bucket of
an order-preserving key, offsets come from running sums over the small bucket table, and
only rows of the buckets that hold a wanted rank are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.storage import broadcast_bounded, join_groups, stored

# 16 bits of the hash: at most 65,536 bucket rows per stratum
_BUCKET_HEX_DIGITS = 4
# strata are class-like; beyond this many the cutoffs are joined by shuffle
_MAX_BROADCAST_STRATA = 10_000


def hash_order(id_col: Column, seed: int) -> Column:
    """Seeded pseudo-random order of ids, the same on every engine with MD5."""
    return F.md5(F.concat(F.lit(f"{seed}|"), id_col.cast("string")))


def _proportional(share: Column, strata_order: Window) -> tuple[Column, Column]:
    floor = F.floor(share)
    place = F.row_number().over(strata_order.orderBy((share - floor).desc(), "_stratum"))
    return floor, place


def split_sizes(counts: DataFrame, test_size: float = 0.15, val_size: float = 0.15) -> DataFrame:
    """(_stratum, _n) to the same plus n_test, n_val.

    Totals are ceil(test_size * n) and ceil(val_size / (1 - test_size) * rest), in doubles
    and in this order. Each stratum gets the floor of its proportional share; leftovers go
    to the largest remainders, ties to the smaller stratum. One row per stratum.
    """
    # the table has one row per stratum, so a single-partition window is what it needs
    whole = Window.partitionBy(F.lit(0))

    def allot(df: DataFrame, size: Column, rest: str, total: Column, out: str) -> DataFrame:
        # the double-precision order of operations decides how many rows a part gets
        df = df.withColumn("_size", F.ceil(size).cast("double"))
        df = df.withColumn("_share", F.col(rest) / total * F.col("_size"))
        floor, place = _proportional(F.col("_share"), whole)
        df = df.withColumns({"_floor": floor, "_place": place})
        left = F.col("_size") - F.sum("_floor").over(whole)
        extra = F.when(F.col("_place") <= left, 1).otherwise(0)
        return df.withColumn(out, (F.col("_floor") + extra).cast("long"))

    df = counts.withColumn("_total", F.sum("_n").over(whole).cast("double"))
    df = allot(df, F.lit(test_size) * F.col("_total"), "_n", F.col("_total"), "n_test")
    df = df.withColumns({"_rest": F.col("_n") - F.col("n_test")})
    rest_total = F.sum("_rest").over(whole).cast("double")
    df = df.withColumn("_rest_total", rest_total)
    ratio = val_size / (1 - test_size)
    df = allot(df, F.lit(ratio) * F.col("_rest_total"), "_rest", F.col("_rest_total"), "n_val")
    return df.select("_stratum", "_n", "n_test", "n_val")


def stratified_split(
    df: DataFrame,
    id_col: str = "id",
    strata: Sequence[str] = ("label",),
    test_size: float = 0.15,
    val_size: float = 0.15,
    seed: int = 42,
) -> DataFrame:
    """Append ``split`` in {train, val, test} with exact stratified sizes.

    Ids must be unique. Within a stratum rows are ordered by a seeded hash; the first
    n_test are test, the next n_val are val. The two cutoff keys per stratum are found
    from bucket counts, so labelling is a narrow pass and no row of the table moves.
    The input is read three times (two of them only for id and strata): pass a stored table.
    """
    stratum = F.struct(*strata)
    keyed = df.select(
        stratum.alias("_stratum"),
        hash_order(F.col(id_col), seed).alias("_h"),
        F.col(id_col).cast("string").alias("_id"),
    ).withColumn("_bucket", F.substring("_h", 1, _BUCKET_HEX_DIGITS))

    buckets = keyed.groupBy("_stratum", "_bucket").agg(F.count("*").alias("_in"))
    sizes = split_sizes(
        buckets.groupBy("_stratum").agg(F.sum("_in").alias("_n")), test_size, val_size
    )
    running = Window.partitionBy("_stratum").orderBy("_bucket")
    ends = buckets.withColumn("_end", F.sum("_in").over(running))
    wanted = sizes.select(
        "_stratum",
        F.explode(
            F.array(
                F.struct(F.lit("test").alias("part"), F.col("n_test").alias("rank")),
                F.struct(
                    F.lit("val").alias("part"), (F.col("n_test") + F.col("n_val")).alias("rank")
                ),
            )
        ).alias("_w"),
    )
    located = (
        ends.join(wanted, "_stratum")
        .where("_w.rank > _end - _in AND _w.rank <= _end")
        .select("_stratum", "_bucket", "_w.part", (F.expr("_w.rank - (_end - _in)")).alias("_need"))
    )
    located = broadcast_bounded(located, 2 * _MAX_BROADCAST_STRATA)
    in_bucket = Window.partitionBy("_stratum", "_bucket", "part").orderBy("_h", "_id")
    cuts = (
        keyed.join(located, ["_stratum", "_bucket"])
        .withColumn("_rank", F.row_number().over(in_bucket))
        .where("_rank = _need")
        .groupBy("_stratum")
        .agg(
            F.max(F.when(F.col("part") == "test", F.struct("_h", "_id"))).alias("_test_cut"),
            F.max(F.when(F.col("part") == "val", F.struct("_h", "_id"))).alias("_val_cut"),
        )
    )
    cuts = broadcast_bounded(cuts, _MAX_BROADCAST_STRATA)
    key = F.struct(
        hash_order(F.col(id_col), seed).alias("_h"), F.col(id_col).cast("string").alias("_id")
    )
    split = (
        F.when(key <= F.col("_test_cut"), "test")
        .when(key <= F.col("_val_cut"), "val")
        .otherwise("train")
    )
    joined = df.join(
        cuts.withColumnRenamed("_stratum", "_cut_stratum"),
        stratum.eqNullSafe(F.col("_cut_stratum")),
        "left",
    )
    return joined.select(*df.columns, split.alias("split"))


def seeded_sample(df: DataFrame, n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """n rows without replacement, or all rows if there are fewer: a per-task top-n."""
    return df.orderBy(hash_order(F.col(id_col), seed), F.col(id_col)).limit(n)


# (group, value) rows that one bucket holds, about, and buckets of a group at most
_BUCKET_ROWS = 50_000
_MIN_BUCKETS, _MAX_BUCKETS = 16, 10_000


def value_counts(df: DataFrame, by: Sequence[str], value: str, *counts: Column) -> tuple[DataFrame, int]:
    """One stored row per (group, value) with ``counts``, and how many buckets suit their number."""
    table = stored(df.groupBy(*by, value).agg(*counts), "value-counts")
    rows = table.agg(F.count("*")).first()[0]
    return table, min(_MAX_BUCKETS, _MIN_BUCKETS + rows // _BUCKET_ROWS)


def _below(cuts: Column, value: Column, buckets: int) -> Column:
    """How many of the sorted cuts are below the value, by halving."""
    bounds = F.struct(F.lit(0).alias("low"), F.size(cuts).alias("high"))

    def halve(b: Column, _: Column) -> Column:
        middle = F.floor((b["low"] + b["high"]) / 2).cast("int")
        above = F.get(cuts, middle) < value
        low, high = F.when(above, middle + 1).otherwise(b["low"]), F.when(above, b["high"]).otherwise(middle)
        open_ = b["low"] < b["high"]
        return F.struct(F.when(open_, low).otherwise(b["low"]).alias("low"), F.when(open_, high).otherwise(b["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(buckets.bit_length() + 1))
    return F.aggregate(steps, bounds, halve, lambda b: b["low"])


def with_quantile_bucket(counts: DataFrame, by: Sequence[str], value: str, weight: Column, buckets: int) -> DataFrame:
    """Append ``_bucket``, monotone in ``value`` within each group, of near-equal sizes.

    ``counts`` holds one row per (group, value), so ties cannot fill a bucket. Results
    built on this never depend on where the boundaries fall, only balance does. The cuts, one row per group, come to
    the counts by broadcast, or by salted keys where there are too many groups for that.
    """
    steps = [i / buckets for i in range(1, buckets)]
    present = F.when(weight > 0, F.col(value))
    cuts = counts.groupBy(*by).agg(F.percentile_approx(present, steps, 10_000).alias("_cuts"))
    joined = join_groups(counts, cuts, list(by))
    return joined.select(*counts.columns, _below(F.col("_cuts"), F.col(value), buckets).alias("_bucket"))


def exact_median(
    df: DataFrame, value: str, by: Sequence[str] = (), out: str = "median", buckets: int | None = None
) -> DataFrame:
    """Interpolated median per group, exact; null values are ignored. ``buckets`` follows the data unless given."""
    by = list(by)
    present = df.where(F.col(value).isNotNull())
    counts, suited = value_counts(present, by, value, F.count("*").alias("_n"))
    bucketed = with_quantile_bucket(counts, by, value, F.col("_n"), buckets or suited)
    totals = bucketed.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_in"))
    over_buckets = Window.partitionBy(*by or [F.lit(0)])
    ends = totals.withColumns(
        {
            "_end": F.sum("_in").over(over_buckets.orderBy("_bucket")),
            "_all": F.sum("_in").over(over_buckets),
        }
    )
    low, high = F.expr("(_all + 1) div 2"), F.expr("_all div 2 + 1")
    holding = ends.where((F.col("_end") >= low) & (F.col("_end") - F.col("_in") < high)).select(
        *[F.col(c).alias(f"_t_{c}") for c in by],
        F.col("_bucket").alias("_t_bucket"),
        (F.col("_end") - F.col("_in")).alias("_before"),
        "_all",
    )
    same = [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in by]
    # one or two buckets per group, by group and bucket
    in_bucket = Window.partitionBy(*by, "_bucket").orderBy(value)
    ranked = bucketed.join(
        holding, [*same, F.col("_bucket") == F.col("_t_bucket")]
    ).withColumn("_end", F.col("_before") + F.sum("_n").over(in_bucket))

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_end") >= rank, F.col(value)))

    return ranked.groupBy(*by).agg(((at(low) + at(high)) / 2).alias(out))
