"""Binary classification metrics per group, each from counts that combine map-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.operators.ranking import exact_median, value_counts, with_quantile_bucket
from inkprint.storage import join_groups

CLASS_NAMES = ("human", "ai")


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def threshold_prediction(probability: Column, threshold: float = 0.5) -> Column:
    """1 only strictly above the threshold."""
    return F.when(probability > threshold, 1).otherwise(0)


def confusion_counts(
    df: DataFrame, by: Sequence[str], label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    def cell(y: int, p: int) -> Column:
        return F.count_if((F.col(label) == y) & (F.col(prediction) == p))

    return df.groupBy(*by).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def confusion_matrix() -> Column:
    """[[tn, fp], [fn, tp]] over confusion counts."""
    return F.array(F.array("tn", "fp"), F.array("fn", "tp"))


def _rates() -> tuple[Column, Column, Column, Column]:
    """Accuracy, precision, recall and F1 of the positive class over confusion counts."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return (
        ratio(tp + tn, tn + fp + fn + tp),
        ratio(tp, tp + fp),
        ratio(tp, tp + fn),
        ratio(2 * tp, 2 * tp + fp + fn),
    )


def binary_metrics(
    df: DataFrame, by: Sequence[str], label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """accuracy, precision, recall, f1 for the positive class, and the confusion matrix."""
    counts = confusion_counts(df, by, label, prediction)
    names = ("accuracy", "precision", "recall", "f1")
    rates = [c.alias(n) for n, c in zip(names, _rates())]
    return counts.select(*by, *rates, confusion_matrix().alias("confusion_matrix"))


def _ranked_groups(
    df: DataFrame,
    by: list[str],
    label: str,
    score: str,
    buckets: int | None,
    extra: dict[str, Column],
) -> DataFrame:
    """Per group: _area, _pos, _neg and sums of ``extra``, all from (group, score) counts.

    Rows collapse to (group, score) counts first. Each group is cut into score buckets, the
    area inside a bucket is summed by a window over that bucket, and the rest follows from
    running negatives over the small bucket table: no task ever orders a whole group.
    """
    y = F.col(label)
    judged = df.where(F.col(score).isNotNull() & y.isNotNull())
    counts, suited = value_counts(judged, by, score, F.count_if(y == 1).alias("_pos"), F.count_if(y == 0).alias("_neg"))
    pos, neg = F.col("_pos"), F.col("_neg")
    bucketed = with_quantile_bucket(counts, by, score, pos + neg, buckets or suited)
    in_bucket = Window.partitionBy(*by, "_bucket").orderBy(score)
    below = F.sum(neg).over(in_bucket) - neg
    sums = {"_pos": pos, "_neg": neg, **extra}
    areas = (
        bucketed.withColumn("_area", pos * (below + neg / 2))
        .groupBy(*by, "_bucket")
        .agg(F.sum("_area").alias("_area"), *[F.sum(c).alias(n) for n, c in sums.items()])
    )
    over_buckets = Window.partitionBy(*by or [F.lit(0)]).orderBy("_bucket")
    areas = areas.withColumn("_below", F.sum("_neg").over(over_buckets) - neg)
    area = F.sum(F.col("_area") + pos * F.col("_below")).alias("_area")
    return areas.groupBy(*by).agg(area, *[F.sum(n).alias(n) for n in sums])


def _auc() -> Column:
    classes = F.col("_pos").cast("double") * F.col("_neg").cast("double")
    return F.try_divide(F.col("_area"), classes).alias("roc_auc")


def roc_auc(
    df: DataFrame,
    by: Sequence[str] = (),
    label: str = "label",
    score: str = "score",
    buckets: int | None = None,
) -> DataFrame:
    """Exact rank AUC per group, ties half-counted; null when a group has one class."""
    by = list(by)
    return _ranked_groups(df, by, label, score, buckets, {}).select(*by, _auc())


def areas_against_rest(df: DataFrame, by: Sequence[str], group: str, label: str = "label", score: str = "score") -> DataFrame:
    """(by, group, roc_auc) of each group's positives against all negatives of ``by``, whatever their group.

    Positives collapse to counts per (by, group, score) and negatives to counts per (by, score); running sums of the
    negatives are taken once per score and met by the positives' counts. No negative is copied for a group.
    """
    by, y = list(by), F.col(label)
    usable = df.where(F.col(score).isNotNull() & y.isNotNull())
    counts, buckets = value_counts(usable, by, score, F.count_if(y == 0).alias("_neg"), F.count("*").alias("_all"))
    bucketed = with_quantile_bucket(counts, by, score, F.col("_all"), buckets)
    in_bucket = Window.partitionBy(*by, "_bucket").orderBy(score)
    inside = bucketed.withColumn("_inside", F.sum("_neg").over(in_bucket) - F.col("_neg"))
    sums = bucketed.groupBy(*by, "_bucket").agg(F.sum("_neg").alias("_of"))
    over_buckets = Window.partitionBy(*by or [F.lit(0)]).orderBy("_bucket")
    sums = sums.withColumn("_before", F.sum("_of").over(over_buckets) - F.col("_of")).drop("_of")
    below = inside.join(sums, [*by, "_bucket"]).select(*by, score, (F.col("_before") + F.col("_inside") + F.col("_neg") / 2).alias("_below"))
    positives = usable.where(y == 1).groupBy(*by, group, score).agg(F.count("*").alias("_pos"))
    totals = counts.groupBy(*by).agg(F.sum("_neg").alias("_negatives"))
    areas = positives.join(below, [*by, score]).groupBy(*by, group).agg(
        F.sum(F.col("_pos") * F.col("_below")).alias("_area"), F.sum("_pos").alias("_positives")
    )
    pairs = F.col("_positives").cast("double") * F.col("_negatives").cast("double")
    return join_groups(areas, totals, by).select(*by, group, F.try_divide(F.col("_area"), pairs).alias("roc_auc"))


def evaluate(
    scored: DataFrame,
    by: Sequence[str],
    label: str = "label",
    score: str = "score",
    threshold: float = 0.5,
    buckets: int | None = None,
) -> DataFrame:
    """One row of metrics per group, from probabilities; rows without a score are left out.

    A prediction depends on the score alone, so the confusion counts come from the same
    (group, score) counts as the AUC, and the scored rows are computed once.
    """
    by = list(by)
    hit = F.col(score) > threshold
    cells = {
        "tn": F.when(~hit, F.col("_neg")).otherwise(0),
        "fp": F.when(hit, F.col("_neg")).otherwise(0),
        "fn": F.when(~hit, F.col("_pos")).otherwise(0),
        "tp": F.when(hit, F.col("_pos")).otherwise(0),
    }
    counts = _ranked_groups(scored, by, label, score, buckets, cells)
    names = ("accuracy", "precision", "recall", "f1")
    rates = [c.alias(n) for n, c in zip(names, _rates())]
    return counts.select(*by, *rates, _auc(), confusion_matrix().alias("confusion_matrix"))


def classification_report(
    df: DataFrame, by: Sequence[str], label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Rows human, ai, accuracy, macro avg and weighted avg per group."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    counts = confusion_counts(df, by, label, prediction)
    total = tn + fp + fn + tp
    accuracy = ratio(tn + tp, total)

    def scores(hit, false_alarm, missed):
        return (
            ratio(hit, hit + false_alarm),
            ratio(hit, hit + missed),
            ratio(2 * hit, 2 * hit + false_alarm + missed),
        )

    human, ai = scores(tn, fn, fp), scores(tp, fp, fn)
    n_human, n_ai = tn + fp, tp + fn
    macro = [(h + a) / 2 for h, a in zip(human, ai)]
    weighted = [ratio(h * n_human + a * n_ai, total) for h, a in zip(human, ai)]

    def row(name: str, values, support: Column) -> Column:
        p, r, f = values
        return F.struct(
            F.lit(name).alias("class"),
            p.alias("precision"),
            r.alias("recall"),
            f.alias("f1"),
            support.cast("long").alias("support"),
        )

    rows = F.array(
        row(CLASS_NAMES[0], human, n_human),
        row(CLASS_NAMES[1], ai, n_ai),
        row("accuracy", [accuracy] * 3, total),
        row("macro avg", macro, total),
        row("weighted avg", weighted, total),
    )
    return counts.select(*by, F.inline(rows))


def median_predictions(
    df: DataFrame, score: str = "score", by: Sequence[str] = (), out: str = "prediction"
) -> DataFrame:
    """Append the median score of the group and 1 for rows strictly above it."""
    by = list(by)
    medians = exact_median(df, score, by, "threshold")
    joined = join_groups(df, medians, by)
    above = F.when(F.col(score) > F.col("threshold"), 1).otherwise(0)
    return joined.select(*df.columns, "threshold", above.alias(out))
