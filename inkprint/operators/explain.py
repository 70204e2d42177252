"""Signed feature contributions of scores: of boosted trees and linear models in log-odds, of forests in probability.

Path-dependent tree attributions (Lundberg et al. 2018). The weight of a set of known features is a beta integral, so
the share of feature j is, over the leaves, value * (o_j - z_j) times the integral over [0, 1] of the other path features'
z (1 - t) + o t, with o whether the row agrees with a feature's bounds and z the share of training rows that do. The integrand is a
polynomial: a few Gauss points give it exactly, and one walk through a tree serves all its leaves, at any depth.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    LogisticRegressionModel,
    RandomForestClassificationModel,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprint.operators.boosting import alike
from inkprint.storage import drop_at_end, new_path, stored

# MLlib's probability is the logistic of twice the margin
_LOG_ODDS_PER_MARGIN = 2.0
# models of up to so many nodes are sent to every task, some 60 bytes each; larger ones are dealt by trees
MAX_NODES = 500_000
# rows that meet a share of a large model's trees in one task
ROWS_PER_PART = 4_096
# rows that are walked through a tree together
_ROWS_PER_WALK = 512
LOG_ODDS, PROBABILITY = "log-odds", "probability"

# left, right, feature, threshold, missing_left, value, n of one tree's nodes by number; plain arrays, so that executors
# unpickle them without this module
Tree = tuple[np.ndarray, ...]
_TREE = ["left", "right", "feature", "threshold", "missing_left", "value", "n"]


def tree_nodes(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """The fitted trees as rows: (tree, node, left, right, feature, threshold, missing_left, value, n), root 0, leaves with left -1.

    ``value`` is what a leaf adds to the explained sum; ``n`` the training rows (or their curvature) that reached a node.
    """
    fitted = model.stages[-1]
    if hasattr(fitted, "node_table"):
        return fitted.node_table(spark).select("tree", "node", *_TREE)
    path = new_path(spark, "trees")
    fitted.write().save(path)
    drop_at_end(spark, path)
    stats = F.col("nodeData.impurityStats")
    if isinstance(fitted, RandomForestClassificationModel):
        # votes are averaged
        share = F.try_divide(F.get(stats, F.lit(1)), F.aggregate(stats, F.lit(0.0), lambda a, x: a + x))
        value = share / len(fitted.treeWeights)
    else:
        weights = F.array(*[F.lit(float(w)) for w in fitted.treeWeights])
        value = F.col("nodeData.prediction") * F.get(weights, F.col("treeID")) * _LOG_ODDS_PER_MARGIN
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("node"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.try_element_at("nodeData.split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold"),
        F.lit(False).alias("missing_left"),
        value.alias("value"),
        F.col("nodeData.rawCount").cast("double").alias("n"),
    )


def is_tree_model(model: PipelineModel) -> bool:
    last = model.stages[-1]
    return hasattr(last, "node_table") or isinstance(last, (GBTClassificationModel, RandomForestClassificationModel))


def unit_of(model: PipelineModel) -> str | None:
    """What contributions add up to: log-odds, the probability itself, or None where there are none."""
    last = model.stages[-1]
    if hasattr(last, "node_table"):
        return last.unit
    if isinstance(last, RandomForestClassificationModel):
        return PROBABILITY
    # a calibrated kernel machine ends in a linear model of one margin: no feature has a share in it
    linear = isinstance(last, LogisticRegressionModel) and len(model.stages) == 2
    return LOG_ODDS if linear or is_tree_model(model) else None


class TreeTable:
    """A model's trees, read once: node table, its size and the expected sum over the training rows."""

    def __init__(self, model: PipelineModel, spark: SparkSession) -> None:
        fitted = model.stages[-1]
        self.nodes = stored(tree_nodes(model, spark), "nodes")
        # of a leaf, the shares of training rows along its path multiply to its own share
        leaf = F.when(F.col("left") < 0, F.col("value") * F.col("n"))
        of_trees = self.nodes.groupBy("tree").agg((F.sum(leaf) / F.max("n")).alias("mean"), F.count("*").alias("n_nodes"))
        mean, self.n_nodes = of_trees.agg(F.sum("mean"), F.sum("n_nodes")).first()
        self.base_value = mean + (fitted.getOrDefault(fitted.base) if hasattr(fitted, "base") else 0.0)

    def packed(self) -> DataFrame:
        return packed_trees(self.nodes)

    def collected(self) -> list[Tree] | None:
        """All trees, of a model of at most ``MAX_NODES`` nodes."""
        if self.n_nodes > MAX_NODES:
            return None
        table = self.nodes.toPandas().sort_values(["tree", "node"])
        return [_arrays(nodes) for _, nodes in table.groupby("tree")]


def packed_trees(nodes: DataFrame) -> DataFrame:
    """(tree, nodes): one row per tree."""
    return nodes.groupBy("tree").agg(F.collect_list(F.struct("node", *_TREE)).alias("nodes"))


def _arrays(nodes: pd.DataFrame) -> Tree:
    kinds = (np.int64, np.int64, np.int64, float, bool, float, float)
    return tuple(nodes[c].fillna(0).to_numpy(dtype=k) for c, k in zip(_TREE, kinds, strict=True))


def _depth(left: np.ndarray, right: np.ndarray) -> int:
    level, depth = np.array([0]), 0
    while True:
        level = level[left[level] >= 0]
        if not len(level):
            return depth
        level, depth = np.concatenate([left[level], right[level]]), depth + 1


def tree_shares(x: np.ndarray, tree: Tree) -> np.ndarray:
    """Contributions of one tree to rows of features: (rows, features)."""
    left, right, feature, threshold, missing_left, value, n = tree
    out = np.zeros((x.shape[1], len(x)))
    depth = _depth(left, right)
    if not depth:
        return out.T
    # a path of m features needs m / 2 points
    points, weights = np.polynomial.legendre.leggauss((min(depth, x.shape[1]) + 1) // 2)
    t, weights = ((points + 1) / 2)[:, None], weights / 2
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 2 * depth + 1_000))

    def walk(node: int, product: np.ndarray, known: dict) -> np.ndarray:
        """Sum over the leaves below of value times the product of all their path features' terms, at each point."""
        if left[node] < 0:
            return value[node] * product
        f = feature[node]
        goes_left = x[:, f] <= threshold[node]
        if missing_left[node]:
            goes_left |= np.isnan(x[:, f])
        before = known.get(f)
        total = 0.0
        for child, side in ((left[node], goes_left), (right[node], ~goes_left)):
            agrees, share, above = side.astype(float), n[child] / n[node], product
            if before is not None:
                agrees, share, above = agrees * before[0], share * before[1], product / before[2]
            term = share * (1 - t) + agrees * t
            below = walk(child, above * term, {**known, f: (agrees, share, term)})
            out[f] += (agrees - share) * (weights @ (below / term))
            if before is not None:
                # these leaves have the feature's narrower bounds: take back what the wider ones will add
                out[f] -= (before[0] - before[1]) * (weights @ (below / before[2]))
            total = total + below
        return total

    walk(0, np.ones((len(t), len(x))), {})
    return out.T


def _shares_of_trees(x: np.ndarray, trees: list[Tree]) -> np.ndarray:
    """Contributions to rows of features; rows between the same thresholds are walked once."""
    inner = [tree[0] >= 0 for tree in trees]
    feature, threshold = (np.concatenate([tree[k][i] for tree, i in zip(trees, inner, strict=True)]) for k in (2, 3))
    first, which = alike(x, feature, threshold)
    x = x[first]
    out = np.zeros(x.shape)
    for begin in range(0, len(x), _ROWS_PER_WALK):
        for tree in trees:
            out[begin : begin + _ROWS_PER_WALK] += tree_shares(x[begin : begin + _ROWS_PER_WALK], tree)
    return out[which]


def with_attributions(
    df: DataFrame, model: PipelineModel, out: str = "shap", trees: TreeTable | None = None
) -> DataFrame:
    """Append one contribution per feature column, ``base_value`` and ``unit``.

    Contributions and base value sum to the row's log-odds for boosted trees and linear models, and to its probability for
    forests; a model without shares of features has nulls. ``df`` holds the assembled vector; ``trees`` saves reading
    a tree model again when it is applied many times. A model of up to ``MAX_NODES`` nodes goes to every task and no row
    moves. Of a larger one, groups of trees meet parts of the rows in tasks, and a row's shares are summed.
    """
    unit = F.lit(unit_of(model)).alias("unit")
    vector = vector_to_array(model.stages[0].getOutputCol())
    if unit_of(model) is None:
        nothing = {out: F.lit(None).cast("array<double>"), "base_value": F.lit(None).cast("double")}
        return df.withColumns({**nothing, "unit": unit.cast("string")})
    if not is_tree_model(model):
        return _linear_attributions(df, model, out).withColumn("unit", unit)
    trees = trees or TreeTable(model, df.sparkSession)
    collected = trees.collected()
    if collected is None:
        explained = _dealt_attributions(df, vector, trees, out)
    else:
        width = len(model.stages[0].getInputCols())
        shared = df.sparkSession.sparkContext.broadcast(collected)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def attribute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                x = np.stack(batch.to_numpy()) if len(batch) else np.empty((0, width))
                yield pd.Series(list(_shares_of_trees(x, shared.value)))

        explained = df.withColumn(out, attribute(vector))
    return explained.withColumns({"base_value": F.lit(trees.base_value), "unit": unit})


def _dealt_attributions(df: DataFrame, vector: Column, trees: TreeTable, out: str) -> DataFrame:
    return dealt(df, vector, trees.packed(), trees.n_nodes, lambda x, tree: _shares_of_trees(x, [tree]), out)


def dealt(df: DataFrame, vector: Column, packed: DataFrame, n_nodes: int, each: Callable[[np.ndarray, Tree], np.ndarray], out: str) -> DataFrame:
    """``df`` with the sum over all trees of ``each(rows, tree)``, an array per row.

    Every part of the rows meets every group of trees, of about ``MAX_NODES`` nodes, in one task; no task holds all of either.
    """
    rows = stored(df.withColumn("_row", F.monotonically_increasing_id()), "explained")
    n_parts = rows.count() // ROWS_PER_PART + 1
    n_groups = n_nodes // MAX_NODES + 1
    part, group = F.pmod(F.xxhash64("_row"), F.lit(n_parts)), F.pmod(F.xxhash64("tree"), F.lit(n_groups))
    groups, parts = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (n_groups, n_parts))
    some_rows = rows.select("_row", vector.alias("x"), part.cast("int").alias("part"), groups.alias("group"))
    some_trees = packed.select("tree", "nodes", group.cast("int").alias("group"), parts.alias("part"))

    def meet(x: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(some):
            return pd.DataFrame({"_row": pd.Series(dtype="int64"), "sums": pd.Series(dtype=object)})
        values = np.stack(x["x"].to_numpy())
        trees = [_arrays(pd.DataFrame(list(nodes)).sort_values("node")) for nodes in some.sort_values("tree")["nodes"]]
        return pd.DataFrame({"_row": x["_row"], "sums": list(sum(each(values, tree) for tree in trees))})

    met = some_rows.groupBy("part", "group").cogroup(some_trees.groupBy("part", "group"))
    sums = met.applyInPandas(meet, "_row long, sums array<double>")
    summed = sums.groupBy("_row").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias(out))
    return rows.join(summed, "_row", "left").drop("_row")


def _linear_attributions(df: DataFrame, model: PipelineModel, out: str) -> DataFrame:
    """Coefficient times value; the base is the intercept, a row of zeros."""
    fitted = model.stages[-1]
    weights = F.array(*[F.lit(float(w)) for w in fitted.coefficients.toArray()])
    vector = vector_to_array(model.stages[0].getOutputCol())
    shares = F.zip_with(vector, weights, lambda x, w: x * w)
    return df.withColumns({out: shares, "base_value": F.lit(float(fitted.intercept))})


# --- models without trees -------------------------------------------------------------

# rows that stand for absent features, and the sets of present features that are tried; all rows are explained with the same ones
MAX_BACKGROUND = 64
N_COALITIONS = 512


def coalitions(width: int, n: int = N_COALITIONS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(masks, weights): all sets of some but not all features if there are at most ``n``, else ``n`` drawn by the Shapley kernel.

    Drawn sets come with their complements.
    """
    if width < 2:
        return np.zeros((0, width), dtype=bool), np.zeros(0)
    sizes = np.arange(1, width)
    # a size's share of the kernel's weight; within a size all sets are alike
    share = 1.0 / (sizes * (width - sizes))
    if 2**width - 2 <= n:
        masks = (np.arange(1, 2**width - 1)[:, None] >> np.arange(width)) % 2 == 1
        size = masks.sum(axis=1)
        return masks, share[size - 1] / np.array([comb(width, int(k)) for k in size])
    rng = np.random.default_rng(seed)
    drawn = np.zeros((n // 2, width), dtype=bool)
    for row, size in zip(drawn, rng.choice(sizes, size=n // 2, p=share / share.sum()), strict=True):
        row[rng.permutation(width)[:size]] = True
    return np.concatenate([drawn, ~drawn]), np.ones(2 * (n // 2))


def _least_squares(masks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(features, sets + 1): what turns the gains of the sets, and of all features, into shares that add up to the latter."""
    width = masks.shape[1]
    if width == 1:
        return np.ones((1, 1))
    # the last share is what the others leave: one column less
    z = masks.astype(float)
    design = z[:, :-1] - z[:, -1:]
    fit = np.linalg.pinv(design * np.sqrt(weights)[:, None]) * np.sqrt(weights)
    first = np.c_[fit, -fit @ z[:, -1]]
    return np.r_[first, [np.r_[np.zeros(len(masks)), 1.0] - first.sum(axis=0)]]


def sampled_attributions(
    df: DataFrame, model: PipelineModel, background: DataFrame, out: str = "shap", n_coalitions: int = N_COALITIONS, seed: int = 42
) -> DataFrame:
    """Append one contribution per feature column to the probability, ``base_value`` and ``unit``, for any fitted model.

    A set of features is worth the mean probability when all others are taken from ``background`` (its first ``MAX_BACKGROUND`` rows by id), less that
    with none. Shares are the weighted least squares fit to the worth of all sets, or of seeded ones beyond ``n_coalitions`` (Lundberg and
    Lee 2017); they add up to the probability less ``base_value``. ``df`` holds id and the feature columns; a row is scored once for each
    set and background row, and only means come together.
    """
    names = list(model.stages[0].getInputCols())
    vector = model.stages[0].getOutputCol()
    rest = PipelineModel(model.stages[1:])
    masks, weights = coalitions(len(names), n_coalitions, seed)
    matrix = _least_squares(masks, weights)
    fill = [[float(r[c]) for c in names] for r in background.orderBy("id").select(*names).limit(MAX_BACKGROUND).collect()]
    if not fill:
        raise ValueError("no background rows")
    spark = df.sparkSession

    def probability(rows: DataFrame, keys: list[str]) -> DataFrame:
        scored = rest.transform(rows.select(*keys, array_to_vector("_x").alias(vector)))
        return scored.groupBy(*keys).agg(F.avg(vector_to_array("probability")[1]).alias("_p"))

    rows = stored(df.withColumn("_row", F.monotonically_increasing_id()), "explained")
    x = F.array(*[F.col(c).cast("double") for c in names])
    # at most N_COALITIONS + 1 sets and MAX_BACKGROUND rows
    sets = [(i, [bool(b) for b in m]) for i, m in enumerate([*masks, np.ones(len(names), dtype=bool)])]
    sets = spark.createDataFrame(sets, "_set int, _mask array<boolean>")
    others = spark.createDataFrame([(f,) for f in fill], "_fill array<double>")
    grid = rows.select("_row", x.alias("_own")).crossJoin(F.broadcast(sets)).crossJoin(F.broadcast(others))
    mixed = F.transform("_own", lambda v, i: F.when(F.get("_mask", i), v).otherwise(F.get("_fill", i)))
    worth = probability(grid.withColumn("_x", mixed), ["_row", "_set"])
    base = probability(others.withColumnRenamed("_fill", "_x").withColumn("_row", F.lit(0)), ["_row"]).first()["_p"]
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("_set", "_p"))), lambda s: s["_p"] - F.lit(base))
    gains = worth.groupBy("_row").agg(in_order.alias("_gains"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def shares(batch: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(batch.to_numpy()) @ matrix.T)) if len(batch) else pd.Series(dtype=object)

    explained = rows.join(gains.select("_row", shares("_gains").alias(out)), "_row", "left").drop("_row")
    return explained.withColumns({"base_value": F.lit(base), "unit": F.lit(PROBABILITY)})


# --- reading contributions ----------------------------------------------------------


def long_contributions(df: DataFrame, names: list[str], values: str = "shap") -> DataFrame:
    """(id, feature_ix, feature, impact), one row per feature."""
    exploded = df.select("id", F.posexplode(values).alias("feature_ix", "impact"))
    feature = F.element_at(F.array(*map(F.lit, names)), F.col("feature_ix") + 1)
    return exploded.select("id", "feature_ix", feature.alias("feature"), "impact")


def global_importance(df: DataFrame, names: list[str], values: str = "shap") -> DataFrame:
    """(feature_ix, feature, mean_abs_impact, mean_impact), largest first: one pass over the vectors, no row per feature."""
    vector = array_to_vector(values)
    summary = df.select(Summarizer.metrics("mean", "normL1", "count").summary(vector).alias("s")).select("s.*")
    each = F.posexplode(F.arrays_zip(vector_to_array("mean").alias("mean"), vector_to_array("normL1").alias("total")))
    rows = summary.select("count", each.alias("feature_ix", "v"))
    feature = F.element_at(F.array(*map(F.lit, names)), F.col("feature_ix") + 1)
    return rows.select(
        "feature_ix", feature.alias("feature"), (F.col("v.total") / F.col("count")).alias("mean_abs_impact"), F.col("v.mean").alias("mean_impact")
    ).orderBy(F.col("mean_abs_impact").desc(), "feature_ix")


# Wording of a contribution.
TOWARD_AI, TOWARD_HUMAN = "toward AI-generated", "toward human-written"
IMPACT_FORMAT = "%s (impact=%+.3f, pushes %s)"


def impact_direction(impact: Column) -> Column:
    return F.when(impact > 0, TOWARD_AI).otherwise(TOWARD_HUMAN)


def impact_text(feature: Column, impact: Column) -> Column:
    return F.format_string(IMPACT_FORMAT, feature, impact, impact_direction(impact))


def top_contributions(values: Column, names: list[str], k: int = 5) -> Column:
    """The k largest contributions by absolute value as (feature, impact, direction) structs,
    ties in feature order. Sorting is inside the row's own array."""
    ranked = F.transform(
        values, lambda v, i: F.struct((-F.abs(v)).alias("key"), i.alias("ix"), v.alias("impact"))
    )
    labels = F.array(*map(F.lit, names))
    return F.transform(
        F.slice(F.sort_array(ranked), 1, k),
        lambda r: F.struct(
            F.element_at(labels, r["ix"] + 1).alias("feature"),
            r["impact"].alias("impact"),
            impact_direction(r["impact"]).alias("direction"),
        ),
    )
