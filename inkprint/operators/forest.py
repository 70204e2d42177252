"""Random forests without a limit on depth.

Nodes with many rows are split level by level from merged tables, as many trees at once as fit. A node whose rows fit one task is
queued: its rows go there, and the subtree is finished on them, however deep. A larger node that no cut parts is a leaf, and its rows stay where
they are. The nodes stay in a written table; the driver holds those of the upper levels alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprint.operators import explain
from inkprint.operators.boosting import NODE_SCHEMA, ROWS_PER_BLOCK, Block, ModelColumns, binned_rows, blocks_of, drawn, leaf_sums, param, scoring_arrays, sums_of_alike
from inkprint.storage import stored

# a node of no more rows is finished in one task
LOCAL_ROWS = 16_384
# rows, over all trees, that move in one pass of finishing
PASS_ROWS = 50_000_000
# nodes whose tables are merged in one job: some 50 kB each for 12 columns
NODES_PER_JOB = 512
# rows that move together
_ROWS_PER_PIECE = 2_048
_BINS = 256
# chances of up to 0, 1, ... copies of a row in a bootstrap sample: a Poisson count of mean 1
_COPIES = np.cumsum(np.exp(-1) / np.cumprod(np.r_[1.0, np.arange(1.0, 9.0)]))

# nodes as they are grown; they are numbered by texts, of any length
_GROWN = "tree long, node string, left string, right string, feature int, bin int, n long, share double, gain double"

# (feature, bin, impurity decrease) of a split
Split = tuple[int, int, float]


def copies(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is in a tree's sample."""
    return np.searchsorted(_COPIES, drawn(keys, seed, 2 * tree), side="right")


def column_order(width: int, seed: int, tree: int, node: int) -> np.ndarray:
    """The order in which a node (root 1, children 2n and 2n + 1) looks at columns."""
    salt = (node * 1_000_003 + tree) % (1 << 61)
    return np.argsort(drawn(np.arange(width), seed, 2 * salt + 1), kind="stable")


def best_split(tables: np.ndarray, columns: np.ndarray) -> Split | None:
    """The first best cut by Gini of (columns, bins, (rows, rows of class 1)); None where no cut parts the rows."""
    below = np.cumsum(tables, axis=1).astype(float)
    total = below[:, -1:, :]
    above = total - below
    fine = (below[..., 0] > 0) & (above[..., 0] > 0)
    if not fine.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        # a node's impurity times its rows is 2 p (1 - p) n
        parts = [2 * s[..., 1] * (1 - s[..., 1] / s[..., 0]) for s in (below, above)]
    whole = 2 * total[0, 0, 1] * (1 - total[0, 0, 1] / total[0, 0, 0])
    gain = np.where(fine, whole - np.nan_to_num(parts[0] + parts[1]), -np.inf)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return int(columns[f]), int(b), max(0.0, float(gain[f, b]))


def _tables(bins: np.ndarray, labels: np.ndarray, weights: np.ndarray, columns: np.ndarray) -> np.ndarray:
    out = np.empty((len(columns), _BINS, 2), dtype=np.int64)
    positive = weights * labels
    for i, f in enumerate(columns):
        out[i, :, 0] = np.bincount(bins[:, f], weights=weights, minlength=_BINS)
        out[i, :, 1] = np.bincount(bins[:, f], weights=positive, minlength=_BINS)
    return out


def grow_subtree(bins: np.ndarray, labels: np.ndarray, weights: np.ndarray, seed: int, tree: int, root: int, tries: int) -> list[tuple]:
    """Rows (tree, node, left, right, feature, bin, rows, share, gain) of a whole subtree; nodes are numbered from their root.

    A node is split while it has rows of both classes and a cut that parts them: ``tries`` columns are looked at, and so many more as long as none
    of them does.
    """
    found, stack = [], [(root, np.arange(len(labels)))]
    while stack:
        node, rows = stack.pop()
        w, y = weights[rows], labels[rows]
        n, positive = int(w.sum()), float((w * y).sum())
        split = None
        if 0 < positive < n:
            order = column_order(bins.shape[1], seed, tree, node)
            for begin in range(0, len(order), tries):
                columns = order[begin : begin + tries]
                split = best_split(_tables(bins[rows], y, w, columns), columns)
                if split:
                    break
        if split is None:
            found.append((tree, node, 0, 0, -1, 0, n, positive / n, 0.0))
            continue
        f, b, gain = split
        side = bins[rows, f] <= b
        found.append((tree, node, 2 * node, 2 * node + 1, f, b, n, positive / n, gain))
        stack += [(2 * node, rows[side]), (2 * node + 1, rows[~side])]
    return found


# the upper part of a tree: node -> (feature, bin) where it is split
Upper = dict[int, tuple[int, int]]


def _places(bins: np.ndarray, upper: Upper) -> np.ndarray:
    """The lowest node of the upper part that each row reaches."""
    at = np.ones(len(bins), dtype=np.int64)
    waiting = [(1, np.arange(len(bins)))]
    while waiting:
        node, rows = waiting.pop()
        if node not in upper or not len(rows):
            at[rows] = node
            continue
        f, b = upper[node]
        side = bins[rows, f] <= b
        waiting += [(2 * node, rows[side]), (2 * node + 1, rows[~side])]
    return at


class DeepForest(Estimator, ModelColumns, DefaultParamsReadable, DefaultParamsWritable):
    """Bootstrap samples, sqrt(columns) tries a split, Gini, leaves of one class or of equal rows.

    Values are binned by quantiles, as for boosting; missing ones are above all others. The same forest comes out however rows are dealt and
    wherever subtrees are finished.
    """

    labelCol = param("labelCol", "0 or 1", TypeConverters.toString)
    trees = param("trees", "number of trees", TypeConverters.toInt)
    seed = param("seed", "random seed", TypeConverters.toInt)
    localRows = param("localRows", "rows of a node that is finished in one task", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", trees=300, seed=42, localRows=LOCAL_ROWS):
        super().__init__()
        self._setDefault(labelCol="label", trees=300, seed=42, localRows=LOCAL_ROWS)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ForestModel:
        rows, edges, _, n = binned_rows(df, self.getOrDefault(self.labelCol), self.getOrDefault(self.featuresCol))
        n_trees, width = self.getOrDefault(self.trees), len(edges)
        blocks = rows.coalesce(-(-n // ROWS_PER_BLOCK)).rdd.map(tuple).mapPartitions(lambda r: blocks_of(r, 0.0))
        blocks.persist(StorageLevel.MEMORY_AND_DISK)
        spark = df.sparkSession
        try:
            per_pass = max(1, min(n_trees, PASS_ROWS // n))
            parts = [self._grow(spark, blocks, n, range(t, min(t + per_pass, n_trees)), width) for t in range(0, n_trees, per_pass)]
        finally:
            blocks.unpersist()
        grown = parts[0]
        for part in parts[1:]:
            grown = grown.unionByName(part)
        return self._copyValues(ForestModel(_node_table(grown, edges, n_trees), width, n_trees))

    def _grow(self, spark: SparkSession, blocks: RDD, n: int, trees: range, width: int) -> DataFrame:
        """Nodes of some trees: upper levels from merged tables, the subtrees below each in one task."""
        seed, local = self.getOrDefault(self.seed), self.getOrDefault(self.localRows)
        tries = max(1, int(np.sqrt(width)))
        upper: dict[int, Upper] = {t: {} for t in trees}
        done: list[tuple] = []
        # nodes that are finished in a task
        queued: dict[int, set[int]] = {t: set() if n > local else {1} for t in trees}
        # a root has about n rows
        active = [(t, 1, 0) for t in trees] if n > local else []
        while active:
            following = []
            for begin in range(0, len(active), NODES_PER_JOB):
                some = active[begin : begin + NODES_PER_JOB]
                merged = _merged(blocks, some, upper, width, seed, tries)
                for (tree, node, turn), tables in zip(some, merged, strict=True):
                    total, positive = tables[0].sum(axis=0)
                    order = column_order(width, seed, tree, node)[turn * tries : (turn + 1) * tries]
                    split = best_split(tables[: len(order)], order) if 0 < positive < total else None
                    if split is None and 0 < positive < total and (turn + 1) * tries < width:
                        following.append((tree, node, turn + 1))
                    elif total <= local:
                        queued[tree].add(node)
                    elif split is None:
                        # a leaf of any size: its rows need not meet
                        done.append((tree, node, 0, 0, -1, 0, int(total), float(positive / total), 0.0))
                    else:
                        f, b, gain = split
                        upper[tree][node] = (f, b)
                        done.append((tree, node, 2 * node, 2 * node + 1, f, b, int(total), float(positive / total), gain))
                        following += [(tree, 2 * node, 0), (tree, 2 * node + 1, 0)]
            active = following
        whole = _finished(spark, blocks, upper, queued, seed, tries)
        texts = [(t, str(a), str(b), str(c), *rest) for t, a, b, c, *rest in done]
        return stored(whole.unionByName(spark.createDataFrame(texts, _GROWN)) if texts else whole, "forest")


def _merged(blocks: RDD, some: list[tuple[int, int, int]], upper: dict[int, Upper], width: int, seed: int, tries: int) -> np.ndarray:
    """(nodes, tries, bins, 2): tables of the columns that each (tree, node, turn) looks at."""
    by_tree: dict[int, list[tuple[int, int, int]]] = {}
    for slot, (tree, node, turn) in enumerate(some):
        by_tree.setdefault(tree, []).append((slot, node, turn))
    uppers = {t: upper[t] for t in by_tree}
    empty = np.zeros((len(some), tries, _BINS, 2), dtype=np.int64)

    def add(total: np.ndarray, block: Block) -> np.ndarray:
        bins, labels, keys, _ = block
        total = total.copy()
        for tree, nodes in by_tree.items():
            weights, at = copies(keys, seed, tree), _places(bins, uppers[tree])
            for slot, node, turn in nodes:
                rows = np.flatnonzero((at == node) & (weights > 0))
                columns = column_order(width, seed, tree, node)[turn * tries : (turn + 1) * tries]
                total[slot, : len(columns)] += _tables(bins[rows], labels[rows], weights[rows], columns)
        return total

    return blocks.treeAggregate(empty, add, np.add, depth=2)


def _finished(spark: SparkSession, blocks: RDD, upper: dict[int, Upper], queued: dict[int, set[int]], seed: int, tries: int) -> DataFrame:
    """Nodes of the subtrees below queued nodes: the rows of each meet in one task. They are sorted by node on the way, on disk beyond a bound."""

    def scattered(block: Block) -> Iterator[tuple]:
        bins, labels, keys, _ = block
        for tree, nodes in upper.items():
            if not queued[tree]:
                continue
            weights, at = copies(keys, seed, tree), _places(bins, nodes)
            for node in np.unique(at[weights > 0]):
                if int(node) not in queued[tree]:
                    continue
                rows = np.flatnonzero((at == node) & (weights > 0))
                for begin in range(0, len(rows), _ROWS_PER_PIECE):
                    some = rows[begin : begin + _ROWS_PER_PIECE]
                    yield tree, str(node), bins[some].tobytes(), labels[some].tobytes(), weights[some].astype(np.int64).tobytes()

    def finish(pieces: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(pieces["tree"].iat[0]), int(pieces["node"].iat[0])
        labels, weights = np.frombuffer(b"".join(pieces["labels"])), np.frombuffer(b"".join(pieces["weights"]), dtype=np.int64)
        bins = np.frombuffer(b"".join(pieces["bins"]), dtype=np.uint8).reshape(len(labels), -1)
        grown = grow_subtree(bins, labels, weights, seed, tree, node, tries)
        names = [c.split()[0] for c in _GROWN.split(", ")]
        return pd.DataFrame([(t, str(a), str(b), str(c), *rest) for t, a, b, c, *rest in grown], columns=names)

    pieces = spark.createDataFrame(blocks.flatMap(scattered), "tree long, node string, bins binary, labels binary, weights binary")
    return pieces.groupBy("tree", "node").applyInPandas(finish, _GROWN)


def _node_table(grown: DataFrame, edges: list[np.ndarray], n_trees: int) -> DataFrame:
    """``NODE_SCHEMA`` rows, nodes numbered within their trees; values are shares of class 1 over the number of trees."""
    cuts = [[*map(float, e), float("inf")] for e in edges]

    def number(nodes: pd.DataFrame) -> pd.DataFrame:
        # roots first: numbers of nodes far down have hundreds of digits
        order = nodes.assign(size=nodes["node"].str.len()).sort_values(["size", "node"], ignore_index=True)
        place = {name: i for i, name in enumerate(order["node"])}
        inner = (order["feature"] >= 0).to_numpy()
        threshold = [cuts[f][min(b, len(cuts[f]) - 1)] if i else np.nan for f, b, i in zip(order["feature"], order["bin"], inner, strict=True)]
        left, right = ([place[name] if i else -1 for name, i in zip(order[side], inner, strict=True)] for side in ("left", "right"))
        return pd.DataFrame(
            {
                "tree": order["tree"].astype("int32"), "node": np.arange(len(order)), "left": left, "right": right, "feature": order["feature"],
                "threshold": threshold, "missing_left": False, "value": order["share"] / n_trees, "n": order["n"].astype(float), "gain": order["gain"],
            }
        )

    return stored(grown.groupBy("tree").applyInPandas(number, NODE_SCHEMA), "forest-nodes")


class ForestModel(Model, ModelColumns, MLReadable, MLWritable):
    """A table of nodes; the probability is the mean over the trees of the share of class 1 in a row's leaf."""

    unit = "probability"
    width = param("width", "number of features", TypeConverters.toInt)
    trees = param("trees", "number of trees", TypeConverters.toInt)

    def __init__(self, nodes: DataFrame | None = None, width: int = 0, trees: int = 1) -> None:
        super().__init__()
        self.nodes = nodes
        self._set(width=width, trees=trees)

    def node_table(self, spark: SparkSession) -> DataFrame:
        return self.nodes

    @property
    def featureImportances(self) -> np.ndarray:
        """Impurity decreases of a column's splits, as shares within each tree, averaged over trees."""
        splits = self.nodes.where("left >= 0").groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
        of_tree = splits.groupBy("tree").agg(F.sum("gain").alias("_all")).where("_all > 0")
        shares = splits.join(of_tree, "tree").groupBy("feature").agg(F.sum(F.col("gain") / F.col("_all")).alias("share"))
        out = np.zeros(self.getOrDefault(self.width))
        for r in shares.collect():  # a row per column
            out[r["feature"]] = r["share"]
        return out / out.sum() if out.sum() else out

    def _transform(self, df: DataFrame) -> DataFrame:
        vector = vector_to_array(self.getOrDefault(self.featuresCol))
        n_nodes = self.nodes.count()
        if n_nodes > explain.MAX_NODES:
            scored = explain.dealt(df, vector, explain.packed_trees(self.nodes), n_nodes, _tree_scores, "_p").withColumn("_p", F.col("_p")[0])
        else:
            shared = df.sparkSession.sparkContext.broadcast(scoring_arrays(self.nodes.toPandas()))

            @F.pandas_udf(T.DoubleType())
            def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                for batch in batches:
                    yield pd.Series(sums_of_alike(np.stack(batch.to_numpy()), shared.value)) if len(batch) else pd.Series(dtype=float)

            scored = df.withColumn("_p", probability(vector))
        prediction = (F.col("_p") > 0.5).cast("double")
        return scored.withColumns(
            {
                self.getOrDefault(self.probabilityCol): array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))),
                self.getOrDefault(self.predictionCol): prediction,
            }
        ).drop("_p")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


def _tree_scores(x: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    left, right, feature, threshold, missing_left, value, _ = tree
    nodes = {"tree": 0, "node": np.arange(len(left)), "left": left, "right": right, "feature": feature, "threshold": threshold}
    return leaf_sums(x, scoring_arrays(pd.DataFrame({**nodes, "missing_left": missing_left, "value": value})))[:, None]


class _Writer(MLWriter):
    def __init__(self, instance: ForestModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.nodes.write.parquet(f"{path}/data")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ForestModel(self.sparkSession.read.schema(NODE_SCHEMA).parquet(f"{path}/data"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
