"""Second-order boosted trees for two classes, grown level by level over binned columns.

Values are binned once, by quantiles, and stored as a byte a column. Rows of equal label and bins have equal margins, so they are one
pattern and its drawn rows a count. Up to ``ROWS_PER_BLOCK`` patterns are grown in one task, whatever the number of rows: one job counts
each tree's rows of each pattern. With more, a level of a tree is one job: tasks add up gradients and curvatures of the patterns in the nodes to
split, per column and bin; tables are merged by tree aggregation; of two siblings only the one with less curvature is counted, the other is its
parent less that. The driver holds tables of bins, whatever the number of rows. Sums are of integers, so a fit does not depend on how
rows are dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprint.storage import stored

# rows of a block, about; a fit of no more rows, or of no more different ones, runs in one task
ROWS_PER_BLOCK = 16_384
# margins are brought up to date after so many trees; until then jobs add the newer trees' themselves
_TREES_PER_STATE = 25
# with more rows, the quantiles of so many columns are sketched in a job: a task holds up to some 2 MB for each
SKETCH_ROWS, SKETCH_COLUMNS = 200_000, 32
_MAX_BINS = 255  # the 256th is for missing values
_HALF = 26  # bits of the lower half of a summed number
NODE_SCHEMA = "tree int, node int, left int, right int, feature int, threshold double, missing_left boolean, value double, n double, gain double"


def param(name: str, doc: str, kind=TypeConverters.toFloat) -> Param:
    return Param(Params._dummy(), name, doc, kind)


class ModelColumns(Params):
    featuresCol = param("featuresCol", "vector column", TypeConverters.toString)
    probabilityCol = param("probabilityCol", "vector of both classes' probabilities", TypeConverters.toString)
    predictionCol = param("predictionCol", "1 where the second class is likelier", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(featuresCol="features", probabilityCol="probability", predictionCol="prediction")


@dataclass
class Tree:
    """Nodes by number, the root first; a leaf has left -1. Rows at or below ``bin`` go left."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for column, x in zip(self.columns(), (0, 0, False, -1, -1, value, cover, 0.0), strict=True):
            column.append(x)
        return len(self.left) - 1

    def columns(self) -> tuple[list, ...]:
        return self.feature, self.bin, self.missing_left, self.left, self.right, self.value, self.cover, self.gain

    def node_of(self, bins: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """The lowest node of each row of bins; ``missing`` is each column's bin for that."""
        at = np.zeros(len(bins), dtype=np.int64)
        feature, cut, missing_left, left, right = (np.array(x) for x in self.columns()[:5])
        while True:
            inner = np.flatnonzero(left[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            value = bins[inner, feature[node]]
            goes_left = np.where(value == missing[feature[node]], missing_left[node], value <= cut[node])
            at[inner] = np.where(goes_left, left[node], right[node])

    def margins(self, bins: np.ndarray, missing: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.node_of(bins, missing)]


# Some rows: their bins, labels, hashes, and margins of the trees that a state is up to date with; a plain
# tuple, so that executors unpickle it without this module.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


# The different rows among some: their bins and labels; what tells how often each is drawn, either (hashes of rows, the pattern of each)
# or a count for each turn and pattern; and margins.
Patterns = tuple[np.ndarray, np.ndarray, "tuple[np.ndarray, np.ndarray] | np.ndarray", np.ndarray]


def _patterns(block: Block) -> Patterns:
    bins, labels, keys, margins = block
    whole = np.ascontiguousarray(np.hstack([bins, labels.view(np.uint8).reshape(len(labels), -1)]))
    _, first, which = np.unique(whole.view(f"V{whole.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return bins[first], labels[first], (keys, which.astype(np.int32)), margins[first]


def _advanced(block: Patterns, trees: list[Tree], missing: np.ndarray) -> Patterns:
    bins, labels, rows, margins = block
    for tree in trees:
        margins = margins + tree.margins(bins, missing)
    return bins, labels, rows, margins


def blocks_of(rows: Iterator, base: float) -> Iterator[Block]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS_PER_BLOCK:
            yield _block(held, base)
            held = []
    if held:
        yield _block(held, base)


def _block(rows: list, base: float) -> Block:
    bins = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint8).reshape(len(rows), -1)
    labels, keys = np.array([r[0] for r in rows], dtype=np.float64), np.array([r[1] for r in rows], dtype=np.int64)
    return bins, labels, keys, np.full(len(rows), base)


def drawn(keys: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A number in [0, 1) for each key, the same for a seed and a turn."""
    salt = (seed * 0x9E3779B97F4A7C15 + turn * 0xBF58476D1CE4E5B9) % 2**64
    x = keys.astype(np.uint64) ^ np.uint64(salt)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


@dataclass(frozen=True)
class _Level:
    """What a task needs to count a level: newer trees, the tree so far, and the nodes to count."""

    newer: list[Tree]
    tree: Tree
    nodes: list[int]
    turn: int
    seed: int
    rows: float
    scale: float
    starts: np.ndarray  # where each column's bins begin in a table

    def table(self, block: Patterns) -> np.ndarray:
        """(nodes, bins of all columns, 2): summed gradients and curvatures, times ``scale`` as integers."""
        missing = np.diff(self.starts) - 1
        bins, labels, rows, margins = _advanced(block, self.newer, missing)
        out = np.zeros((len(self.nodes), self.starts[-1], 2), dtype=np.int64)
        slot_of = np.full(len(self.tree.left), -1)
        slot_of[self.nodes] = np.arange(len(self.nodes))
        slot = slot_of[self.tree.node_of(bins, missing)]
        if isinstance(rows, tuple):
            keys, which = rows
            times = np.bincount(which[drawn(keys, self.seed, self.turn) < self.rows], minlength=len(bins))
        else:
            times = rows[self.turn]
        used = np.flatnonzero((slot >= 0) & (times > 0))
        p = 1 / (1 + np.exp(-margins[used]))
        weights = [np.rint(x * self.scale).astype(np.int64) * times[used] for x in (p - labels[used], p * (1 - p))]
        # halves of the whole numbers, whose sums stay below 2**53: exact
        halves = [((w >> _HALF).astype(np.float64), (w & ((1 << _HALF) - 1)).astype(np.float64)) for w in weights]
        for f, (start, end) in enumerate(zip(self.starts[:-1], self.starts[1:], strict=True)):
            cell = slot[used] * (end - start) + bins[used, f]
            for k, (high, low) in enumerate(halves):
                of_high, of_low = (np.bincount(cell, weights=w, minlength=len(self.nodes) * (end - start)).astype(np.int64) for w in (high, low))
                out[:, start:end, k] = ((of_high << _HALF) + of_low).reshape(len(self.nodes), -1)
        return out


def _merged(state: RDD, level: _Level) -> np.ndarray:
    empty = np.zeros((len(level.nodes), level.starts[-1], 2), dtype=np.int64)

    def add(total: np.ndarray, block: Patterns) -> np.ndarray:
        return total + level.table(block)

    return state.treeAggregate(empty, add, np.add, depth=2)


@dataclass(frozen=True)
class _Splits:
    """Gains of all cuts of a node's table."""

    starts: np.ndarray
    l2: float
    least_cover: float
    scale: float

    def best(self, table: np.ndarray, allowed: np.ndarray) -> tuple[float, int, int, bool, np.ndarray] | None:
        """(gain, column, bin, missing go left, sums of the left side) of the first best cut; None without a gain."""
        total = table[self.starts[0] : self.starts[1]].sum(axis=0) / self.scale
        column = np.repeat(np.arange(len(allowed)), np.diff(self.starts))
        # whole numbers: columns that cut alike gain alike; what overflows on the way is subtracted again
        running = np.cumsum(table, axis=0)
        begun = np.r_[np.zeros((1, 2), dtype=np.int64), running][self.starts[:-1]][column]
        missing = table[self.starts[1:] - 1][column]
        # cuts end at any bin but the last and the one for missing values
        cuts = np.arange(len(table)) < (self.starts[1:] - 2)[column]
        cuts &= allowed[column]
        best = None
        for goes_left in (False, True):
            left = (running - begun + (missing if goes_left else 0)) / self.scale
            right = total - left
            fine = cuts & (left[:, 1] >= self.least_cover) & (right[:, 1] >= self.least_cover)
            gain = np.where(fine, self._score(left) + self._score(right) - self._score(total), -np.inf)
            i = int(np.argmax(gain))
            if gain[i] > 1e-6 and (best is None or gain[i] > best[0]):
                best = float(gain[i]), int(column[i]), int(i - self.starts[column[i]]), goes_left, left[i]
        return best

    def _score(self, sums: np.ndarray) -> np.ndarray:
        return sums[..., 0] ** 2 / (sums[..., 1] + self.l2)


@dataclass(frozen=True)
class _Grower:
    """Grows a tree from merged tables, wherever these come from."""

    starts: np.ndarray
    depth: int
    rate: float
    rows: float
    columns: float
    l2: float
    least_cover: float
    seed: int
    scale: float

    def grow(self, turn: int, newer: list[Tree], merge: Callable[[_Level], np.ndarray]) -> Tree:
        starts, scale, width = self.starts, self.scale, len(self.starts) - 1
        allowed = np.zeros(width, dtype=bool)
        draws = np.argsort(drawn(np.arange(width), self.seed + 1, turn), kind="stable")
        allowed[draws[: max(1, round(width * self.columns))]] = True
        splits = _Splits(starts, self.l2, self.least_cover, scale)
        tree = Tree()

        def tables_of(nodes: list[int]) -> np.ndarray:
            return merge(_Level(newer, tree, nodes, turn, self.seed, self.rows, scale, starts))

        def totals(table: np.ndarray) -> np.ndarray:
            return table[starts[0] : starts[1]].sum(axis=0) / scale

        def new_node(sums: np.ndarray) -> int:
            return tree.add(float(-sums[0] / (sums[1] + self.l2) * self.rate), float(sums[1]))

        tree.add(0.0, 0.0)
        tables = {0: tables_of([0])[0]}
        root = totals(tables[0])
        tree.value[0], tree.cover[0] = float(-root[0] / (root[1] + self.l2) * self.rate), float(root[1])
        for depth in range(self.depth):
            pairs = []
            for node, table in tables.items():
                found = splits.best(table, allowed)
                if found is None:
                    continue
                tree.gain[node], tree.feature[node], tree.bin[node], tree.missing_left[node], left = found
                tree.left[node], tree.right[node] = new_node(left), new_node(totals(table) - left)
                pairs.append((node, tree.left[node], tree.right[node]))
            if not pairs or depth + 1 == self.depth:
                break
            light = [left if tree.cover[left] <= tree.cover[right] else right for _, left, right in pairs]
            counted = dict(zip(light, tables_of(light), strict=True))
            tables = {
                child: counted[child] if child in counted else tables[node] - counted[left + right - child]
                for node, left, right in pairs
                for child in (left, right)
            }
        return tree

    def grow_all(self, blocks: Iterator[Patterns], rounds: int) -> Iterator[list[Tree]]:
        """All trees of patterns that one task holds."""
        held, missing = list(blocks), np.diff(self.starts) - 1
        trees: list[Tree] = []
        for turn in range(rounds):
            trees.append(self.grow(turn, [], lambda level: sum(level.table(b) for b in held)))
            held = [_advanced(b, trees[-1:], missing) for b in held]
        yield [tuple(t.columns()) for t in trees]


class NewtonTrees(Estimator, ModelColumns, DefaultParamsReadable, DefaultParamsWritable):
    """Gradient boosting on logistic loss with second-order gains and leaves.

    A leaf is -G / (H + l2) times ``rate``, a split's gain what it adds to the sum of G^2 / (H + l2); a side needs a curvature of
    ``leastCover``. Each tree sees a hashed share ``rows`` of the rows and ``columns`` of the columns. Missing values (NaN) go to the
    side where they gain more. Labels are 0 and 1; rows with a null label or vector are left out. Rows of equal features and id are drawn together.
    """

    labelCol = param("labelCol", "0 or 1", TypeConverters.toString)
    rounds = param("rounds", "number of trees", TypeConverters.toInt)
    depth = param("depth", "levels of splits", TypeConverters.toInt)
    rate = param("rate", "shrinkage of leaves")
    rows = param("rows", "share of rows per tree")
    columns = param("columns", "share of columns per tree")
    l2 = param("l2", "added to a leaf's curvature")
    leastCover = param("leastCover", "least curvature of a side")
    maxBins = param("maxBins", "bins per column, at most 255", TypeConverters.toInt)
    seed = param("seed", "random seed", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, *, featuresCol="features", labelCol="label", rounds=300, depth=6, rate=0.05, rows=0.9, columns=0.9, l2=1.0, leastCover=1.0,
        maxBins=_MAX_BINS, seed=42,
    ):
        super().__init__()
        self._setDefault(
            labelCol="label", rounds=300, depth=6, rate=0.05, rows=0.9, columns=0.9, l2=1.0, leastCover=1.0, maxBins=_MAX_BINS, seed=42
        )
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> NewtonTreesModel:
        label, vector = self.getOrDefault(self.labelCol), self.getOrDefault(self.featuresCol)
        rows, edges, positive, n = binned_rows(df, label, vector, self.getOrDefault(self.maxBins))
        share = float(np.clip((positive + 0.5) / (n + 1), 1e-9, 1 - 1e-9))
        base = float(np.log(share / (1 - share)))
        starts = np.cumsum([0, *(len(e) + 2 for e in edges)])
        # sums of ``n`` numbers up to ``scale`` fit 63 bits, those of a block 53
        scale = float(2 ** min(62 - int(n).bit_length(), 38))
        names = (self.depth, self.rate, self.rows, self.columns, self.l2, self.leastCover, self.seed)
        grower = _Grower(starts, *(self.getOrDefault(p) for p in names), scale)
        rounds = self.getOrDefault(self.rounds)
        # tasks of many blocks: each level costs a task's start for every one of them
        sc = rows.sparkSession.sparkContext
        tasks = max(1, min(-(-n // ROWS_PER_BLOCK), 2 * sc.defaultParallelism))
        blocks = rows.coalesce(tasks).rdd.map(tuple).mapPartitions(partial(blocks_of, base=base))
        few = None if n <= ROWS_PER_BLOCK else _few_patterns(rows)
        if n <= ROWS_PER_BLOCK or few is not None:
            # nothing to merge: the same steps in one task, without a job for each
            if few is None:
                held = blocks.map(_patterns)
            else:
                held = sc.parallelize([0], 1).map(_counted(blocks, few, base, rounds, grower.seed, grower.rows))
            grown = held.mapPartitions(partial(grower.grow_all, rounds=rounds)).collect()[0]
            return self._copyValues(NewtonTreesModel(_node_rows([Tree(*t) for t in grown], edges), base, len(edges)))
        state = blocks.map(_patterns).persist(StorageLevel.MEMORY_AND_DISK)
        trees: list[Tree] = []
        current = 0  # trees that the state's margins hold
        missing = np.diff(starts) - 1
        try:
            for turn in range(rounds):
                if len(trees) - current == _TREES_PER_STATE:
                    newer = trees[current:]
                    # recomputed from the stored bins if an executor is lost
                    old, state = state, state.map(lambda b, newer=newer: _advanced(b, newer, missing)).persist(StorageLevel.MEMORY_AND_DISK)
                    state.count()
                    old.unpersist()
                    current = len(trees)
                trees.append(grower.grow(turn, trees[current:], partial(_merged, state)))
        finally:
            state.unpersist()
        model = NewtonTreesModel(_node_rows(trees, edges), base, len(edges))
        return self._copyValues(model)


def _few_patterns(rows: DataFrame) -> list | None:
    """The different (label, bins), in order, if there are at most ``ROWS_PER_BLOCK``."""
    found = rows.select("label", "bins").distinct().take(ROWS_PER_BLOCK + 1)
    return None if len(found) > ROWS_PER_BLOCK else sorted((r["label"], bytes(r["bins"])) for r in found)


def _counted(blocks: RDD, few: list, base: float, rounds: int, seed: int, share: float) -> Callable[[int], Patterns]:
    """The patterns with how many of their rows each turn draws, which one job counts; a table of turns and patterns, whatever the rows."""
    sc = blocks.context
    shared = sc.broadcast({pattern: i for i, pattern in enumerate(few)})

    def count(some: Iterator[Block]) -> Iterator[np.ndarray]:
        numbers = shared.value
        total = np.zeros((rounds, len(numbers)), dtype=np.int64)
        for bins, labels, keys, _ in some:
            which = np.array([numbers[label, row.tobytes()] for label, row in zip(labels.tolist(), bins, strict=True)])
            for turn in range(rounds):
                total[turn] += np.bincount(which[drawn(keys, seed, turn) < share], minlength=len(numbers))
        yield total

    times = sc.broadcast(blocks.mapPartitions(count).treeReduce(np.add))

    def held(_: int) -> Patterns:
        patterns = sorted(shared.value)
        bins = np.frombuffer(b"".join(p[1] for p in patterns), dtype=np.uint8).reshape(len(patterns), -1)
        return bins, np.array([p[0] for p in patterns]), times.value, np.full(len(patterns), base)

    return held


def binned_rows(df: DataFrame, label: str, vector: str, max_bins: int = _MAX_BINS) -> tuple[DataFrame, list[np.ndarray], float, int]:
    """(label, key, bins) stored, each column's cuts between bins, the sum of labels and the number of rows.

    Rows with a null label or vector are left out. ``key`` hashes the features, and the id where there is one.
    """
    named = [F.col("id").alias("_id")] if "id" in df.columns else []
    rows = df.select(F.col(label).cast("double").alias("label"), vector_to_array(vector).alias("x"), *named)
    rows = rows.where("label IS NOT NULL AND x IS NOT NULL")
    key = F.xxhash64("x", *["_id"] * len(named)).alias("key")
    rows = stored(rows.select("label", key, "x"), "binning-input")
    n, positive, width = rows.agg(F.count("*"), F.sum("label"), F.max(F.size("x"))).first()
    if not n:
        raise ValueError("no labelled rows to fit")
    bins = min(max_bins, _MAX_BINS)
    shares = ", ".join(f"{i / (bins - 1)!r}D" for i in range(bins))
    found, step = [], width if n <= SKETCH_ROWS else SKETCH_COLUMNS
    for begin in range(0, width, max(1, step)):
        some = range(begin, min(begin + step, width))
        sketches = [F.expr(f"percentile_approx(if(isnan(x[{i}]), null, x[{i}]), array({shares}), 10000)").alias(f"q{i}") for i in some]
        found += rows.agg(*sketches).first()
    edges = []
    for column in found:
        values = np.unique(np.array(column or [], dtype=np.float64))
        edges.append(values[:-1] + np.diff(values) / 2)

    @F.pandas_udf(T.BinaryType())
    def binned(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy()) if len(vectors) else np.empty((0, width))
        out = np.empty(x.shape, dtype=np.uint8)
        for f, cuts in enumerate(edges):
            out[:, f] = np.where(np.isnan(x[:, f]), len(cuts) + 1, np.searchsorted(cuts, x[:, f], side="left"))
        return pd.Series([r.tobytes() for r in out])

    return stored(rows.select("label", "key", binned("x").alias("bins")), "bins"), edges, float(positive), n


def _node_rows(trees: list[Tree], edges: list[np.ndarray]) -> pd.DataFrame:
    tables = []
    for t, tree in enumerate(trees):
        inner = np.array(tree.left) >= 0
        cuts = [float(edges[f][b]) if i else np.nan for f, b, i in zip(tree.feature, tree.bin, inner, strict=True)]
        tables.append(
            pd.DataFrame(
                {
                    "tree": t, "node": np.arange(len(inner)), "left": tree.left, "right": tree.right,
                    "feature": np.where(inner, tree.feature, -1), "threshold": cuts, "missing_left": tree.missing_left, "value": tree.value,
                    "n": tree.cover, "gain": tree.gain,
                }
            )
        )
    return pd.concat(tables, ignore_index=True)


class NewtonTreesModel(Model, ModelColumns, MLReadable, MLWritable):
    """Fitted trees as a table of nodes. The margin is ``base`` and the sum of one leaf of each tree, in log-odds."""

    unit = "log-odds"
    base = param("base", "log-odds before any tree")
    width = param("width", "number of features", TypeConverters.toInt)

    def __init__(self, nodes: pd.DataFrame | None = None, base: float = 0.0, width: int = 0) -> None:
        super().__init__()
        self.nodes = nodes
        self._set(base=base, width=width)

    @property
    def featureImportances(self) -> np.ndarray:
        """Average gain of a column's splits, as shares of their sum."""
        inner = self.nodes[self.nodes["left"] >= 0]
        out = np.zeros(self.getOrDefault(self.width))
        mean = inner.groupby("feature")["gain"].mean()
        out[mean.index.to_numpy()] = mean.to_numpy()
        return out / out.sum() if out.sum() else out

    def node_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes, NODE_SCHEMA)

    def _transform(self, df: DataFrame) -> DataFrame:
        base = self.getOrDefault(self.base)
        shared = df.sparkSession.sparkContext.broadcast(scoring_arrays(self.nodes))

        @F.pandas_udf(T.DoubleType())
        def margin(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(base + sums_of_alike(np.stack(batch.to_numpy()), shared.value)) if len(batch) else pd.Series(dtype=float)

        p = 1 / (1 + F.exp(-margin(vector_to_array(self.getOrDefault(self.featuresCol)))))
        probability, prediction = self.getOrDefault(self.probabilityCol), self.getOrDefault(self.predictionCol)
        scored = df.withColumn(probability, p).withColumn(prediction, (F.col(probability) > 0.5).cast("double"))
        return scored.withColumn(probability, array_to_vector(F.array(1 - F.col(probability), F.col(probability))))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


def scoring_arrays(nodes: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Children (right and left of each node), features, thresholds, sides of missing values, values, roots; leaves lead to themselves."""
    nodes = nodes.sort_values(["tree", "node"])
    size = nodes.groupby("tree").size().sort_index().to_numpy()
    first = np.cumsum(size) - size
    here, leaf = np.arange(len(nodes)), nodes["left"].to_numpy() < 0
    children = [np.where(leaf, here, nodes[side].to_numpy() + np.repeat(first, size)) for side in ("right", "left")]
    feature = np.where(leaf, 0, nodes["feature"].to_numpy())
    missing_left = nodes["missing_left"].to_numpy(dtype=bool)
    return np.stack(children, axis=1).ravel(), feature, nodes["threshold"].to_numpy(), missing_left, nodes["value"].to_numpy(), first, leaf


def leaf_sums(x: np.ndarray, arrays: tuple[np.ndarray, ...], rows: int = 256) -> np.ndarray:
    """Sum of a leaf of each tree for rows of features; all trees go down a level together."""
    children, feature, threshold, missing_left, value, first, leaf = arrays
    out = np.zeros(len(x))
    for begin in range(0, len(x), rows):
        part = x[begin : begin + rows]
        at = np.broadcast_to(first, (len(part), len(first)))
        gaps = bool(np.isnan(part).any())
        while not leaf[at].all():
            held = np.take_along_axis(part, feature[at], axis=1)
            goes_left = held <= threshold[at]
            if gaps:
                goes_left = np.where(np.isnan(held), missing_left[at], goes_left)
            at = children[2 * at + goes_left]
        out[begin : begin + rows] = value[at].sum(axis=1)
    return out


def alike(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each kind, the kind of each row): rows of a kind lie between the same thresholds, so trees treat them alike."""
    used = np.unique(feature)
    if not len(used) or not len(x):
        return np.zeros(min(1, len(x)), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    codes = np.empty((len(x), len(used)), dtype=np.int32)
    for k, f in enumerate(used):
        codes[:, k] = np.where(np.isnan(x[:, f]), -1, np.searchsorted(np.unique(threshold[feature == f]), x[:, f], side="left"))
    _, first, which = np.unique(codes.view(f"V{4 * len(used)}").ravel(), return_index=True, return_inverse=True)
    return first, which


def sums_of_alike(x: np.ndarray, arrays: tuple[np.ndarray, ...]) -> np.ndarray:
    inner = ~arrays[-1]
    first, which = alike(x, arrays[1][inner], arrays[2][inner])
    return leaf_sums(x[first], arrays)[which]


class _Writer(MLWriter):
    def __init__(self, instance: NewtonTreesModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.node_table(self.sparkSession).write.parquet(f"{path}/data")


class _Reader(MLReader):
    def load(self, path: str) -> NewtonTreesModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        nodes = self.sparkSession.read.schema(NODE_SCHEMA).parquet(f"{path}/data").toPandas()
        model = NewtonTreesModel(nodes.sort_values(["tree", "node"], ignore_index=True))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
