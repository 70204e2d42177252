"""A lexical classifier trained by epochs: hashed token n-grams, mini-batches over all tasks, early stopping.

An epoch is one barrier stage. Each task goes through its own rows; after every mini-batch the tasks exchange their sums of
gradients (an all-reduce) and take the same step, so all hold the same state. The number of exchanges is bounded: with more rows a step
sums the gradients of several mini-batches, and what is exchanged is at most one number per bucket. Between epochs the state is on the driver, so an epoch that loses an executor starts again from there.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprint.functions.pysyntax import py_tokens
from inkprint.operators.corpus import in_split
from inkprint.operators.metrics import evaluate
from inkprint.storage import stored

EPOCHS = 8
PATIENCE = 2
# rows of a task's mini-batch: Spark takes about a second for an exchange between tasks, so a step should be worth it
BATCH = 256
# exchanges of an epoch, about: they take their second whatever the number of rows
_EXCHANGES = 64
RATE, DECAY = 0.1, 0.01
_FORGET, _FORGET_SQUARES, _LEAST = 0.9, 0.999, 1e-8
# buckets that token n-grams are hashed to
N_FEATURES = 1 << 16
# a barrier stage needs all its tasks at once: no more of them than cores, and none with fewer rows than this, about
_ROWS_PER_TASK = 2_048

# weights with the intercept last, first and second moments, steps taken; plain arrays, so that executors unpickle them
# without this module
State = tuple[np.ndarray, np.ndarray, np.ndarray, int]


def with_buckets(df: DataFrame, ngram: int = 2, n_features: int = N_FEATURES) -> DataFrame:
    """``buckets``: the hash bucket of every token n-gram of the whole code, repeats included."""
    tokens = df.withColumn("tokens", py_tokens(F.col("code")))
    last = F.size("tokens") - ngram
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def bucket(i):
        return F.pmod(F.xxhash64(*[F.get("tokens", i + k) for k in range(ngram)]), F.lit(n_features)).cast("int")

    return tokens.withColumn("buckets", F.transform(starts, bucket)).drop("tokens")


def bucket_weights(rows: DataFrame, n_features: int = N_FEATURES) -> np.ndarray:
    """Smoothed log inverse share of the rows that hold each bucket; at most ``n_features`` counts reach the driver."""
    n = rows.count()
    held = rows.select(F.explode(F.array_distinct("buckets")).alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    counts = np.zeros(n_features)
    for r in held.collect():
        counts[r["b"]] = r["n"]
    return np.log((n + 1) / (counts + 1)) + 1


def _sparse(buckets: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of rows of unit length; a row without buckets has no entry."""
    sizes = [len(b) for b in buckets]
    row = np.repeat(np.arange(len(buckets)), sizes)
    flat = np.concatenate([np.zeros(0, dtype=np.int64), *buckets]).astype(np.int64)
    cell, times = np.unique(row * len(weights) + flat, return_counts=True)
    row, bucket = cell // len(weights), cell % len(weights)
    value = times * weights[bucket]
    length = np.sqrt(np.bincount(row, weights=value * value, minlength=len(buckets)))
    return row, bucket, value / length[row]


def _margins(buckets: list[np.ndarray], weights: np.ndarray, state: np.ndarray) -> np.ndarray:
    row, bucket, value = _sparse(buckets, weights)
    return np.bincount(row, weights=value * state[bucket], minlength=len(buckets)) + state[-1]


def gradient(buckets: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, sums) of the logistic loss over some rows; the last position is the intercept's."""
    row, bucket, value = _sparse(buckets, weights)
    margins = np.bincount(row, weights=value * state[bucket], minlength=len(buckets)) + state[-1]
    error = 1 / (1 + np.exp(-margins)) - labels
    found, which = np.unique(bucket, return_inverse=True)
    sums = np.bincount(which, weights=value * error[row], minlength=len(found))
    return np.r_[found, len(state) - 1], np.r_[sums, error.sum()]


def step(state: State, mean: np.ndarray, rate: float, decay: float) -> State:
    """Adam with decoupled decay of all weights but the intercept."""
    w, m, v, n = state
    n += 1
    m = _FORGET * m + (1 - _FORGET) * mean
    v = _FORGET_SQUARES * v + (1 - _FORGET_SQUARES) * mean * mean
    shift = m / (1 - _FORGET**n) / (np.sqrt(v / (1 - _FORGET_SQUARES**n)) + _LEAST)
    kept = np.full(len(w), 1 - rate * decay)
    kept[-1] = 1.0
    return w * kept - rate * shift, m, v, n


def _message(rows: int, positions: np.ndarray, sums: np.ndarray) -> str:
    return f"{rows}:" + ":".join(base64.b64encode(x.tobytes()).decode() for x in (positions.astype(np.int32), sums.astype(np.float64)))


def _reduced(messages: list[str], size: int) -> tuple[int, np.ndarray]:
    """Rows and summed gradient of all tasks, in the order of the tasks."""
    total, n = np.zeros(size), 0
    for message in messages:
        rows, positions, sums = message.split(":")
        n += int(rows)
        np.add.at(total, np.frombuffer(base64.b64decode(positions), dtype=np.int32), np.frombuffer(base64.b64decode(sums)))
    return n, total


def _batches(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    buckets: list[np.ndarray] = []
    labels: list[float] = []
    for batch in rows:
        for label, held in zip(batch.column("label").to_pylist(), batch.column("buckets"), strict=True):
            labels.append(float(label))
            buckets.append(np.asarray(held.values))
            if len(labels) == size:
                yield buckets, np.array(labels)
                buckets, labels = [], []
    if labels:
        yield buckets, np.array(labels)


def _epoch(
    rows: Iterator[pa.RecordBatch],
    state: State,
    weights: np.ndarray,
    batch: int,
    batches: int,
    rate: float,
    decay: float,
    gather: Callable[[str], list[str]],
) -> State:
    """All steps of an epoch as one task takes them, each over so many ``batches`` of its rows; ``gather`` returns every task's message.

    Tasks without rows left send none.
    """
    own = _batches(rows, batch)
    while True:
        n, local = 0, np.zeros(len(state[0]))
        for some in islice(own, batches):
            positions, sums = gradient(*some, weights, state[0])
            local[positions] += sums
            n += len(some[1])
        found = np.flatnonzero(local)
        n, total = _reduced(gather(_message(n, found, local[found])), len(state[0]))
        if not n:
            return state
        state = step(state, total / n, rate, decay)


def train_epoch(
    train: DataFrame, state: State, weights: np.ndarray, epoch: int, batch: int, rate: float, decay: float, seed: int
) -> State:
    """One pass over (id, label, buckets), in an order of its own, as one barrier stage."""
    sc = train.sparkSession.sparkContext
    n_rows = train.count()
    tasks = max(1, min(sc.defaultParallelism, n_rows // _ROWS_PER_TASK + 1))
    batches = max(1, -(-n_rows // (tasks * batch * _EXCHANGES))) if tasks > 1 else 1
    order = F.xxhash64(F.lit(seed), F.lit(epoch), F.col("id"))
    dealt = train.select("id", "label", "buckets").repartition(tasks, F.xxhash64(F.lit(seed), "id")).sortWithinPartitions(order, "id")
    shared = sc.broadcast((state, weights))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        begun, idf = shared.value
        gather = context.allGather if tasks > 1 else lambda message: [message]
        w, m, v, n = _epoch(rows, begun, idf, batch, batches, rate, decay, gather)
        if context.partitionId() == 0:  # all tasks hold the same
            arrays = [pa.array([x.tobytes()], pa.binary()) for x in (w, m, v)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([n], pa.int64())], names=["w", "m", "v", "n"])

    found = dealt.mapInArrow(run, "w binary, m binary, v binary, n long", barrier=True).collect()[0]
    shared.unpersist()
    return (*(np.frombuffer(bytes(found[c])) for c in ("w", "m", "v")), found["n"])


def train_lexical(
    dataset: DataFrame,
    epochs: int = EPOCHS,
    ngram: int = 2,
    n_features: int = N_FEATURES,
    batch: int = BATCH,
    rate: float = RATE,
    decay: float = DECAY,
    patience: int = PATIENCE,
    seed: int = 42,
) -> tuple[LexicalModel, DataFrame]:
    """The state of the epoch with the best validation F1, and its metrics per held-out split.

    Training ends after ``epochs`` epochs, ``patience`` of them in a row without a better F1, or an F1 of 1, which none can better.
    Of equal ones the first stays. Rows without code are left out; texts are tokenized and hashed once.
    """
    dataset = dataset.na.drop(subset=["code"]).select("id", "label", "split", "code")
    rows = stored(with_buckets(dataset, ngram, n_features).drop("code"), "lexical-features")
    train, val = in_split(rows, "train"), in_split(rows, "val")
    weights = bucket_weights(train, n_features)
    state: State = (*(np.zeros(n_features + 1) for _ in range(3)), 0)
    best, best_f1, stale = state[0], -1.0, 0
    history = []
    for epoch in range(epochs):
        state = train_epoch(train, state, weights, epoch, batch, rate, decay, seed)
        f1 = evaluate(LexicalModel(state[0], weights, ngram).score(val), []).first()["f1"]
        history.append(f1)
        if f1 > best_f1:
            best, best_f1, stale = state[0], f1, 0
        else:
            stale += 1
        if stale >= patience or best_f1 >= 1.0:
            break
    model = LexicalModel(best, weights, ngram)
    model.history = history
    held_out = rows.where(F.col("split").isin("val", "test"))
    return model, evaluate(model.score(held_out), ["split"])


class LexicalModel(Model, MLReadable, MLWritable):
    """Weights of hashed token n-grams; ``transform`` takes (code) and adds the probability vector of both classes."""

    ngram = Param(Params._dummy(), "ngram", "tokens of a gram", TypeConverters.toInt)

    def __init__(self, state: np.ndarray | None = None, weights: np.ndarray | None = None, ngram: int = 2) -> None:
        super().__init__()
        self.state, self.weights, self.history = state, weights, []
        self._set(ngram=ngram)

    def score(self, rows: DataFrame, out: str = "score") -> DataFrame:
        """Probability of the AI class from ``buckets``."""
        shared = rows.sparkSession.sparkContext.broadcast((self.state, self.weights))

        @F.pandas_udf(T.DoubleType())
        def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            state, weights = shared.value
            for batch in batches:
                yield pd.Series(1 / (1 + np.exp(-_margins(list(batch), weights, state))), dtype=float)

        return rows.withColumn(out, probability("buckets"))

    def _transform(self, df: DataFrame) -> DataFrame:
        scored = self.score(with_buckets(df, self.getOrDefault(self.ngram), len(self.weights)), "_p").drop("buckets")
        return scored.withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).drop("_p")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, instance: LexicalModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        state, weights = self.instance.state, self.instance.weights
        table = pd.DataFrame({"position": np.arange(len(state)), "weight": state, "idf": np.r_[weights, 0.0]})
        self.sparkSession.createDataFrame(table).write.parquet(f"{path}/data")


class _Reader(MLReader):
    def load(self, path: str) -> LexicalModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        table = self.sparkSession.read.parquet(f"{path}/data").toPandas().sort_values("position")
        model = LexicalModel(table["weight"].to_numpy(), table["idf"].to_numpy()[:-1])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
