"""Sharding: best-fit-decreasing packing of indivisible groups of equal texts into shards."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkprint.storage import broadcast_bounded, stored

# Items that one packing run sees at most: this many chunks of small groups, and as many large groups.
MAX_CHUNKS = 4096
# With a capacity: chunks of small groups are this part of it on average, larger groups than a SMALL-th are packed alone.
PER_SHARD, SMALL = 128, 64
# Items that one run packs then, for each of max_chunks.
RUN_PER_CHUNK = 16
# Rows that one slot window numbers, about.
SLOT_ROWS = 4096


@dataclass
class _Node:
    key: tuple[int, int]
    height: int = 1
    left: _Node | None = None
    right: _Node | None = None


class CapacityTree:
    """AVL tree of (remaining capacity, bin), to find the tightest bin that still holds a size."""

    def __init__(self) -> None:
        self._root: _Node | None = None

    def add(self, key: tuple[int, int]) -> None:
        self._root = self._insert(self._root, key)

    def remove(self, key: tuple[int, int]) -> None:
        self._root = self._delete(self._root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        node, best = self._root, None
        while node:
            if node.key[0] >= size:
                node, best = node.left, node.key
            else:
                node = node.right
        return best

    def _insert(self, node: _Node | None, key: tuple[int, int]) -> _Node:
        if node is None:
            return _Node(key)
        if key < node.key:
            node.left = self._insert(node.left, key)
        else:
            node.right = self._insert(node.right, key)
        return self._balance(node)

    def _delete(self, node: _Node | None, key: tuple[int, int]) -> _Node | None:
        if node is None:
            return None
        if key < node.key:
            node.left = self._delete(node.left, key)
        elif key > node.key:
            node.right = self._delete(node.right, key)
        elif node.left is None or node.right is None:
            return node.left or node.right
        else:
            successor = node.right
            while successor.left:
                successor = successor.left
            node.key = successor.key
            node.right = self._delete(node.right, successor.key)
        return self._balance(node)

    @staticmethod
    def _height(node: _Node | None) -> int:
        return node.height if node else 0

    def _lean(self, node: _Node) -> int:
        return self._height(node.left) - self._height(node.right)

    def _measure(self, node: _Node) -> _Node:
        node.height = 1 + max(self._height(node.left), self._height(node.right))
        return node

    def _rotate_right(self, node: _Node) -> _Node:
        top = node.left
        node.left, top.right = top.right, self._measure(node)
        node.height = 1 + max(self._height(node.left), self._height(node.right))
        return self._measure(top)

    def _rotate_left(self, node: _Node) -> _Node:
        top = node.right
        node.right, top.left = top.left, self._measure(node)
        node.height = 1 + max(self._height(node.left), self._height(node.right))
        return self._measure(top)

    def _balance(self, node: _Node) -> _Node:
        self._measure(node)
        if self._lean(node) > 1:
            if self._lean(node.left) < 0:
                node.left = self._rotate_left(node.left)
            return self._rotate_right(node)
        if self._lean(node) < -1:
            if self._lean(node.right) > 0:
                node.right = self._rotate_right(node.right)
            return self._rotate_left(node)
        return node


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each size: largest first, each into the tightest bin that still holds it.

    A size above the capacity gets a bin of its own. Ties go to the earlier bin.
    """
    tree, bins, placed = CapacityTree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.tightest(sizes[i])
        if found is None:
            placed[i], left = bins, capacity - sizes[i]
            bins += 1
        else:
            tree.remove(found)
            left, placed[i] = found[0] - sizes[i], found[1]
        if left > 0:
            tree.add((left, placed[i]))
    return placed


def pack_into(sizes: list[int], n_shards: int) -> list[int]:
    """Bins 0 to n_shards - 1 of near equal fill.

    Sizes that are more than an even share of what is left get a bin each; the others are packed under the
    smallest capacity for which best fit needs no more than the other bins.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    placed, left, alone = [0] * len(sizes), sum(sizes), 0
    while alone < min(len(order), n_shards - 1) and sizes[order[alone]] * (n_shards - alone) > left:
        placed[order[alone]] = alone
        left -= sizes[order[alone]]
        alone += 1
    rest, bins = sorted(order[alone:]), n_shards - alone
    own = [sizes[i] for i in rest]
    low = max([-(-left // bins), *own, 1])
    high = 2 * low
    best = best_fit_decreasing(own, high)
    while low < high:
        middle = (low + high) // 2
        tried = best_fit_decreasing(own, middle)
        if max(tried, default=0) < bins:
            high, best = middle, tried
        else:
            low = middle + 1
    for i, b in zip(rest, best, strict=True):
        placed[i] = alone + b
    return placed


def _filled_shards(groups: DataFrame, total: int, capacity: int, run_items: int) -> tuple[DataFrame, DataFrame, int]:
    """(group, _alone) and (_chunk, _shared) with shards of ``capacity``, and the number of chunks.

    Up to ``run_items`` groups are packed one by one in one run. More are packed in as many runs as it takes, each over a hashed
    range of the items: groups above a SMALL-th of the capacity, and chunks of smaller ones. The groups of a chunk that
    comes out above the capacity are packed one by one. A run costs one underfull shard.
    """
    groups = stored(groups, "shard-groups")
    n_chunks = total * PER_SHARD // capacity + 1
    gathered = (F.col("bytes") * SMALL <= capacity) if groups.count() > run_items else F.lit(False)
    chunks = groups.where(gathered).groupBy(F.pmod(F.xxhash64("group"), F.lit(n_chunks)).alias("_chunk")).agg(F.sum("bytes").alias("bytes"))
    chunks = stored(chunks, "shard-chunks")
    heavy = chunks.where(F.col("bytes") > capacity).select("_chunk", F.lit(True).alias("_heavy"))
    dealt = groups.withColumn("_chunk", F.when(gathered, F.pmod(F.xxhash64("group"), F.lit(n_chunks)))).join(heavy, "_chunk", "left")
    single = dealt.where("_chunk IS NULL OR _heavy").select("group", F.lit(None).cast("long").alias("_chunk"), "bytes")
    items = single.unionByName(chunks.where(F.col("bytes") <= capacity).select(F.lit(None).cast("string").alias("group"), "_chunk", "bytes"))
    items = stored(items, "shard-items")
    runs = items.count() // run_items + 1

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["group", "_chunk"])
        return part.assign(_bin=best_fit_decreasing(part["bytes"].tolist(), capacity))[["group", "_chunk", "_run", "_bin"]]

    schema = "group string, _chunk long, _run int, _bin int"
    run = F.pmod(F.xxhash64(F.coalesce("group", F.col("_chunk").cast("string")), F.lit(1)), F.lit(runs)).cast("int")
    packed = stored(items.withColumn("_run", run).groupBy("_run").applyInPandas(pack, schema), "shard-runs")
    # a row for each run
    starts = packed.groupBy("_run").agg((F.max("_bin") + 1).alias("_n"))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = packed.join(F.broadcast(starts), "_run").withColumn("shard", (F.col("_start") + F.col("_bin")).cast("int"))
    by_group = placed.where("group IS NOT NULL").select("group", F.col("shard").alias("_alone"))
    by_chunk = placed.where("group IS NULL").select("_chunk", F.col("shard").alias("_shared"))
    return broadcast_bounded(by_group, MAX_CHUNKS), broadcast_bounded(by_chunk, MAX_CHUNKS), n_chunks


def _even_shards(groups: DataFrame, total: int, n_shards: int, max_chunks: int) -> tuple[DataFrame, DataFrame, int]:
    """(group, _alone) and (_chunk, _shared) with ``n_shards`` shards of near equal bytes, and the number of chunks."""
    spark = groups.sparkSession
    chunk = F.pmod(F.xxhash64("group"), F.lit(max_chunks))
    alone = F.col("bytes") > F.lit(total // max_chunks)
    items = (
        groups.select(F.when(alone, F.col("group")).alias("group"), F.when(~alone, chunk).alias("chunk"), "bytes")
        .groupBy("group", "chunk")
        .agg(F.sum("bytes").alias("bytes"))
        .orderBy("group", "chunk")
        .collect()  # at most 2 x max_chunks rows
    )
    bins = pack_into([r["bytes"] for r in items], n_shards)
    large = [(r["group"], b) for r, b in zip(items, bins, strict=True) if r["group"] is not None]
    small = [(r["chunk"], b) for r, b in zip(items, bins, strict=True) if r["group"] is None]
    by_group = F.broadcast(spark.createDataFrame(large, "group string, _alone int"))
    return by_group, F.broadcast(spark.createDataFrame(small, "_chunk long, _shared int")), max_chunks


def shard_documents(
    docs: DataFrame, n_shards: int | None = 8, capacity: int | None = None, max_chunks: int = MAX_CHUNKS
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): equal texts stay together, shards stay near equal.

    ``size`` is the UTF-8 bytes of the text plus 1; a null text counts as an empty one and
    shares its group. For ``n_shards``, groups larger than a ``max_chunks``-th of all bytes are packed one by
    one; there are fewer than ``max_chunks`` of them. Smaller groups are first gathered by hash
    into ``max_chunks`` chunks. So the packing sees a bounded number of items whatever the
    corpus, and no group is ever split. With ``capacity`` shards of that many bytes are opened as
    needed, and only a group above it has a larger shard, of its own; chunks are a small part of the capacity, and items beyond 16 x
    ``max_chunks`` are packed in several runs. Else there are ``n_shards`` of near equal bytes: groups above an even
    share get one each, and the others are packed under the smallest capacity that does. Slots number a shard's rows from 0, by hashed sub-ranges of
    bounded size. An empty table gives no rows; other columns are ignored.
    """
    if (n_shards is None) == (capacity is None):
        raise ValueError("give n_shards or capacity")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("group"),
        ),
        "shard-sizes",
    )
    totals = rows.agg(F.sum("size"), F.count("*")).first()
    total, n_rows = totals[0] or 0, totals[1]
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    if capacity is None:
        by_group, by_chunk, n_chunks = _even_shards(groups, total, n_shards, max_chunks)
    else:
        by_group, by_chunk, n_chunks = _filled_shards(groups, total, capacity, RUN_PER_CHUNK * max_chunks)
    chunk = F.pmod(F.xxhash64("group"), F.lit(n_chunks))
    placed = (
        rows.join(by_group, "group", "left")
        .withColumn("_chunk", chunk)
        .join(by_chunk, "_chunk", "left")
        .withColumn("shard", F.coalesce("_alone", "_shared"))
        .withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(n_rows // SLOT_ROWS + 1)))
    )
    # a row for each shard and part: counts only
    parts = placed.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_part").orderBy("doc_id", "group")
    return (
        placed.withColumn("_place", F.row_number().over(inside))
        .join(starts, ["shard", "_part"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_place") - 1).alias("slot"))
    )
