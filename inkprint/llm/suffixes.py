"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere are removed.

A string of ``LENGTH`` bytes is fingerprinted by its anchor, the least hashed ``GRAM``-byte gram in it. Equal strings have equal anchors at equal
offsets, so only suffixes under one anchor have to be sorted against one another; and where all strings of an anchor occurrence are found in
another, nothing has to be sorted. What is left goes, by anchor, to suffix arrays built by the difference-cover algorithm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.storage import stored

LENGTH = 400
GRAM = 200
# Starts handled at once, for texts of many megabytes; fits the position bits of a key.
CHUNK = 1 << 20
_POSITION_BITS = np.uint64(24)
# Regions under one anchor that one suffix array takes; anchors with more are compared by string fingerprints.
MAX_REGIONS = 1000
# Bytes of one suffix array, about: names and ranks must fit 21 bits.
ARRAY_BYTES = 1 << 20
# Bytes of regions that one task holds, about.
BLOCK_BYTES = 1 << 22
_BASE = 0x9E3779B97F4A7C15
_SECOND_BASE = 0xD6E8FEB86659FD93


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as they were needed yet."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self._held = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._held[0]) < n:
            self._held = tuple(
                np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full(2 * n, b, dtype=np.uint64)]))
                for b in (self.base, self.inverse)
            )
        return self._held


def _prefix_sums(data: np.ndarray, powers: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return sums


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchored(data: np.ndarray, powers: _Powers, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, region, low, starts) of one text: runs of starts whose strings share an anchor occurrence.

    ``anchor`` is the hash of its gram; ``region`` that of all bytes under the run and of where the anchor stands in them.
    """
    if len(data) < length:
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    forth, back = powers.upto(len(data) + 1)
    sums = _prefix_sums(data, forth)
    grams = _mixed((sums[gram:] - sums[:-gram]) * back[: len(data) - gram + 1])
    # the position breaks ties: the leftmost of equal grams owns a string
    keys = (grams >> _POSITION_BITS << _POSITION_BITS) | np.arange(len(grams), dtype=np.uint64)
    owner = (sliding_minimum(keys, length - gram + 1) & ((np.uint64(1) << _POSITION_BITS) - np.uint64(1))).astype(np.int64)
    cuts = np.flatnonzero(np.diff(owner)) + 1
    low = np.concatenate([[0], cuts])
    end = np.concatenate([cuts, [len(owner)]])
    at = owner[low]
    content = (sums[end - 1 + length] - sums[low]) * back[low]
    shape = (at - low).astype(np.uint64) * np.uint64(0x94D049BB133111EB) + (end - low).astype(np.uint64)
    return grams[at], _mixed(content + shape * np.uint64(_SECOND_BASE)), low, end - low


def anchors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, anchor, region, low, starts) of every text of (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers(_BASE)
        for batch in batches:
            found: list[tuple[np.ndarray, ...]] = []
            for row, text in zip(batch["row"].to_pylist(), batch["text"], strict=True):
                data = np.frombuffer(text.as_buffer(), dtype=np.uint8) if text.is_valid else np.zeros(0, dtype=np.uint8)
                for first in range(0, max(1, len(data) - length + 1), CHUNK):
                    anchor, region, low, starts = anchored(data[first : first + CHUNK + length - 1], powers, length, gram)
                    found.append((np.full(len(low), row), anchor.view(np.int64), region.view(np.int64), low + first, starts))
            columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, dtype=np.int64)] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], ["row", "anchor", "region", "low", "starts"]
            )

    return docs.select("row", "text").mapInArrow(run, "row long, anchor long, region long, low long, starts int")


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of positive ``symbols`` in order, by the difference cover of period three.

    The suffixes at places 1 and 2 modulo 3 are sorted by their triples; where triples are equal, their names make a
    text two thirds as long, whose suffix array orders them. The suffixes at places 0 follow from their first symbol and the rank
    behind it, and are merged in by comparing one or two symbols and a rank. Symbols must be below 2**21.
    """
    n = len(symbols)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: tuple(symbols[i:])), dtype=np.int64)
    s = np.concatenate([symbols, [0, 0, 0]]).astype(np.int64)
    ones, twos, zeros = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([ones, twos])
    bits = np.int64(max(int(s.max()), n + 2)).item().bit_length()
    triples = (s[sample] << 2 * bits) | (s[sample + 1] << bits) | s[np.minimum(sample + 2, n + 2)]
    order = np.argsort(triples, kind="stable")
    new = np.concatenate([[True], np.diff(triples[order]) > 0])
    names = np.empty(len(sample), dtype=np.int64)
    names[order] = np.cumsum(new)
    if not new.all():
        order = suffix_array(names)
        names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sample] = names
    first = zeros[np.argsort((s[zeros] << bits) | rank[zeros + 1], kind="stable")]
    inside = sample[order]
    inside = inside[inside < n]
    one, two = inside[inside % 3 == 1], inside[inside % 3 == 2]
    below = np.searchsorted((s[one] << bits) | rank[one + 1], (s[first] << bits) | rank[first + 1])

    def behind_two(i: np.ndarray) -> np.ndarray:
        return (s[i] << 2 * bits) | (s[i + 1] << bits) | rank[i + 2]

    below = below + np.searchsorted(behind_two(two), behind_two(first))
    merged = np.empty(n, dtype=np.int64)
    places = np.arange(len(first)) + below
    free = np.ones(n, dtype=bool)
    free[places] = False
    merged[places], merged[free] = first, inside
    return merged


def _equal_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes from each a and b are equal; pairs drop out at their first difference."""
    same, step = np.ones(len(a), dtype=bool), 8
    for offset in range(0, length, step):
        left = np.flatnonzero(same)
        width = np.arange(offset, min(offset + step, length))
        same[left] = (data[a[left, None] + width] == data[b[left, None] + width]).all(axis=1)
    return same


def _repeated_starts(texts: list[bytes], starts: np.ndarray, length: int) -> np.ndarray:
    """For every start of every region, one after another, whether its string starts in another region too."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    begins = np.cumsum([0, *map(len, texts)])[:-1]
    owned = np.concatenate([b + np.arange(n) for b, n in zip(begins, starts, strict=True)])
    order = suffix_array(data.astype(np.int64) + 1)
    place = np.full(len(data), -1, dtype=np.int64)
    place[owned] = np.arange(len(owned))
    sorted_starts = order[place[order] >= 0]
    same = _equal_prefixes(data, sorted_starts[:-1], sorted_starts[1:], length)
    repeated = np.zeros(len(owned), dtype=bool)
    repeated[place[sorted_starts[:-1][same]]] = True
    repeated[place[sorted_starts[1:][same]]] = True
    return repeated


def _runs(row: int, low: int, repeated: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], repeated.view(np.int8), [0]])))
    return [(row, low + int(a), low + int(b) - 1 + length) for a, b in edges.reshape(-1, 2)]


def _sort_regions(length: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["anchor", "row", "low"], ignore_index=True)
        sizes = group["bytes"].map(len).to_numpy()
        # whole anchors up to about ARRAY_BYTES each
        anchor_ends = np.flatnonzero(np.diff(group["anchor"].to_numpy())) + 1
        ends, done, total = [], 0, np.concatenate([[0], np.cumsum(sizes)])
        for end in [*anchor_ends, len(group)]:
            if total[end] - total[done] >= ARRAY_BYTES or end == len(group):
                ends.append((done, end))
                done = end
        out = []
        for begin, end in ends:
            part = group.iloc[begin:end]
            starts = part["starts"].to_numpy()
            repeated = np.split(_repeated_starts(list(part["bytes"]), starts, length), np.cumsum(starts)[:-1])
            for row, low, single, own in zip(part["row"], part["low"], part["single"], repeated, strict=True):
                if single:
                    out += _runs(row, low, own, length)
        return pd.DataFrame(out, columns=["row", "from", "to"], dtype="int64")

    return run


def _string_prints(length: int):
    """(h1, h2, row, at) of every start of a region: 128-bit fingerprints of its strings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bases = (_Powers(_BASE), _Powers(_SECOND_BASE))
        for batch in batches:
            out = []
            for row, low, single, starts, text in zip(batch["row"], batch["low"], batch["single"], batch["starts"], batch["bytes"], strict=True):
                data, prints = np.frombuffer(text, dtype=np.uint8), []
                for powers in bases:
                    forth, back = powers.upto(len(data) + 1)
                    sums = _prefix_sums(data, forth)
                    prints.append(_mixed((sums[length:] - sums[:-length]) * back[:starts]).view(np.int64))
                out.append(pd.DataFrame({"h1": prints[0], "h2": prints[1], "row": row, "at": low + np.arange(starts), "single": single}))
            if out:
                yield pd.concat(out)

    return run


def _fetched(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` (anchor, row, low, starts, single, crowded) with the bytes of each region."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "low", "starts", "single", "crowded")).alias("regions"))
    met = docs.select("row", F.col("text").cast("binary").alias("data")).join(lists, "row")
    each = met.select("row", "data", F.inline("regions"))
    size = F.col("starts") - 1 + length
    return each.select("anchor", "row", "low", "starts", "single", "crowded", F.substring("data", F.col("low").cast("int") + 1, size).alias("bytes"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, from, to): byte spans of (row, text) that are covered by a ``length``-byte string with another start."""
    found = stored(anchors(docs, length, gram), "anchors")
    same = ["anchor", "region", "starts"]
    classes = found.groupBy(*same).agg(F.count("*").alias("_n"), F.min(F.struct("row", "low")).alias("_first"))
    classes = stored(classes, "regions")
    # regions found as a whole elsewhere
    again = classes.where("_n > 1").select(*same)
    spans = found.join(again, same).select("row", F.col("low").alias("from"), (F.col("low") + F.col("starts") - 1 + length).alias("to"))
    # different regions under one anchor
    several = classes.groupBy("anchor").agg(F.count("*").alias("_regions")).where("_regions > 1")
    wanted = classes.join(several, "anchor").select(
        "anchor", "starts", "_first.row", "_first.low", (F.col("_n") == 1).alias("single"), (F.col("_regions") > MAX_REGIONS).alias("crowded")
    )
    regions = stored(_fetched(docs, wanted, length), "region-bytes")
    n_bytes = regions.agg(F.sum(F.col("starts") + length)).first()[0] or 0
    block = F.pmod(F.xxhash64("anchor"), F.lit(n_bytes // BLOCK_BYTES + 1))
    quiet = regions.where(~F.col("crowded")).withColumn("_block", block)
    sorted_spans = quiet.groupBy("_block").applyInPandas(_sort_regions(length), "row long, from long, to long")
    # under a crowded anchor all strings are grouped by fingerprint, whatever their number
    prints = regions.where("crowded").mapInPandas(_string_prints(length), "h1 long, h2 long, row long, at long, single boolean")
    twice = prints.groupBy("h1", "h2").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    crowded_spans = prints.where("single").join(twice, ["h1", "h2"]).select("row", F.col("at").alias("from"), (F.col("at") + length).alias("to"))
    return spans.unionByName(sorted_spans).unionByName(crowded_spans)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept): texts without bytes covered by repeated strings.

    A text is its UTF-8 bytes, null being empty. A byte goes if a ``length``-byte string that covers it also starts anywhere else, in the same
    text or in another; strings do not cross texts and are judged on the input. ``spans`` are the maximal removed runs (from, to), ``to``
    exclusive; ``kept`` are the remaining bytes, which need not be whole characters. Shorter texts stay. Rows are
    documents of their own, also where ids repeat; other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    spans = repeated_spans(rows, length, gram).groupBy("row").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    met = rows.select("row", "doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data")).join(spans, "row", "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, data, found in zip(batch["doc_id"].array, batch["data"], batch["spans"], strict=True):
                runs: list[list[int]] = []
                for low, high in sorted((s["from"], s["to"]) for s in (found if found is not None else ())):
                    if runs and low <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], high)
                    else:
                        runs.append([low, high])
                ends = [0, *[e for run in runs for e in run], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                out.append((doc_id, len(data), len(data) - len(kept), len(runs), [tuple(r) for r in runs], kept))
            columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
            yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<from:long,to:long>>, kept binary"
    return met.select(F.col("doc_id").cast("long").alias("doc_id"), "data", "spans").mapInPandas(cut, schema)
