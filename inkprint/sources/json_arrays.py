"""A reader of files that each hold one JSON array of objects, split over many tasks.

Spark's line reader, with ``}`` ending a line, deals a file in byte ranges whatever its layout. Each range says what it does to a
scanner that starts inside or outside a string; put one after another (a row per range) these give every range its true start,
and it cuts out the elements it holds. An element over several ranges is put together by its first range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# a scanner is outside strings, inside one, or inside one behind a backslash
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
_BLOCK = "file string, block long"
_BEFORE, _BETWEEN, _AFTER = (re.compile(p) for p in (rb"\s*\[\s*", rb"\s*,\s*", rb"\s*\]\s*"))
_EMPTY = re.compile(rb"\s*(\[\s*\]\s*)?")


def _structure(data: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, steps, end): the brackets outside strings with what they add to the depth, and the state at the end."""
    slash = data == ord("\\")
    # backslashes in a row before each byte
    since = np.arange(len(data)) - np.maximum.accumulate(np.where(slash, -1, np.arange(len(data))))
    run = np.r_[0, since]
    if start == ESCAPED:
        first = int(np.argmin(slash)) if not slash.all() else len(data)
        run[1 : first + 1] += 1  # the backslash before the range belongs to the row
        run[0] = 1
    quote = np.flatnonzero((data == ord('"')) & (run[:-1] % 2 == 0))
    inside = np.zeros(len(data), dtype=np.int64)
    inside[quote] = 1
    inside = (np.cumsum(inside) + (start != OUTSIDE)) % 2
    step = np.zeros(len(data), dtype=np.int64)
    step[(data == ord("{")) | (data == ord("["))] = 1
    step[(data == ord("}")) | (data == ord("]"))] = -1
    place = np.flatnonzero((step != 0) & (inside == 0))
    last_inside = int(inside[-1]) if len(data) else int(start != OUTSIDE)
    end = (ESCAPED if run[-1] % 2 else INSIDE) if last_inside else OUTSIDE
    return place, step[place], end


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, bytes]]:
    """(file, block, bytes) of each byte range in a task, its lines put together again; the last line end is left out."""
    lines = ((r.file, r.block, r.value or "") for batch in batches for r in batch.itertuples(index=False))
    for (file, block), some in groupby(lines, key=lambda x: x[:2]):
        yield file, block, "}".join(x[2] for x in some).encode()


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = []
    for file, block, data in _ranges(batches):
        data = np.frombuffer(data, dtype=np.uint8)
        ends, deltas, lows = [], [], []
        for start in (OUTSIDE, INSIDE, ESCAPED):
            _, steps, end = _structure(data, start)
            depth = np.cumsum(steps)
            ends.append(end)
            deltas.append(int(depth[-1]) if len(depth) else 0)
            lows.append(min(0, int(depth.min())) if len(depth) else 0)
        rows.append((file, block, ends, deltas, lows))
    yield pd.DataFrame(rows, columns=["file", "block", "ends", "deltas", "lows"])


def _starts(summaries: list) -> dict[tuple[str, int], tuple[int, int, int, bool]]:
    """(state, depth, block where the open element began, whether it is the file's last) of every range."""
    found = {}
    for file, some in groupby(sorted(summaries, key=lambda r: (r["file"], r["block"])), key=lambda r: r["file"]):
        blocks = list(some)
        state, depth, opened = OUTSIDE, 0, -1
        for r in blocks:
            is_last = r is blocks[-1]
            found[file, r["block"]] = (state, depth, opened, is_last)
            low = depth + r["lows"][state]
            depth, state = depth + r["deltas"][state], r["ends"][state]
            if not is_last:  # the } that ended the range
                if state == OUTSIDE:
                    depth -= 1
                    low = min(low, depth)
                elif state == ESCAPED:
                    state = INSIDE
            if opened < 0 or low <= 1:
                opened = r["block"] if depth > 1 else -1
        if depth or state != OUTSIDE:
            raise ValueError(f"{file} ends inside an array or an element")
    return found


def _cut(data: bytes, file: str, state: int, depth: int, is_first: bool) -> tuple[bytes | None, list[bytes], bytes | None]:
    """(end of an element begun before, whole elements, begin of one that goes on) of a range."""

    def checked(ok: bool) -> None:
        if not ok:
            raise ValueError(f"{file} is not an array of objects")

    place, steps, _ = _structure(np.frombuffer(data, dtype=np.uint8), state)
    after = depth + np.cumsum(steps)
    before = after - steps
    is_brace = np.isin(np.frombuffer(data, dtype=np.uint8)[place], (ord("{"), ord("}")))
    begins, ends = place[(before == 1) & (after == 2)], place[(before == 2) & (after == 1)] + 1
    checked(bool(is_brace[(np.minimum(before, after) == 1) & (np.maximum(before, after) == 2)].all()) and not (after < 0).any())
    head = tail = None
    at = 0
    if depth > 1:
        if not len(ends):
            return data, [], None
        head, at, ends = data[: ends[0]], int(ends[0]), ends[1:]
    if len(begins) > len(ends):
        tail = data[begins[-1] :]
        begins, stop = begins[:-1], int(begins[-1])
    else:
        stop = len(data)
    whole = [data[b:e] for b, e in zip(begins, ends, strict=True)]
    edges = [at, *[x for pair in zip(begins, ends, strict=True) for x in pair], stop]
    gaps = [data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
    closed = tail is None
    for i, gap in enumerate(gaps):
        opening, closing = is_first and i == 0, closed and i == len(gaps) - 1
        if opening and closing:
            checked(bool(_EMPTY.fullmatch(gap)))
        elif opening:
            checked(bool(_BEFORE.fullmatch(gap)))
        elif closing:
            # the end of the array, or of a range between two elements
            checked(not gap.strip() or bool(_AFTER.fullmatch(gap)))
        else:
            checked(bool(_BETWEEN.fullmatch(gap)))
    return head, whole, tail


def json_array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(value): the text of every element of every file below ``path``; a file that is no array of objects fails the job.

    A range of a file is one task's, of ``spark.sql.files.maxPartitionBytes``. Only what an element over several ranges is made of is shuffled.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path, lineSep="}")
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # a row per range
    summaries = lines.mapInPandas(_summaries, f"{_BLOCK}, ends array<int>, deltas array<long>, lows array<long>").collect()
    starts = _starts(summaries)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for file, block, data in _ranges(batches):
            state, depth, opened, is_last = starts[file, block]
            head, whole, tail = _cut(data + b"}" * (not is_last), file, state, depth, opened < 0 and depth == 0)
            rows = [(file, None, block, e.decode()) for e in whole]
            rows += [(file, opened, block, head.decode())] if head is not None else []
            rows += [(file, block, block, tail.decode())] if tail is not None else []
            yield pd.DataFrame(rows, columns=["file", "begun", "block", "value"]).astype({"begun": "Int64"})

    parts = lines.mapInPandas(cut, "file string, begun long, block long, value string")
    in_order = F.array_sort(F.collect_list(F.struct("block", "value")))
    joined = parts.where("begun IS NOT NULL").groupBy("file", "begun").agg(F.array_join(F.transform(in_order, lambda p: p["value"]), "").alias("value"))
    return parts.where("begun IS NULL").select("value").unionByName(joined.select("value"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of all arrays as rows of ``schema``; missing fields are null, a malformed element fails the job."""
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    return json_array_elements(spark, path).select(parsed.alias("element")).select("element.*")
