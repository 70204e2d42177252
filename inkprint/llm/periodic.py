"""Runs of periodically repeated words, found on a grammar of the text.

The word ids of a batch of documents are compressed by Re-Pair: pairs that repeat become nonterminals until none repeats.
Each document's remaining symbols are joined by a balanced tree, so every document is one symbol of a binary grammar. A run
lies within a least symbol of its derivation tree and crosses the border of this symbol's two halves: runs are searched at
that one border of each symbol, once for all places where the symbol stands, then moved to those places and merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 24
MIN_EXPONENT = 3
# Bytes of text that share one grammar, about; a longer document has its own.
BATCH_BYTES = 1 << 20
# (border, period) pairs that are looked at together.
_TESTS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Grammar:
    """Symbols below ``n_words`` are words; symbol ``n_words + i`` derives ``left[i] right[i]``. ``roots`` derive the documents."""

    n_words: int
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    roots: np.ndarray


def _replaceable(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``at`` without every second pair of a stretch of equal symbols, whose pairs overlap."""
    equal = np.flatnonzero(symbols[at] == symbols[at + 1])
    if not len(equal):
        return at
    place = at[equal]
    first = np.r_[True, np.diff(place) != 1]
    start = place[np.maximum.accumulate(np.where(first, np.arange(len(place)), 0))]
    return np.delete(at, equal[(place - start) % 2 == 1])


def compress(documents: list[np.ndarray], n_words: int) -> Grammar:
    """A binary grammar of all documents, none of them empty.

    Re-Pair in rounds: in a round, of any two overlapping pairs the more frequent is replaced (by powers of two of the count, then
    in an arbitrary fixed order), and only pairs replaced at least twice become nonterminals. It ends when no pair repeats.
    """
    symbols = np.concatenate(documents).astype(np.int64)
    last = np.zeros(len(symbols), dtype=bool)
    last[np.cumsum([len(d) for d in documents]) - 1] = True
    lefts, rights, n_symbols = [], [], n_words
    active = ~last  # a pair that occurs once never repeats again, unless one of its symbols changes
    while True:
        pairs = np.flatnonzero(active & ~last)
        at = _replaceable(symbols, pairs)
        found, which, count = np.unique(symbols[at] * n_symbols + symbols[at + 1], return_inverse=True, return_counts=True)
        repeated = count[which] >= 2
        if not repeated.any():
            break
        bucket = np.log2(count).astype(np.int64)
        order = (bucket << 32) + (np.arange(len(found)) * 2654435761 & 0xFFFFFFFF) + 1
        rank = np.zeros(len(symbols) + 2, dtype=np.int64)
        rank[at + 1] = np.where(repeated, order[which], 0)
        chosen = repeated & (rank[at + 1] > rank[at]) & (rank[at + 1] > rank[at + 2])
        often = np.bincount(which[chosen], minlength=len(found)) >= 2
        chosen &= often[which]
        new_id = n_symbols + np.cumsum(often) - 1
        lefts.append(found[often] // n_symbols)
        rights.append(found[often] % n_symbols)
        n_symbols += int(often.sum())
        active[at[~repeated]] = False
        place = at[chosen]
        symbols[place] = new_id[which[chosen]]
        last[place] = last[place + 1]
        active[place] = True
        active[np.maximum(place - 1, 0)] = True
        keep = np.ones(len(symbols), dtype=bool)
        keep[place + 1] = False
        symbols, last, active = symbols[keep], last[keep], active[keep]
    # the rest of each document: a balanced tree of symbols that occur once
    while not last.all():
        begin = np.r_[0, np.flatnonzero(last)[:-1] + 1]
        within = np.arange(len(symbols)) - np.repeat(begin, np.diff(np.r_[begin, len(symbols)]))
        place = np.flatnonzero((within % 2 == 0) & ~last)
        lefts.append(symbols[place].copy())
        rights.append(symbols[place + 1].copy())
        symbols[place] = n_symbols + np.arange(len(place))
        n_symbols += len(place)
        last[place] = last[place + 1]
        keep = np.ones(len(symbols), dtype=bool)
        keep[place + 1] = False
        symbols, last = symbols[keep], last[keep]
    size = np.ones(n_symbols, dtype=np.int64)
    begin = n_words
    for a, b in zip(lefts, rights, strict=True):  # halves were made in earlier rounds
        size[begin : begin + len(a)] = size[a] + size[b]
        begin += len(a)
    none = np.zeros(0, dtype=np.int64)
    return Grammar(n_words, np.concatenate([none, *lefts]), np.concatenate([none, *rights]), size, symbols)


def derivation(grammar: Grammar) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, position) of every nonterminal in the derivations of all documents, one after another."""
    symbols = grammar.roots
    places = np.cumsum(grammar.size[symbols]) - grammar.size[symbols]
    found = []
    while len(symbols):
        inner = symbols >= grammar.n_words
        symbols, places = symbols[inner], places[inner]
        found.append((symbols, places))
        a, b = grammar.left[symbols - grammar.n_words], grammar.right[symbols - grammar.n_words]
        symbols, places = np.concatenate([a, b]), np.concatenate([places, places + grammar.size[a]])
    return np.concatenate([s for s, _ in found]), np.concatenate([p for _, p in found])


class _Text:
    """Words of a batch with fingerprints of its substrings; equal strings have equal ones."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        with np.errstate(over="ignore"):
            self.power = np.r_[np.uint64(1), np.multiply.accumulate(np.full(len(words), _BASE, dtype=np.uint64))]
            mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
            self.sums = np.r_[np.uint64(0), np.cumsum(mixed * self.power[:-1], dtype=np.uint64)]

    def same(self, at: np.ndarray, distance: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the fingerprints of ``length`` words at ``at`` and ``distance`` behind it are equal."""
        near = self.sums[at + length] - self.sums[at]
        far = self.sums[at + distance + length] - self.sums[at + distance]
        return near * self.power[distance] == far

    def reach(self, at: np.ndarray, distance: np.ndarray, limit: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from ``at`` on (or before it) equal those ``distance`` behind them, ``limit`` at most."""
        low, high = np.zeros_like(limit), np.maximum(limit, 0)
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = self.same(at - middle if back else at, distance, middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low

    def exact(self, at: int, distance: int, begin: int, end: int) -> tuple[int, int]:
        """The run of this period around ``at`` in [begin, end), compared word by word."""
        equal = self.words[begin : end - distance] == self.words[begin + distance : end]
        before, after = np.flatnonzero(~equal[: at - begin]), np.flatnonzero(~equal[at - begin :])
        start = begin + int(before[-1]) + 1 if len(before) else begin
        return start, (at + int(after[0]) if len(after) else end - distance) + distance


def _border_runs(text: _Text, begin: np.ndarray, border: np.ndarray, end: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """Rows (i, start, end, period) of the runs in [begin[i], end[i]) that cross border[i].

    Half of a run's words, or more, lie on one side of the border. So on this side the words next to the border, or a period before
    it, equal those a period further over half a run less a period: all such (border, period) are tested by fingerprint. Those that pass are
    extended by bisection, smallest period first, and checked word by word. Multiples of a period inside its run say nothing new.
    """
    tests = (end - begin) // min_exponent
    ends = np.cumsum(tests)
    passed = []
    for low in range(0, int(ends[-1]) if len(ends) else 0, _TESTS):
        flat = np.arange(low, min(low + _TESTS, int(ends[-1])))
        i = np.searchsorted(ends, flat, side="right")
        q = flat - (ends[i] - tests[i]) + 1
        half = np.maximum((min_length + 1) // 2, (min_exponent * q + 1) // 2) - q
        for side, at in (("right", border[i]), ("left", border[i] - q - half)):
            inside = (at >= begin[i]) & (at + q + half <= end[i])
            j = np.flatnonzero(inside)
            j = j[text.same(at[j], q[j], half[j])]
            passed.append(np.stack([i[j], q[j], np.full(len(j), side == "left")], axis=1))
    found = [np.zeros((0, 4), dtype=np.int64)]
    if not passed:
        return found[0]
    waiting = np.concatenate(passed)
    waiting = waiting[np.lexsort((waiting[:, 2], waiting[:, 1], waiting[:, 0]))]
    while len(waiting):
        _, head = np.unique(waiting[:, 0], return_index=True)
        i, q, is_left = waiting[head].T
        at = border[i] - q * is_left
        forward = text.reach(at, q, end[i] - q - at)
        backward = text.reach(at, q, at - begin[i], back=True)
        start, stop = at - backward, at + forward + q
        least = np.maximum(min_length, min_exponent * q)
        crosses = (start < border[i]) & (stop > border[i])
        for k in np.flatnonzero((stop - start >= least) & crosses):
            if not np.array_equal(text.words[start[k] : stop[k] - q[k]], text.words[start[k] + q[k] : stop[k]]):
                start[k], stop[k] = text.exact(int(at[k]), int(q[k]), int(begin[i[k]]), int(end[i[k]]))
        good = (stop - start >= least) & (start < border[i]) & (stop > border[i])
        found.append(np.stack([i, start, stop, q], axis=1)[good])
        # per remaining candidate: what its border's head has just shown
        of = np.searchsorted(i, waiting[:, 0])
        covered = np.where(waiting[:, 2] == 1, border[i[of]] - start[of], stop[of] - border[i[of]])
        known = good[of] & (waiting[:, 1] % q[of] == 0) & (waiting[:, 1] <= covered)
        known[head] = True
        waiting = waiting[~known]
    return np.concatenate(found)


def _merged(runs: np.ndarray) -> np.ndarray:
    """Maximal intervals of (start, end, period): those of one period that overlap by a period are one."""
    start, end, period = runs[np.lexsort((runs[:, 0], runs[:, 2]))].T
    if not len(start):
        return runs
    group = np.cumsum(np.r_[0, np.diff(period) != 0]) * (int(end.max()) + 1)
    reached = np.maximum.accumulate(end + group) - group
    new = np.r_[True, (np.diff(period) != 0) | (start[1:] + period[1:] > reached[:-1])]
    first = np.flatnonzero(new)
    whole = np.stack([start[first], np.maximum.reduceat(end, first), period[first]], axis=1)
    # a stretch with a smaller period is no run of the larger
    whole = whole[np.lexsort((whole[:, 2], whole[:, 1], whole[:, 0]))]
    return whole[np.r_[True, (np.diff(whole[:, :2], axis=0) != 0).any(axis=1)]]


def runs_of(documents: list[np.ndarray], n_words: int, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[np.ndarray]:
    """Per document of word ids below ``n_words`` its runs (start, length, period), sorted by start, then period."""
    if min_exponent < 3:
        raise ValueError("runs of fewer than three periods are not searched")
    found = [np.zeros((0, 3), dtype=np.int64) for _ in documents]
    filled = [k for k, d in enumerate(documents) if len(d) >= min_length]
    if not filled:
        return found
    grammar = compress([documents[k] for k in filled], n_words)
    symbols, places = derivation(grammar)
    large = grammar.size[symbols] >= min_length
    symbols, places = symbols[large], places[large]
    order = np.argsort(symbols, kind="stable")
    symbols, places = symbols[order], places[order]
    distinct, first, times = np.unique(symbols, return_index=True, return_counts=True)
    begin = places[first]
    border = begin + grammar.size[grammar.left[distinct - n_words]]
    text = _Text(np.concatenate([documents[k] for k in filled]))
    at_border = _border_runs(text, begin, border, begin + grammar.size[distinct], min_length, min_exponent)
    # from the one place searched to every place of the symbol
    i, start, end, period = at_border.T
    repeat = times[i]
    nth = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    shift = places[np.repeat(first[i], repeat) + nth] - np.repeat(begin[i], repeat)
    moved = np.stack([np.repeat(start, repeat) + shift, np.repeat(end, repeat) + shift, np.repeat(period, repeat)], axis=1)
    runs = _merged(moved)
    lengths = np.array([len(documents[k]) for k in filled])
    starts = np.cumsum(lengths) - lengths
    owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
    runs = np.stack([runs[:, 0] - starts[owner], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1)
    runs, owner = (x[np.lexsort((runs[:, 2], runs[:, 0], owner))] for x in (runs, owner))
    cuts = np.searchsorted(owner, np.arange(len(filled) + 1))
    for n, k in enumerate(filled):
        found[k] = runs[cuts[n] : cuts[n + 1]]
    return found


def _slices(texts: list[bytes | None], batch_bytes: int) -> Iterator[slice]:
    begin, total = 0, 0
    for end, text in enumerate(texts, start=1):
        total += len(text or b"")
        if total >= batch_bytes or end == len(texts):
            yield slice(begin, end)
            begin, total = end, 0


def _collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    if not len(runs):
        return b" ".join(words)
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept)])


def collapse_runs(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """(doc_id, n_words, runs, text) for every row of ``docs``: runs array<struct<start, length, period>>, text without their repeats.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, numbered from 0. A run is a stretch with smallest period q, of at least
    ``min_length`` words and ``min_exponent`` periods (3 or more), that no neighbouring word extends; runs come sorted by start, then period. A
    word is dropped where a run holds it behind the run's first q words; those left are joined by one space. A null text has no words
    and the text ''. Each row is judged by itself, whatever shares its batch: repeated rows, null ids and clashing columns change
    nothing, and an empty table gives no rows. No row is shuffled; a task holds one batch, or one long document.
    """
    item = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
    kind = pa.list_(item)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for part in _slices(texts, batch_bytes):
                # bytes split at just these six characters
                words = [(t or b"").split() for t in texts[part]]
                numbers: dict[bytes, int] = {}
                coded = [np.array([numbers.setdefault(w, len(numbers)) for w in ws], dtype=np.int64) for ws in words]
                runs = runs_of(coded, len(numbers), min_length, min_exponent)
                offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
                columns = np.concatenate(runs).T
                items = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(item))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[part],
                        pa.array([len(ws) for ws in words], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), items),
                        pa.array([_collapse(*x) for x in zip(words, runs, strict=True)], pa.binary()),
                    ],
                    schema=pa.schema([("doc_id", ids.type), ("n_words", pa.int64()), ("runs", kind), ("text", pa.binary())]),
                )

    source = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    key = dict(source.dtypes)["doc_id"]
    schema = f"doc_id {key}, n_words long, runs array<struct<start: long, length: long, period: long>>, text binary"
    return source.mapInArrow(run, schema).withColumn("text", F.col("text").cast("string"))
