"""Alignment of two tokenizers' tokens by their bytes, with fragments that compose.

Tokens are cut into groups where tokens of both sides end at one byte. A byte range of a document yields a fragment: tokens before
its first such cut (open prefix), the groups between its cuts, tokens behind its last (open suffix). Fragments of neighbouring
ranges compose, in any bracketing, so a very long document's fragments are reduced as a tree over Spark tasks.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkprint.llm.tables import row_count
from inkprint.storage import stored

LEFT_VOCABULARY, RIGHT_VOCABULARY = "byte_bpe_50k", "piece_bpe_32k.model"
# Bytes of a document that make a fragment of their own.
CHUNK_BYTES = 1 << 15
# Fragments that one step of the reduction composes.
FAN_IN = 16
# Bytes of text that are tokenized together, about.
BATCH_BYTES = 1 << 20
# So many of the most frequent id pairs are sent to every task; rarer ones are joined by shuffle. A pair takes some 30 bytes.
MAX_BROADCAST_PAIRS = 500_000
# Characters for which both byte-level libraries split words alike: ASCII and Latin letters.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7eÀ-ÖØ-öø-ſ¡¿]*")
_BLANK = "▁"

Encoder = Callable[[list[str]], list[np.ndarray]]


def left_encoder(vocabulary: str = LEFT_VOCABULARY) -> tuple[Encoder, list[bytes]]:
    """Byte-level ids of a blank and each text, special tokens' strings being plain text, and the bytes of every id."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    exact.encode_special_tokens = True
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    entries = [b""] * exact.get_vocab_size(with_added_tokens=True)
    for token, rank in ranks.items():
        entries[rank] = token

    def encode(texts: list[str]) -> list[np.ndarray]:
        found = []
        for text in texts:
            plain = _PLAIN.fullmatch(text)
            ids = fast.encode_ordinary(f" {text}") if plain else exact.encode(f" {text}", add_special_tokens=False).ids
            found.append(np.array(ids, dtype=np.int64))
        return found

    return encode, entries


def right_encoder(vocabulary: str = RIGHT_VOCABULARY) -> tuple[Encoder, list[bytes]]:
    """Piece ids of each text, which the model begins with a blank, and the bytes of every id."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))

    def entry(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(_BLANK, " ").encode()

    entries = [entry(i) for i in range(model.get_piece_size())]

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, dtype=np.int64) for ids in model.encode(texts, num_threads=1)]

    return encode, entries


def _none() -> np.ndarray:
    return np.zeros(0, dtype=np.int64)


@dataclass
class Tokens:
    """Consecutive tokens of both sides: ids, and the byte of the document where each ends."""

    a: np.ndarray = field(default_factory=_none)
    a_ends: np.ndarray = field(default_factory=_none)
    b: np.ndarray = field(default_factory=_none)
    b_ends: np.ndarray = field(default_factory=_none)

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate(x) for x in zip(self.parts(), other.parts(), strict=True)))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.a, self.a_ends, self.b, self.b_ends

    def between(self, low: int, high: int) -> Tokens:
        """Those that end behind ``low`` and not behind ``high``."""
        i, j = np.searchsorted(self.a_ends, (low, high), side="right")
        k, m = np.searchsorted(self.b_ends, (low, high), side="right")
        return Tokens(self.a[i:j], self.a_ends[i:j], self.b[k:m], self.b_ends[k:m])

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct packed (a, b) ids of tokens that share bytes, with the number of such pairs of tokens.

        Of tokens that begin at a cut: each stretch between neighbouring ends, of either side, is what just one pair shares.
        """
        ends = np.union1d(self.a_ends, self.b_ends)
        a = self.a[np.searchsorted(self.a_ends, ends)]
        return np.unique(a << 32 | self.b[np.searchsorted(self.b_ends, ends)], return_counts=True)


_NAMES = np.empty(0, dtype=object)
_MARKS = np.array([",", "|", ";", ""], dtype=object)


def groups_text(tokens: Tokens, cuts: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group, which end at ``cuts``."""
    global _NAMES
    side_of_a, side_of_b = 2 * np.searchsorted(cuts, tokens.a_ends), 2 * np.searchsorted(cuts, tokens.b_ends) + 1
    sides = np.concatenate([side_of_a, side_of_b])
    order = np.argsort(sides, kind="stable")
    ids, sides = np.concatenate([tokens.a, tokens.b])[order], sides[order]
    if len(ids) and ids.max() >= len(_NAMES):
        _NAMES = np.array([str(i) for i in range(int(ids.max()) + 1)], dtype=object)
    ends = np.r_[sides[1:] != sides[:-1], True]
    marks = np.where(ends, 1 + sides % 2, 0)
    marks[-1:] = 3
    out = np.empty(2 * len(ids), dtype=object)
    out[0::2], out[1::2] = _NAMES[ids], _MARKS[marks]
    return "".join(out.tolist())


@dataclass
class Fragment:
    """What a byte range says: with a cut, an open prefix, closed groups and an open suffix; without one, all is prefix.

    ``cut`` is the byte of the last cut, -1 without one. The first range of a document begins with a cut.
    """

    prefix: Tokens
    suffix: Tokens = field(default_factory=Tokens)
    cut: int = -1
    n_groups: int = 0
    groups: list[str] = field(default_factory=list)
    pairs: np.ndarray = field(default_factory=_none)
    times: np.ndarray = field(default_factory=_none)

    def __add__(self, other: Fragment) -> Fragment:
        if other.cut < 0:
            if self.cut < 0:
                return Fragment(self.prefix + other.prefix)
            return Fragment(self.prefix, self.suffix + other.prefix, self.cut, self.n_groups, self.groups, self.pairs, self.times)
        if self.cut < 0:
            return Fragment(self.prefix + other.prefix, other.suffix, other.cut, other.n_groups, other.groups, other.pairs, other.times)
        # what was open between the two last and first cuts is one group now
        middle = self.suffix + other.prefix
        closed = [groups_text(middle, middle.a_ends[-1:])]
        pairs, times = _total([self.pairs, middle.links()[0], other.pairs], [self.times, middle.links()[1], other.times])
        n_groups = self.n_groups + 1 + other.n_groups
        return Fragment(self.prefix, other.suffix, other.cut, n_groups, self.groups + closed + other.groups, pairs, times)


def _total(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, which = np.unique(np.concatenate(pairs), return_inverse=True)
    return distinct, np.bincount(which, weights=np.concatenate(times), minlength=len(distinct)).astype(np.int64)


def fragment(tokens: Tokens, first: bool) -> Fragment:
    """The fragment of a byte range from its tokens; the ``first`` one of a document begins with a cut at byte 0."""
    cuts = np.intersect1d(tokens.a_ends, tokens.b_ends, assume_unique=True)
    if not first and not len(cuts):
        return Fragment(tokens)
    begin = 0 if first else int(cuts[0])
    end = int(cuts[-1]) if len(cuts) else 0
    closed = tokens.between(begin, end)
    inner = cuts if first else cuts[1:]
    text = [groups_text(closed, inner)] if len(inner) else []
    pairs, times = closed.links()
    size = max(end, *(int(e[-1]) if len(e) else 0 for e in (tokens.a_ends, tokens.b_ends)))
    return Fragment(tokens.between(-1, begin), tokens.between(end, size), end, len(inner), text, pairs, times)


def fragments(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, chunk_bytes: int) -> list[Fragment]:
    """Of a whole document, one for each ``chunk_bytes`` of it; a token belongs to the range that holds its last byte."""
    size, whole = int(a_ends[-1]), Tokens(a, a_ends, b, b_ends)
    if size <= chunk_bytes:
        return [fragment(whole, True)]
    return [fragment(whole.between(low, low + chunk_bytes), low == 0) for low in range(0, size, chunk_bytes)]


def composed_runs(found: list[Fragment]) -> list[Fragment]:
    """The first step of the reduction: each ``FAN_IN`` neighbours as one, in the task that has them all."""
    return [sum(found[k + 1 : k + FAN_IN], found[k]) for k in range(0, len(found), FAN_IN)]


_INTS, _LONGS = "array<int>", "array<long>"
_OPEN = [f"{part}_{name} {kind}" for part in ("prefix", "suffix") for name, kind in (("a", _INTS), ("a_ends", _LONGS), ("b", _INTS), ("b_ends", _LONGS))]
_FRAGMENT = ["n_a long", "n_b long", "n_groups long", "groups string", f"link_a {_INTS}", f"link_b {_INTS}", f"link_n {_INTS}"]
_SCHEMA = ["_row long", "chunk int", "n_chunks int", "cut long", *_FRAGMENT, *_OPEN]
_COLUMNS = ["doc_id", *(c.split()[0] for c in _SCHEMA)]


def _packed(key: tuple, chunk: int, n_chunks: int, n_a: int, n_b: int, f: Fragment) -> tuple:
    links = (f.pairs >> 32, f.pairs & 0xFFFFFFFF, f.times)
    return (*key, chunk, n_chunks, f.cut, n_a, n_b, f.n_groups, ";".join(f.groups), *links, *f.prefix.parts(), *f.suffix.parts())


def _unpacked(r: dict) -> Fragment:
    def tokens(part: str) -> Tokens:
        return Tokens(*(np.asarray(r[f"{part}_{name}"], dtype=np.int64) for name in ("a", "a_ends", "b", "b_ends")))

    pairs = np.asarray(r["link_a"], dtype=np.int64) << 32 | np.asarray(r["link_b"], dtype=np.int64)
    groups = [r["groups"]] if r["n_groups"] else []
    return Fragment(tokens("prefix"), tokens("suffix"), r["cut"], r["n_groups"], groups, pairs, np.asarray(r["link_n"], dtype=np.int64))


def _arrow(rows: list[tuple], doc_id: pa.DataType) -> pa.RecordBatch:
    """Rows as Arrow, lists straight from their arrays."""
    keys, *others = zip(*rows, strict=True)
    columns = [pa.array(keys, doc_id)]
    for (_, kind), values in zip((c.split() for c in _SCHEMA), others, strict=True):
        if kind in (_INTS, _LONGS):
            offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
            items = np.concatenate(values).astype(np.int32 if kind == _INTS else np.int64)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(items)))
        else:
            columns.append(pa.array(values, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]))
    return pa.RecordBatch.from_arrays(columns, names=_COLUMNS)


def document_fragments(
    docs: DataFrame, left: str = LEFT_VOCABULARY, right: str = RIGHT_VOCABULARY, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Fragments of the whole texts of (doc_id, _row, text), each of up to ``FAN_IN`` ranges; one empty fragment where there are no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (encode_a, bytes_a), (encode_b, bytes_b) = left_encoder(left), right_encoder(right)
        sizes_a, sizes_b = (np.array([len(x) for x in entries], dtype=np.int64) for entries in (bytes_a, bytes_b))
        entries_a, entries_b = np.array(bytes_a, dtype=object), np.array(bytes_b, dtype=object)
        nothing = Fragment(Tokens())
        for batch in batches:
            ids = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for part in _slices(pc.binary_length(batch.column(2)).to_pylist()):
                # of a batch's texts only these are held twice
                rows, held = [], [t or "" for t in batch.column(2)[part].to_pylist()]
                for key, text, a, b in zip(ids[part], held, encode_a(held), encode_b(held), strict=True):
                    whole = f" {text}".encode()
                    if text == "" or not (b"".join(entries_a[a].tolist()) == whole == b"".join(entries_b[b].tolist())):
                        rows.append(_packed(key, 0, 1, 0, 0, nothing))
                        continue
                    found = composed_runs(fragments(a, np.cumsum(sizes_a[a]), b, np.cumsum(sizes_b[b]), chunk_bytes))
                    for chunk, f in enumerate(found):
                        own = (len(a), len(b)) if chunk == 0 else (0, 0)
                        rows.append(_packed(key, chunk, len(found), *own, f))
                yield _arrow(rows, batch.column(0).type)

    source = docs.select("doc_id", "_row", "text")
    return source.mapInArrow(run, _ddl(docs))


def _ddl(df: DataFrame) -> str:
    return ", ".join([f"doc_id {dict(df.dtypes)['doc_id']}", *_SCHEMA])


def _slices(sizes: list[int | None]) -> Iterator[slice]:
    begin, held = 0, 0
    for end, size in enumerate(sizes, start=1):
        held += size or 0
        if held >= BATCH_BYTES or end == len(sizes):
            yield slice(begin, end)
            begin, held = end, 0


def _composed(group: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring fragments of one document as one."""
    records = group.sort_values("chunk").to_dict("records")
    whole = _unpacked(records[0])
    for r in records[1:]:
        whole = whole + _unpacked(r)
    first = records[0]
    counts = (sum(r["n_a"] for r in records), sum(r["n_b"] for r in records))
    chunk, n_chunks = first["chunk"] // FAN_IN, -(-first["n_chunks"] // FAN_IN)
    return pd.DataFrame([_packed((first["doc_id"], first["_row"]), chunk, n_chunks, *counts, whole)], columns=_COLUMNS)


def align(docs: DataFrame, left: str = LEFT_VOCABULARY, right: str = RIGHT_VOCABULARY, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(_row, doc_id, n_a, n_b, n_groups, groups, link_a, link_b, link_n): the aligned tokens of every row, stored.

    Both sides encode a blank and the whole text; token bytes must give just that back. ``groups`` is their text form
    (``groups_text``); the ``link_`` arrays hold the distinct id pairs of tokens that share bytes, with how many pairs of tokens they
    stand for. A null or empty text, or one that a side does not give back, has no tokens: zeros, '' and empty arrays. Rows are
    numbered by ``_row``, so repeated rows and null ids are kept apart; other columns do not matter; an empty table gives no rows.
    Fragments are composed ``FAN_IN`` at a time, the first time where they are made: documents of up to ``FAN_IN`` times ``chunk_bytes`` never move.
    """
    numbered = docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    # numbered in the one pass that is written: later reads see the same numbers
    found = stored(document_fragments(numbered, left, right, chunk_bytes), "fragments")
    columns = ["_row", "doc_id", *(c.split()[0] for c in _FRAGMENT)]
    parts = found.where("n_chunks > 1")
    most = found.agg(F.max("n_chunks")).first()[0] or 1
    if most == 1:
        return found.select(*columns)
    while most > 1:
        parts = parts.groupBy("_row", F.floor(F.col("chunk") / FAN_IN).alias("_part")).applyInPandas(_composed, _ddl(found))
        most = -(-most // FAN_IN)
    return found.where("n_chunks = 1").select(*columns).unionByName(stored(parts.select(*columns), "composed"))


def _links(aligned: DataFrame) -> DataFrame:
    each = F.arrays_zip(F.col("link_a").alias("a"), F.col("link_b").alias("b"), F.col("link_n").alias("n"))
    return aligned.select("_row", F.inline(each))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n_docs, is_best): in how many rows an id pair is linked, and whether no other pair of its ``a`` is in more."""
    counts = _links(aligned).groupBy("a", "b").agg(F.count("*").alias("n_docs"))
    # the pairs of one a are at most the ids of the other vocabulary
    most = F.max("n_docs").over(Window.partitionBy("a"))
    return counts.select("a", "b", "n_docs", (F.col("n_docs") == most).alias("is_best"))


def link_scores(aligned: DataFrame, max_broadcast: int = MAX_BROADCAST_PAIRS) -> DataFrame:
    """(_row, n_links, n_best, count_sum) of every row that has links; counts are over all rows.

    The most frequent pairs, ``max_broadcast`` at most, are sent to every task. Others are joined by shuffle: none of them
    is in more than a ``max_broadcast``-th of all links, so no task is hot.
    """
    # a few columns of as many rows as the vocabularies have pairs: no more files than cores, however many partitions a shuffle has
    counts = stored(pair_counts(aligned).coalesce(aligned.sparkSession.sparkContext.defaultParallelism), "pairs")
    links = _links(aligned)
    if row_count(counts) <= max_broadcast:
        met = links.join(F.broadcast(counts), ["a", "b"])
    else:
        frequent = stored(counts.orderBy(F.col("n_docs").desc(), "a", "b").limit(max_broadcast), "frequent-pairs")
        rare = counts.join(F.broadcast(frequent.select("a", "b")), ["a", "b"], "left_anti")
        others = links.join(F.broadcast(frequent.select("a", "b")), ["a", "b"], "left_anti")
        met = links.join(F.broadcast(frequent), ["a", "b"]).unionByName(others.join(rare, ["a", "b"]))
    n = F.col("n").cast("long")
    best = F.sum(F.when(F.col("is_best"), n).otherwise(0))
    return met.groupBy("_row").agg(F.sum(n).alias("n_links"), best.alias("n_best"), F.sum(n * F.col("n_docs")).alias("count_sum"))
