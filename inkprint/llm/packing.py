"""Best-fit packing of tokenized documents, improved by swap-based local search."""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.tables import row_count
from inkprint.storage import stored

VOCABULARY = "byte_bpe_50k"
END_ID = 2
WINDOW = 1024
# Pieces that one packing task holds, about.
GROUP_PIECES = 40_000
# Characters for which both tokenizer libraries split words alike: ASCII and Latin letters, with the few
# joiners of running text. Texts with others, or with a special token's string, go to ``tokenizers`` itself.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7eÀ-ÖØ-öø-ſ¡¿]*")

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_encoder(vocabulary: str = VOCABULARY) -> Callable[[str], list[int]]:
    """ids of a text as ``tokenizers`` gives them for this vocabulary, without added specials.

    The same ranks are applied by ``tiktoken``, four times faster, to texts of plain characters, where the two
    libraries agree; all other texts are encoded by ``tokenizers``.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if "<|" not in text and _PLAIN.fullmatch(text):
            return fast.encode_ordinary(text)
        return exact.encode(text, add_special_tokens=False).ids

    return encode


def cut(n_ids: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first may be shorter, all others fill a window."""
    first = n_ids % window or min(n_ids, window)
    starts = [0, *range(first, n_ids, window)]
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], n_ids], strict=True)]


def pieces(
    docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, end_id: int = END_ID, keep_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids and ``end_id``, cut at ``window``.

    A null text counts as empty and gives one piece of the end id. Whole texts are tokenized.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = token_encoder(vocabulary)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].array, batch["text"], strict=True):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                for i, (start, length) in enumerate(cut(len(ids), window)):
                    part = ids[start : start + length]
                    row = (doc_id, i, start, length, zlib.crc32(part.tobytes()))
                    out.append((*row, part.astype("int32")) if keep_ids else row)
            columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
            yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    schema = _PIECES + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)


class Bins:
    """Bins of one capacity, found by what room they have left."""

    def __init__(self, lengths: np.ndarray, capacity: int) -> None:
        self.lengths, self.capacity = lengths, capacity
        self.items: list[set[int]] = []
        self.fill: list[int] = []
        self._by_room: dict[int, set[int]] = defaultdict(set)
        self._rooms = 0  # bit r: some bin has room r

    def _file(self, b: int, add: bool) -> None:
        room = self.capacity - self.fill[b]
        held = self._by_room[room]
        held.add(b) if add else held.discard(b)
        self._rooms = self._rooms | 1 << room if held else self._rooms & ~(1 << room)

    def change(self, b: int, take: tuple[int, ...] = (), give: tuple[int, ...] = ()) -> None:
        self._file(b, False)
        self.items[b].difference_update(take)
        self.items[b].update(give)
        self.fill[b] += sum(int(self.lengths[i]) for i in give) - sum(int(self.lengths[i]) for i in take)
        self._file(b, True)

    def tightest(self, length: int) -> int | None:
        rooms = self._rooms >> length
        if not rooms:
            return None
        return next(iter(self._by_room[length + (rooms & -rooms).bit_length() - 1]))

    def place(self, item: int) -> None:
        b = self.tightest(int(self.lengths[item]))
        if b is None:
            b = len(self.items)
            self.items.append(set())
            self.fill.append(0)
            self._file(b, True)
        self.change(b, give=(item,))


def local_search(bins: Bins) -> None:
    """Move, one-for-one and two-for-one exchanges out of the emptiest underfull bins.

    Each step takes documents from a bin and makes a fuller one fuller still, so the sum of squared fills
    rises and the search ends. Passes over the underfull bins, sorted by fill anew each time, go on until one makes no step: then no
    bin has a step left. Bins that run empty are gone; of equally good partners the one met first is taken.
    """
    lengths, capacity = bins.lengths, bins.capacity
    stepped = True
    while stepped:
        stepped = False
        waiting = sorted((b for b, f in enumerate(bins.fill) if 0 < f < capacity), key=lambda b: bins.fill[b])
        for source in waiting:
            while bins.items[source] and bins.fill[source] < capacity:
                others = [b for b in waiting if b != source and bins.fill[source] <= bins.fill[b] < capacity]
                if not others or not _step(bins, source, others, lengths, capacity):
                    break
                stepped = True


def _step(bins: Bins, source: int, others: list[int], lengths: np.ndarray, capacity: int) -> bool:
    own = sorted(bins.items[source], key=lambda i: -lengths[i])
    room = np.array([capacity - bins.fill[b] for b in others])
    for item in own:
        fits = np.flatnonzero(room >= lengths[item])
        if len(fits):
            target = others[fits[np.argmin(room[fits])]]
            bins.change(source, take=(item,))
            bins.change(target, give=(item,))
            return True
    held = [(n, i) for n, b in enumerate(others) for i in bins.items[b]]
    bin_of, item_of = (np.array(x) for x in zip(*held, strict=True))
    other_length, other_room = lengths[item_of], room[bin_of]
    out = [((item,), int(lengths[item])) for item in own]
    out += [((a, b), int(lengths[a] + lengths[b])) for n, a in enumerate(own) for b in own[n + 1 :]]
    for taken, length in out:
        gain = length - other_length
        good = np.flatnonzero((gain > 0) & (gain <= other_room))
        if len(good):
            best = good[np.argmax(gain[good])]
            target, back = others[bin_of[best]], int(item_of[best])
            bins.change(source, take=taken, give=(back,))
            bins.change(target, take=(back,), give=taken)
            return True
    return False


def pack_lengths(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Items of each bin: best fit in decreasing order, then local search. No length may exceed ``capacity``."""
    bins = Bins(lengths, capacity)
    for item in np.argsort(-lengths, kind="stable"):
        bins.place(int(item))
    local_search(bins)
    return [sorted(held) for held in bins.items if held]


def best_fit_packing(
    docs: DataFrame,
    window: int = WINDOW,
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    keep_ids: bool = False,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """The columns of ``pieces`` plus sequence_id and offset: every piece's sequence and its place there.

    Pieces that fill a window are sequences already. All others are dealt by hash to groups of about ``group_pieces``,
    each packed in one task from (id, length) rows alone; groups share no sequence, which costs one underfull sequence
    a group at most. Offsets leave no gap. An empty table gives no rows; rows with equal ids are packed one by one;
    null ids are kept.
    """
    cut_up = stored(pieces(docs, window, vocabulary, end_id, keep_ids), "pieces")
    cut_up = cut_up.withColumn("_row", F.monotonically_increasing_id())
    whole = cut_up.where(F.col("length") == window).select(
        *cut_up.columns, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    short = cut_up.where(F.col("length") < window)
    n_groups = row_count(short) // group_pieces + 1
    names = [c for c in cut_up.columns if c != "_row"]

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_row", ignore_index=True)
        lengths = group["length"].to_numpy()
        sequence, offset = np.zeros(len(group), dtype=np.int64), np.zeros(len(group), dtype=np.int64)
        for n, held in enumerate(pack_lengths(lengths, window)):
            sequence[held] = (int(group["_group"].iat[0]) << 32) + n
            offset[held] = np.cumsum(lengths[held]) - lengths[held]
        return group.assign(sequence_id=sequence, offset=offset)[["_row", *carried, "sequence_id", "offset"]]

    # ids stay behind: only lengths are packed, and ids are joined by row number where they are wanted
    carried = [] if keep_ids else names
    dealt = short.select("_row", "length", *[c for c in carried if c != "length"]).withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(n_groups)))
    types = dict(cut_up.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in ["_row", *carried]) + ", sequence_id long, offset long"
    packed = dealt.groupBy("_group").applyInPandas(pack, schema)
    if keep_ids:
        packed = short.join(packed, "_row")
    return packed.select(*names, "sequence_id", "offset").unionByName(whole.select(*names, "sequence_id", "offset"))
