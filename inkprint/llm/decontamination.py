"""Benchmark decontamination: a broadcast hash set of test n-grams against every document's windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.functions.text import let
from inkprint.llm.tables import BETWEEN_WORDS, words
from inkprint.storage import broadcast_bounded, stored

WINDOW_WORDS = 10
# A set of more windows, or of windows with more bytes of words and item ids, is joined by shuffle.
MAX_BROADCAST_WINDOWS = 200_000
MAX_BROADCAST_BYTES = 64_000_000


def _hash_at(tokens: str, lengths: list[int]) -> Column:
    """The hash of the ``length`` words from place ``at``, as of an array of them but without building it."""

    def of(length: int) -> Column:
        return F.xxhash64(*[F.get(tokens, F.col("at") + (i - 1)) for i in range(length)])

    hashes = [F.when((F.col("at") > 0) & (F.col("length") == n), of(n)) for n in lengths]
    return F.coalesce(*hashes, F.lit(None).cast("long"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """(item_id, grams): the distinct windows of each item, ids as strings."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, length))).alias("grams")).distinct()


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW_WORDS,
    carry: tuple[str, ...] = (),
    max_broadcast: int = MAX_BROADCAST_WINDOWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """(doc_id, carry..., n_words, n_hit, n_items, items, hit_spans): where benchmark items occur in whole texts.

    A window is ``window`` consecutive words of an item, or all words of a shorter item. Each document's windows are hashed
    in place, looked up in the set of window hashes, and each hit is verified on the words themselves. ``hit_spans`` are maximal
    runs of hit words, (from, to) with ``to`` exclusive; ``n_hit`` counts their words; ``items`` are the ids with an occurring window as
    strings in order. Null and empty texts have no words; an item without words has no window; an empty benchmark hits nothing.
    Rows are kept apart even where ids repeat; columns that are not carried cannot clash. The set is broadcast if it has up to ``max_broadcast``
    windows with ``max_bytes`` bytes of words and item ids; the rows are the same either way.
    """
    held = stored(benchmark_windows(benchmark, window), "benchmark-windows")
    sizes = held.groupBy("grams").agg(F.sum(F.octet_length("item_id") + 1).alias("of_items"))
    sizes = sizes.select(F.size("grams").alias("length"), (F.octet_length(F.array_join("grams", " ")) + F.col("of_items")).alias("bytes"))
    # at most ``window`` lengths; one of them unless there are short items
    n_windows, n_bytes, lengths = sizes.agg(F.count("*"), F.sum("bytes"), F.sort_array(F.collect_set("length"))).first()
    # a document counts as one row, so its number is that of the row
    tokens = docs.select("doc_id", *carry, F.monotonically_increasing_id().alias("_row"), "text")
    if n_windows <= max_broadcast and (n_bytes or 0) <= max_bytes:
        found = _met_by_broadcast(tokens, held, lengths, carry)
    else:
        found = _met_by_shuffle(tokens, held, lengths, carry)
    spans = found.withColumn("hit_spans", merged("_hits"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return spans.select(
        "doc_id", *carry, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "hit_spans"
    )


def _met_by_broadcast(tokens: DataFrame, held: DataFrame, lengths: list[int], carry: tuple[str, ...]) -> DataFrame:
    """(doc_id, carry..., n_words, _hits, items) with the whole set of windows in every task."""
    tokens = tokens.select("doc_id", *carry, "_row", words(F.col("text")).alias("_words"))
    # place 0 stands for the document itself, place i for the window from its i-th word; hashes are made after the
    # explode, so that explode, hashes, join and check compile into one loop over places
    n_places = F.greatest(F.size("_words") - F.col("length") + 1, F.lit(0))
    places = (
        tokens.withColumn("length", F.explode_outer(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")))
        .withColumn("at", F.explode_outer(F.sequence(F.lit(0), F.coalesce(n_places, F.lit(0)))))
        .withColumn("hash", _hash_at("_words", lengths))
        .where((F.col("at") > 0) | F.col("length").isNull() | (F.col("length") == F.lit(lengths[0] if lengths else None)))
    )
    wanted = held.groupBy("grams").agg(F.collect_set("item_id").alias("items"))
    wanted = wanted.select(F.size("grams").alias("_length"), F.xxhash64("grams").alias("_hash"), "grams", "items")
    same = (F.col("hash") == F.col("_hash")) & (F.col("length") == F.col("_length"))
    is_first = F.col("at") == 0
    met = places.join(F.broadcast(wanted), same, "left")
    met = met.where(is_first | (F.slice("_words", F.greatest("at", F.lit(1)), F.col("length")) == F.col("grams")))
    hit = F.when(~is_first, F.struct(F.col("at").alias("from"), (F.col("at") + F.col("length")).alias("to")))
    # beyond some documents the aggregate sorts its input, all columns that its expressions read: words must not be among them
    document = F.struct("doc_id", *carry, F.size("_words").cast("long").alias("n_words"))
    narrow = met.select("_row", F.when(is_first, document).alias("_document"), hit.alias("_hit"), "items")
    of_document = F.first("_document", ignorenulls=True)
    return narrow.groupBy("_row").agg(
        *[of_document[c].alias(c) for c in ("doc_id", *carry, "n_words")],
        F.sort_array(F.collect_set("_hit")).alias("_hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def _narrow_places(tokens: DataFrame, lengths: list[int]) -> DataFrame:
    """(_row, length, at, hash) of every window of every text: no words and no other column."""
    split = tokens.select("_row", words(F.col("text")).alias("_words"))
    places = split.withColumn("length", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")))
    places = places.where(F.size("_words") >= F.col("length"))
    places = places.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("_words") - F.col("length") + 1)))
    return places.select("_row", "length", "at", _hash_at("_words", lengths).alias("hash"))


def _met_by_shuffle(tokens: DataFrame, held: DataFrame, lengths: list[int], carry: tuple[str, ...]) -> DataFrame:
    """The same by joins on hashes: 24 bytes a word are shuffled, then the words of documents with a hashed hit alone.

    Numbered rows are written first, so that all passes read the same numbers.
    """
    n_words = F.size(words(F.col("text"))).cast("long").alias("_n_words")
    tokens = stored(tokens.select("doc_id", "_row", "text", *[c for c in carry if c not in ("doc_id", "text")], n_words), "numbered-documents")
    distinct = held.select("grams").distinct()
    numbered = distinct.select(
        F.monotonically_increasing_id().alias("_window"), F.size("grams").alias("length"), F.xxhash64("grams").alias("hash"), "grams"
    )
    windows = stored(numbered, "numbered-windows")
    near = _narrow_places(tokens, lengths).join(windows.drop("grams"), ["hash", "length"])
    by_row = stored(near.groupBy("_row").agg(F.collect_list(F.struct("at", "length", "_window")).alias("_near")), "hashed-hits")
    # texts with a hashed hit alone move, and as they are: their words take several times the room
    hit_rows = broadcast_bounded(by_row.select("_row"), MAX_BROADCAST_WINDOWS)
    own = tokens.select("_row", "text").join(hit_rows, "_row", "left_semi").join(by_row, "_row")
    own = own.select("_row", words(F.col("text")).alias("_words"), F.inline("_near")).select("_row", "at", "length", "_window", F.slice("_words", F.col("at"), F.col("length")).alias("_own"))
    verified = own.join(windows.select("_window", "grams"), "_window").where(F.col("_own") == F.col("grams"))
    hits = stored(verified.select("_row", "at", "length", "_window"), "window-hits")
    span = F.struct(F.col("at").alias("from"), (F.col("at") + F.col("length")).alias("to"))
    spans = hits.groupBy("_row").agg(F.sort_array(F.collect_set(span)).alias("_hits"))
    holders = held.join(windows.select("_window", "grams"), "grams").select("_window", "item_id")
    items = hits.select("_row", "_window").distinct().join(holders, "_window")
    items = items.groupBy("_row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return tokens.join(spans.join(items, "_row"), "_row", "left").select(
        "doc_id",
        *carry,
        F.col("_n_words").alias("n_words"),
        F.coalesce("_hits", F.array().cast("array<struct<from:int,to:int>>")).alias("_hits"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def merged(hits: str) -> Column:
    """Maximal runs of sorted (from, to) spans."""
    empty = F.array().cast("array<struct<from:int,to:int>>")

    def step(runs: Column, hit: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        joined = F.concat(
            F.slice(runs, F.lit(1), F.size(runs) - 1),
            F.array(F.struct(last["from"].alias("from"), F.greatest(last["to"], hit["to"]).alias("to"))),
        )
        return F.when((F.size(runs) > 0) & (hit["from"] <= last["to"]), joined).otherwise(
            F.concat(runs, F.array(F.struct(hit["from"].alias("from"), hit["to"].alias("to"))))
        )

    return F.aggregate(hits, empty, step)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, remove: str = "documents", max_broadcast: int = MAX_BROADCAST_WINDOWS
) -> DataFrame:
    """``docs`` without hit documents, or (``remove="spans"``) with each hit run of words cut out of its text.

    A cut takes the text from the run's first to its last character, whatever stands between its words; documents
    without hits stay as they are, byte for byte. All columns pass through, whatever their names; an empty table gives no rows.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove}")
    # the text is carried once
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    whole = docs.select("doc_id", "text", F.struct(*others).alias("_all"))
    found = contamination(whole, benchmark, window, carry=("text", "_all"), max_broadcast=max_broadcast)
    text = F.col("text")
    if remove == "documents":
        found = found.where(F.col("n_hit") == 0)
    else:
        text = _without(text, F.col("hit_spans"))
    return found.select(*[(text if c == "text" else F.col(f"_all.`{c}`")).alias(c) for c in docs.columns])


def _without(text: Column, spans: Column) -> Column:
    """``text`` without the words of ``spans`` and what stands between them."""
    # gaps[i] stands before word i + 1, the last one ends the text; one of them is empty at either end
    found = F.array_remove(F.split(text, BETWEEN_WORDS.replace("\\x60", "\\x40\\x5B-\\x60"), -1), "")
    gaps = F.split(text, "[^" + BETWEEN_WORDS[1:].replace("\\x60", "\\x40\\x5B-\\x60"), -1)

    def cut(parts: Column) -> Column:
        def kept(word: Column, i: Column) -> Column:
            inside = F.exists(spans, lambda s: (i + 1 >= s["from"]) & (i + 1 < s["to"]))
            joined = F.exists(spans, lambda s: (i + 1 > s["from"]) & (i + 1 < s["to"]))
            return F.concat(F.when(joined, "").otherwise(F.get(parts["gaps"], i)), F.when(inside, "").otherwise(word))

        return F.concat(F.array_join(F.transform(parts["words"], kept), ""), F.element_at(parts["gaps"], -1))

    # split once, not once a word
    return F.when(F.size(spans) == 0, text).otherwise(let(F.struct(found.alias("words"), gaps.alias("gaps")), cut))
