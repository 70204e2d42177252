"""N-gram Jaccard join: MinHash bands propose pairs, full n-gram sets decide."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.graphs import components
from inkprint.storage import stored

NGRAM = 5
THRESHOLD = 0.8
# A pair at the threshold meets in some band with this probability; nearer pairs with a higher one.
RECALL = 0.998
ROWS = 6
# Rounds in which a bucket's members meet one leader each, before the rest meet one another.
STAR_ROUNDS = 2
# Members that one task compares with as many others.
BLOCK = 512
_GRAM_SLICE = 8192
# Signatures must agree so much less than the threshold for a pair to be passed over: five deviations at 126 hashes.
MARGIN = 0.18
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
_CACHED_WORDS = 500_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands of ``rows`` hashes with 1 - (1 - threshold**rows)**bands >= recall."""
    if threshold >= 1:
        return 1
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(self) < _CACHED_WORDS:
            self[word] = value
        return value


def gram_set(text: str | None, hashes: dict[str, int], n: int = NGRAM) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of a text's word n-grams; fewer than n words are one gram, none are no gram."""
    text = text or ""
    tokens = _WORD.findall(text.lower() if text.isascii() else text.translate(_UPPER))
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    words = np.fromiter(map(hashes.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    width = min(n, len(words))
    grams = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        grams = (grams ^ words[i : len(words) - width + 1 + i]) * _MULTIPLIER
        grams ^= grams >> np.uint64(29)
    return np.unique(grams)


def _hash_family(size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    return rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, size, dtype=np.uint64)


def signature(grams: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The least hash of the set under each function."""
    least = np.full(len(factors), np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(grams), 2048):
        hashed = (grams[i : i + 2048, None] * factors + shifts) >> np.uint64(32)
        np.minimum(least, hashed.min(axis=0).astype(np.uint32), out=least)
    return least


def sketches(docs: DataFrame, n: int = NGRAM, bands: int | None = None, rows: int = ROWS) -> DataFrame:
    """(row, doc_id, n_grams, digest, bands, signature) of (row, doc_id, text): equal sets have equal digests."""
    n_bands = bands or bands_for(rows=rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, (factors, shifts) = _WordHashes(), _hash_family(n_bands * rows)
        for batch in batches:
            out = []
            for row, doc_id, text in zip(batch["row"], batch["doc_id"].array, batch["text"], strict=True):
                grams = gram_set(text, hashes, n)
                if not len(grams):
                    out.append((row, doc_id, 0, None, [], b""))
                    continue
                least = signature(grams, factors, shifts)
                keys = [
                    int.from_bytes(hashlib.blake2b(part.tobytes(), digest_size=8, salt=i.to_bytes(2, "little")).digest(), "little", signed=True)
                    for i, part in enumerate(least.reshape(n_bands, rows))
                ]
                digest = hashlib.md5(grams.tobytes()).hexdigest()
                out.append((row, doc_id, len(grams), digest, keys, least.astype("<u2").tobytes()))
            columns = ["row", "doc_id", "n_grams", "digest", "bands", "signature"]
            yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    schema = "row long, doc_id long, n_grams long, digest string, bands array<long>, signature binary"
    return docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def verified(pairs: DataFrame, texts: DataFrame, n: int = NGRAM) -> DataFrame:
    """(a, b, jaccard) of (a, b) on the full n-gram sets of their texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for batch in batches:
            # pairs come sorted by b: one set serves a run of pairs
            last, values, held = None, [], None
            for b, text_a, text_b in zip(batch["b"], batch["text_a"], batch["text_b"], strict=True):
                if b != last:
                    last, held = b, gram_set(text_b, hashes, n)
                values.append(_jaccard(gram_set(text_a, hashes, n), held))
            yield batch[["a", "b"]].assign(jaccard=values)

    side = texts.select(F.col("row").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("row").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(side, "a").join(other, "b").mapInPandas(run, "a long, b long, jaccard double")


def _root(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _likely(group: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays (share, x, y) of the places in a block pair whose signatures may agree enough, the likeliest first.

    In a block of near copies that is nearly every pair, so they are kept as numbers of 4 bytes and not as objects.
    """
    marks = np.frombuffer(b"".join(group["signature"]), dtype="<u2").reshape(len(group), -1)
    first, second = group["_i"].iat[0], group["_j"].iat[0]
    block = group["_block"].to_numpy()
    shares, xs, ys = [np.zeros(0, np.float32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    all_others = np.flatnonzero(block == second)
    for x in np.flatnonzero(block == first):
        others = all_others[all_others > x] if first == second else all_others
        agree = (marks[others] == marks[x]).sum(axis=1)
        near = agree / marks.shape[1] >= threshold - MARGIN
        shares.append(agree[near].astype(np.float32))
        ys.append(others[near].astype(np.int32))
        xs.append(np.full(len(ys[-1]), x, dtype=np.int32))
    share, x, y = (np.concatenate(part) for part in (shares, xs, ys))
    order = np.argsort(-share, kind="stable")
    return share[order].astype(np.float64) / marks.shape[1], x[order], y[order]


def _similar_within(threshold: float):
    """(bucket, _i, _j, a, b, sure) of likely pairs of a block pair; those that sure pairs would connect are left out.

    A sure pair is one that signatures alone speak for: where its sets turn out otherwise, the block pair is to be met again.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("row")
        ids, parent = group["row"].to_numpy(), np.arange(len(group))
        share, x, y = _likely(group, threshold)
        sure, offered = share >= threshold + MARGIN / 2, np.zeros(len(share), dtype=bool)
        # sure pairs come first
        n_sure = int(sure.sum())
        for k in range(n_sure):
            rx, ry = _root(parent, x[k]), _root(parent, y[k])
            if rx != ry:
                offered[k] = True
                parent[rx] = ry
        roots = np.array([_root(parent, i) for i in range(len(group))])
        offered[n_sure:] = roots[x[n_sure:]] != roots[y[n_sure:]]
        a, b = ids[x[offered]], ids[y[offered]]
        place = {c: group[c].iat[0] for c in ("bucket", "_i", "_j")}
        return pd.DataFrame({**place, "a": np.minimum(a, b), "b": np.maximum(a, b), "sure": sure[offered]})

    return run


def _linked_within(n: int, threshold: float):
    """(a, b) of links in a block pair that connect its components (_own): pairs count as connected only by their sets."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("row")
        ids, texts, parent = group["row"].to_numpy(), group["text"].array, np.arange(len(group))
        for places in group.reset_index(drop=True).groupby("_own").indices.values():
            parent[places] = places[0]
        hashes, sets, out = _WordHashes(), {}, []
        for x, y in zip(*_likely(group, threshold)[1:], strict=True):
            rx, ry = _root(parent, x), _root(parent, y)
            if rx == ry:
                continue
            for i in (x, y):
                if i not in sets:
                    sets[i] = gram_set(texts[i], hashes, n)
            if _jaccard(sets[x], sets[y]) >= threshold:
                parent[rx] = ry
                out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _block_pairs(members: DataFrame, key: str, block: int) -> DataFrame:
    """Each member of a group of ``key`` once for every pair (_i <= _j) of blocks that its own block (_block) is in."""
    sizes = members.groupBy(key).agg(F.count("*").alias("_size"))
    dealt = members.join(sizes, key).withColumn("_blocks", F.ceil(F.col("_size") / block).cast("int"))
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("row"), F.col("_blocks")).cast("int"))
    each = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return each.withColumns({"_i": F.least("_block", "_with"), "_j": F.greatest("_block", "_with")}).drop("_with", "_size", "_blocks")


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _jaccard_matrix(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Similarities of all sets of two blocks, by products of 0/1 matrices over slices of the grams."""
    left_sizes, right_sizes = (np.array([len(s) for s in side]) for side in (left, right))
    _, codes = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owner = np.concatenate([np.repeat(np.arange(len(left)), left_sizes), np.repeat(np.arange(len(right)), right_sizes)])
    on_left = np.arange(len(codes)) < left_sizes.sum()
    order = np.argsort(codes, kind="stable")
    codes, owner, on_left = codes[order], owner[order], on_left[order]
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    for low in range(0, int(codes[-1]) + 1, _GRAM_SLICE):
        part = slice(*np.searchsorted(codes, [low, low + _GRAM_SLICE]))
        held = []
        for count, mine in ((len(left), on_left[part]), (len(right), ~on_left[part])):
            ones = np.zeros((count, _GRAM_SLICE), dtype=np.float32)
            ones[owner[part][mine], codes[part][mine] - low] = 1
            held.append(ones)
        common += held[0] @ held[1].T
    return common.astype(np.float64) / (left_sizes[:, None] + right_sizes[None, :] - common)


def _first_links(n: int, threshold: float):
    """(a, b) with a link of each newcomer of a block to a member, if it has one."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        hashes, new = _WordHashes(), group["newcomer"].to_numpy()
        sets, rows = [gram_set(t, hashes, n) for t in group["text"]], group["row"].to_numpy()
        own, members = np.flatnonzero(new), np.flatnonzero(~new)
        near = _jaccard_matrix([sets[i] for i in own], [sets[i] for i in members]) >= threshold if len(own) and len(members) else np.zeros((0, 0))
        linked = np.flatnonzero(near.any(axis=1)) if near.size else []
        pairs = [(rows[own[i]], rows[members[near[i].argmax()]]) for i in linked]
        return pd.DataFrame([(min(p), max(p)) for p in pairs], columns=["a", "b"], dtype="int64")

    return run


def _attached(newcomers: DataFrame, classes: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b) of links between (row, component) newcomers and the members of that component, block against block."""

    def blocks(df: DataFrame, own: str, count: str) -> DataFrame:
        sizes = df.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(count))
        return df.join(sizes, "component").withColumn(own, F.pmod(F.xxhash64("row"), F.col(count)).cast("int"))

    members = classes.select(F.col("node").alias("row"), "component").join(newcomers.select("component").distinct(), "component", "left_semi")
    new, old = blocks(newcomers, "_i", "_news"), blocks(members, "_j", "_olds")

    def met(df: DataFrame, other: DataFrame, count: str, place: str, newcomer: bool) -> DataFrame:
        counts = other.select("component", count).distinct()
        each = F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias(place)
        return df.join(counts, "component").select("component", "row", "_i" if place == "_j" else "_j", each, F.lit(newcomer).alias("newcomer"))

    both = met(new, old, "_olds", "_j", True).unionByName(met(old, new, "_news", "_i", False))
    return both.join(texts, "row").groupBy("component", "_i", "_j").applyInPandas(_first_links(n, threshold), "a long, b long")


def links(buckets: DataFrame, marks: DataFrame, texts: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(node, component) of what verified links connect: similar members of a bucket are always in one component.

    In each star round a bucket's open members meet one leader, so a group of copies takes as many pairs as it has
    members. A member that is not in the leader's component after that stays open, and may still link to one that is: it is put
    down as a newcomer to that component. What is open after the rounds is compared by signature, block against
    block, and pairs that may be similar are verified. At last every newcomer that nothing has connected to its component
    meets the members of it. Pairs that surer pairs seemed to connect are met again, by their sets, wherever one of
    those failed. No bucket is cut and no likely pair of one is passed over. Between the steps links are contracted to one
    for each node.
    """
    edges, classes, newcomers = None, None, []
    still, n_still = buckets.select("bucket", "row", F.lit(None).cast("long").alias("_own")), buckets.count()

    def connected(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Components of the contracted links and these pairs, and their links."""
        near = stored(verified(pairs, texts, n), "verified-pairs").where(F.col("jaccard") >= threshold).select("a", "b")
        found = stored(components(near if edges is None else edges.unionByName(near)), "components")
        return found, found.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))

    for turn in range(STAR_ROUNDS):
        order = F.xxhash64("row", F.lit(turn))
        leaders = still.groupBy("bucket").agg(
            F.min_by(F.struct("row", "_own"), order).alias("_leader"), F.count("*").alias("_n")
        ).where("_n > 1").select("bucket", F.col("_leader.row").alias("leader"), F.col("_leader._own").alias("_theirs"))
        apart = (F.col("row") != F.col("leader")) & ~F.coalesce(F.col("_own") == F.col("_theirs"), F.lit(False))
        met = stored(still.join(leaders, "bucket").where(apart).select("bucket", "row", "leader"), "bucket-stars", n_still)
        classes, edges = connected(met.select(*_ordered("row", "leader")).distinct())
        own = classes.select(F.col("node").alias("row"), F.col("component").alias("_own"))
        theirs = classes.select(F.col("node").alias("leader"), F.col("component").alias("_theirs"))
        met = met.join(own, "row", "left").join(theirs, "leader", "left")
        still = stored(met.where(~F.coalesce(F.col("_own") == F.col("_theirs"), F.lit(False))), "open-members", n_still)
        n_still = still.count()
        newcomers.append(still.where("_theirs IS NOT NULL").select("row", "leader"))
        still = still.select("bucket", "row", "_own")
    several = still.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1").select("bucket")
    rest = _block_pairs(still.join(several, "bucket"), "bucket", BLOCK).join(marks.select("row", "signature"), "row")
    place = ["bucket", "_i", "_j"]
    offered = rest.groupBy(*place).applyInPandas(_similar_within(threshold), "bucket long, _i int, _j int, a long, b long, sure boolean")
    offered = stored(offered, "likely-pairs")
    classes, edges = connected(offered.select("a", "b").distinct())
    own = classes.select(F.col("node").alias("row"), F.col("component").alias("_own"))
    ends = [own.select(F.col("row").alias(x), F.col("_own").alias(f"_{x}")) for x in ("a", "b")]
    apart = offered.where("sure").join(ends[0], "a", "left").join(ends[1], "b", "left").where("NOT coalesce(_a = _b, false)")
    again = stored(apart.select(*place).distinct(), "failed-blocks")
    if not again.isEmpty():
        held = rest.drop("_own").join(again, place, "left_semi").join(own, "row", "left").join(texts, "row")
        found = held.groupBy(*place).applyInPandas(_linked_within(n, threshold), "a long, b long")
        edges = edges.unionByName(stored(found, "block-links"))
        classes = stored(components(edges), "components")
    own = classes.select(F.col("node").alias("row"), F.col("component").alias("_own"))
    theirs = classes.select(F.col("node").alias("leader"), "component")
    waiting = reduce(DataFrame.unionByName, newcomers).distinct().join(theirs, "leader").join(own, "row", "left")
    waiting = stored(waiting.where(~F.col("_own").eqNullSafe(F.col("component"))).select("row", "component").distinct(), "newcomers")
    return components(edges.unionByName(_attached(waiting, classes, texts, n, threshold)))


def near_duplicate_classes(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, copy_row, class_row) of every document, and the texts (row, text) of those that met others.

    ``docs`` has row, doc_id and text, row being unique. ``copy_row`` is the least row of the documents with the same
    n-gram set, ``class_row`` that of all documents that chains of links connect. Documents without words have no set: each is alone. A
    document links to another if the Jaccard similarity of their sets of word n-grams is ``threshold`` at least.
    """
    # never fewer bands than at the default: MARGIN is for that many hashes
    marks = stored(sketches(docs, n, max(bands_for(), bands_for(threshold))), "minhash")
    copies = marks.where("digest IS NOT NULL").groupBy("digest").agg(F.min("row").alias("copy_row"))
    copies = stored(copies, "copies")
    banded = marks.join(copies.select(F.col("copy_row").alias("row")), "row", "left_semi").select("row", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1").select("bucket")
    buckets = stored(banded.join(shared, "bucket"), "buckets")
    # candidates grow with the documents: texts meet them by shuffle at every size
    met = buckets.select("row").distinct().hint("merge")
    texts = stored(docs.select("row", "text").join(met, "row", "left_semi"), "candidate-texts")
    classes = links(buckets, marks, texts, n, threshold).select(F.col("node").alias("copy_row"), F.col("component").alias("class_row"))
    placed = marks.select("row", "doc_id", "digest").join(copies, "digest", "left").join(classes, "copy_row", "left")
    copy_row = F.coalesce("copy_row", "row")
    return placed.select("row", "doc_id", copy_row.alias("copy_row"), F.coalesce("class_row", copy_row).alias("class_row")), texts


def _count_links(n: int, threshold: float):
    """Per text of a block pair, how many documents and texts of the other block are linked to it."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        hashes = _WordHashes()
        first, second = group["_i"].iat[0], group["_j"].iat[0]
        block = group["_block"].to_numpy()
        sets = [gram_set(t, hashes, n) for t in group["text"]]
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        near = _jaccard_matrix([sets[i] for i in left], [sets[i] for i in right]) >= threshold
        if first == second:
            np.fill_diagonal(near, False)
        weights = group["copies"].to_numpy()
        rows = group["row"].to_numpy()
        out = [pd.DataFrame({"row": rows[left], "docs": near @ weights[right], "texts": near.sum(axis=1)})]
        if first != second:
            out.append(pd.DataFrame({"row": rows[right], "docs": near.T @ weights[left], "texts": near.sum(axis=0)}))
        return pd.concat(out)

    return run


def similarity_join(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, copy_id, n_links, n_linked_texts) of (doc_id, text): one row per document.

    ``class_id`` is the smallest doc_id that chains of links lead to, ``copy_id`` the smallest with the same n-gram set. ``n_links`` counts the other
    documents at a Jaccard similarity of ``threshold`` at least, equal ones included, and ``n_linked_texts`` the other sets; both
    are exact within the class: its sets meet block by block in matrix products, and only counts leave a task. Null and empty texts and those without words link to nothing. Repeated
    rows are documents of their own; null ids are kept; other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    placed, texts = near_duplicate_classes(rows, n, threshold)
    placed = stored(placed, "near-duplicates")
    per_text = placed.groupBy("copy_row").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("copy_id"), F.first("class_row").alias("class_row")
    )
    per_class = per_text.groupBy("class_row").agg(F.min("copy_id").alias("class_id"), F.count("*").alias("_texts"))
    several = per_class.where("_texts > 1").select("class_row")
    members = per_text.select(F.col("copy_row").alias("row"), "copies", "class_row").join(several, "class_row")
    dealt = _block_pairs(members, "class_row", BLOCK).join(texts, "row")
    counted = dealt.groupBy("class_row", "_i", "_j").applyInPandas(_count_links(n, threshold), "row long, docs long, texts long")
    counted = counted.groupBy(F.col("row").alias("copy_row")).agg(F.sum("docs").alias("_docs"), F.sum("texts").alias("_near"))
    described = per_text.join(per_class.drop("_texts"), "class_row").join(counted, "copy_row", "left")
    n_docs, n_texts = (F.coalesce(c, F.lit(0)) for c in ("_docs", "_near"))
    described = described.select("copy_row", "class_id", "copy_id", (n_docs + F.col("copies") - 1).alias("n_links"), n_texts.alias("n_linked_texts"))
    return placed.select("doc_id", "copy_row").join(described, "copy_row").drop("copy_row")


def deduplicate(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class of near-duplicates: the one of the least id, then of the least row.

    Null ids come last. Documents without words stay, each on its own; other columns pass through.
    """
    whole = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all")
    )
    placed, _ = near_duplicate_classes(whole.select("row", "doc_id", "text"), n, threshold)
    kept = placed.groupBy("class_row").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_last"), "doc_id", "row")).alias("_first"))
    return whole.select("row", "_all").join(kept.select("_first.row"), "row", "left_semi").select("_all.*")
