"""Secret scans: base patterns by kind, and weak parts linked to access identifiers within a scope."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.storage import stored

# Code points within which parts of one credential are looked for.
SCOPE = 400


@dataclass(frozen=True)
class Kind:
    """A pattern; a match counts if its ``group`` has ``least`` characters, and by itself unless ``weak``."""

    name: str
    pattern: str
    group: int
    least: int
    weak: bool = False


# The three base kinds are matched exactly as the contract words them.
KINDS = (
    Kind("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20),
    Kind("hex", r"[0-9a-f]+", 0, 24),
    Kind("secret", r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", 0, 40, weak=True),
    Kind("endpoint", r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/%-]*)?", 0, 10, weak=True),
)


def _may_match(text: Column, kind: Kind) -> Column:
    """False only where no match of the least size exists; cheaper than finding every match."""
    pattern = {"access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}", "endpoint": r"https?://"}.get(kind.name, kind.pattern)
    return text.rlike(pattern)


def _matches(text: Column, kind: Kind) -> Column:
    """Per leftmost non-overlapping match: (code points since the last one, its length, whether it counts)."""
    # a run shorter than the least size never counts and overlaps no other match of these two kinds
    pattern = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}.get(kind.name, kind.pattern)
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(kind.group)) if kind.group else whole
    found = F.transform(
        F.sequence(F.lit(1), F.size(whole)),
        lambda i: F.struct(
            i.alias("place"),
            F.char_length(F.element_at(gaps, i)).alias("gap"),
            F.char_length(F.element_at(whole, i)).alias("length"),
            (F.char_length(F.element_at(part, i)) >= kind.least).alias("counts"),
        ),
    )
    return F.when(_may_match(text, kind) & (F.size(whole) > 0), found)


def parts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, kind, start, end) of every match that counts, and a row of null kind for every document.

    Written once: whole texts are scanned in a single pass and stay behind.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", *[_matches(text, k).alias(f"_{i}") for i, k in enumerate(KINDS)]
        ),
        "secret-matches",
    )
    each = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(f"_{i}").alias("found")) for i in range(len(KINDS))])
    rows = found.where(" OR ".join(f"_{i} IS NOT NULL" for i in range(len(KINDS)))).select("row", F.inline(each))
    rows = rows.select("row", "kind", F.inline("found"))
    so_far = Window.partitionBy("row", "kind").orderBy("place")
    ended = rows.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(so_far)).where("counts")
    placed = ended.select("row", "kind", (F.col("end") - F.col("length")).alias("start"), "end")
    return found.select("row", "doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("kind", "int"), ("start", "long"), ("end", "long"))]).unionByName(
        placed.withColumn("doc_id", F.lit(None).cast("long"))
    )


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts of ``found`` that have their complement within ``scope`` code points.

    A secret counts next to an access identifier; an endpoint next to an access identifier and a secret or assignment.
    The interval join meets, per document and bucket of ``scope`` code points, one row with the first and the last
    start of each sort of part; so a text full of parts makes no pairs.
    """
    sort = {"access": "access", "assign": "secret", "secret": "secret"}
    names = [k.name for k in KINDS]
    complement = F.coalesce(*[F.when(F.col("kind") == names.index(n), F.lit(s)) for n, s in sort.items()])
    width = F.lit(scope)
    strong = (
        found.withColumn("sort", complement)
        .where("sort IS NOT NULL")
        .groupBy("row", F.floor(F.col("start") / width).alias("bucket"))
        .agg(*[f(F.when(F.col("sort") == s, F.col("start"))).alias(f"{n}_{s}") for s in ("access", "secret") for n, f in (("first", F.min), ("last", F.max))])
    )
    low, high = F.greatest(F.col("start") - width, F.lit(0)), F.col("end") + width
    weak = found.where(F.col("kind").isin([i for i, k in enumerate(KINDS) if k.weak])).withColumns({"low": low, "high": high})
    met = weak.withColumn("bucket", F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))).join(strong, ["row", "bucket"])

    def near(sort: str) -> Column:
        return F.max((F.col(f"last_{sort}") >= F.col("low")) & (F.col(f"first_{sort}") <= F.col("high")))

    per_part = met.groupBy("row", "kind", "start", "end").agg(near("access").alias("has_access"), near("secret").alias("has_secret"))
    is_secret = F.col("kind") == names.index("secret")
    return per_part.where(F.col("has_access") & (is_secret | F.col("has_secret"))).select("row", "kind", "start", "end")


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans): what each whole text gives away.

    ``base`` and ``spans`` hold kind:start:end, in code points with the end exclusive, by start and then by kind as listed,
    joined by commas; ``spans`` also has the linked weak parts. A null text counts as empty; texts without a match keep a
    row. Matching, offsets and links are Spark expressions, windows and joins; rows are kept apart even where ids repeat.
    """
    found = stored(parts(docs), "secret-parts")
    strong = found.where(F.col("kind").isNull() | ~F.col("kind").isin([i for i, k in enumerate(KINDS) if k.weak]))
    every = strong.unionByName(linked(found, scope).withColumn("doc_id", F.lit(None).cast("long")))
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))
    per_row = every.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        *[F.count_if(F.col("kind") == i).alias(f"n_{k.name}") for i, k in enumerate(KINDS) if not k.weak],
        F.sort_array(F.collect_list(span)).alias("_spans"),
    )
    names = F.array(*[F.lit(k.name) for k in KINDS])

    def joined(spans: Column) -> Column:
        shown = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
        return F.array_join(shown, ",")

    first_weak = next(i for i, k in enumerate(KINDS) if k.weak)
    base = F.filter("_spans", lambda s: s["kind"] < first_weak)
    counts = [f"n_{k.name}" for k in KINDS if not k.weak]
    return per_row.select("doc_id", *counts, joined(base).alias("base"), joined(F.col("_spans")).alias("spans"))
