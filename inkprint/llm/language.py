"""Language identification: text likelihoods fused with declared language, address suffix and host priors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.llm.reputation import site_parts
from inkprint.llm.tables import hash_share, slices
from inkprint.storage import broadcast_bounded, stored

# Buckets that byte trigrams are hashed to.
BUCKETS = 1 << 15
# Labelled rows the text model is fitted on, about, dealt evenly over the languages; all rows are scored and counted.
FIT_ROWS = 8_000
# A value that fewer rows declare names no language of its own.
MIN_DECLARED = 5
# Scores and priors are arrays with a place for each language; a table that declares more of them is refused.
MAX_LANGUAGES = 1_000
# Trigrams of a long text are not independent: their evidence grows to that of this many.
SATURATION = 200.0
# Pseudo-counts that a host borrows from its domain, and a domain from all pages.
PRIOR_WEIGHT = 10.0
UNDETERMINED = "und"
MIN_POSTERIOR = 0.5
# Beyond this many distinct hosts or declared values the evidence is joined by shuffle.
MAX_BROADCAST_KEYS = 100_000
_LETTERS = np.array([b if b > 127 or 97 <= b <= 122 else 32 for b in range(256)], dtype=np.int32)
_BLANK = int((32 * 961 + 32 * 31 + 32) * 2654435761 >> 8) & (BUCKETS - 1)


def _trigrams(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every trigram of all texts, one after another, and where each text begins."""
    # two blanks before each text: no trigram has letters of two texts
    parts = [b"  " + (text or "").lower().encode("utf-8", "replace") for text in texts]
    starts = np.cumsum([0, *map(len, parts)])
    letters = _LETTERS[np.frombuffer(b"".join(parts) + b"  ", dtype=np.uint8)].astype(np.int64)
    codes = letters[:-2] * 961 + letters[1:-1] * 31 + letters[2:]
    return (codes * 2654435761 >> 8) & (BUCKETS - 1), starts


@dataclass(frozen=True)
class TextModel:
    """log P(trigram | language), a row for each language."""

    languages: tuple[str, ...]
    log_probability: np.ndarray


def declared_languages(labelled: DataFrame, min_rows: int = MIN_DECLARED) -> dict[str, int]:
    """Rows of each value of ``lang`` that ``min_rows`` rows or more declare, by a grouped count of all rows."""
    named = labelled.where(F.col("lang").isNotNull() & ~F.col("lang").isin("", UNDETERMINED))
    counts = named.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows)
    # one row a language, and no more than are allowed
    found = counts.orderBy("lang").take(MAX_LANGUAGES + 1)
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} declared languages; a larger min_rows leaves out the rarest")
    return {r["lang"]: r["n"] for r in found}


def fit_text_model(labelled: DataFrame, fit_rows: int = FIT_ROWS, min_rows: int = MIN_DECLARED) -> TextModel:
    """From (id, text, lang): trigram counts of a hash sample of about ``fit_rows`` rows, whole texts.

    The languages are those of ``declared_languages``; each has the same share of the sample, or all its rows if it has fewer, so a rare
    language is fitted beside a frequent one. Rows of equal ids are taken or left together; null and empty texts count nothing. Without any
    language every text is undetermined.
    """
    declared = declared_languages(labelled, min_rows)
    languages = tuple(declared)
    shares = [F.when(F.col("lang") == lang, F.lit(fit_rows / len(declared) / n)) for lang, n in declared.items()]
    sample = labelled.where(hash_share(F.col("id")) < F.coalesce(*shares, F.lit(0.0)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for part in slices(whole)):
            for lang, rows in batch.groupby("lang"):
                codes, _ = _trigrams(rows["text"])
                found, n = np.unique(codes, return_counts=True)
                yield pd.DataFrame({"lang": lang, "bucket": found, "n": n})

    # at most languages x BUCKETS rows
    counts = sample.select("text", "lang").mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.full((len(languages), BUCKETS), 0.5)
    for r in counts.collect():
        table[languages.index(r["lang"]), r["bucket"]] += r["n"]
    table[:, _BLANK] = 0
    log_probability = np.log(np.maximum(table, 1e-9) / table.sum(axis=1, keepdims=True))
    log_probability[:, _BLANK] = 0
    return TextModel(languages, log_probability.astype(np.float32))


def text_evidence(df: DataFrame, model: TextModel, carry: tuple[str, ...]) -> DataFrame:
    """``carry`` plus n_grams and log_likelihood: per language, then for an undetermined text.

    An undetermined text's trigrams are uniform over the buckets. Blank trigrams are no evidence; a null or empty text has none.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for part in slices(whole)):
            codes, starts = _trigrams(batch["text"])
            used = (codes != _BLANK).astype(np.float32)
            n = np.add.reduceat(used, starts[:-1])
            sums = [np.add.reduceat(row[codes], starts[:-1], dtype=np.float64) for row in model.log_probability]
            sums.append(-np.log(BUCKETS) * n)
            evidence = np.stack(sums, axis=1) / (1 + n / SATURATION)[:, None]
            yield batch[list(carry)].assign(n_grams=n.astype(np.int64), log_likelihood=list(evidence.round(6)))

    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in carry) + ", n_grams long, log_likelihood array<double>"
    return df.select(*carry, "text").mapInPandas(score, schema)


def _per_language(best: Column, n_languages: int) -> list[Column]:
    return [F.count_if(best == i).cast("double").alias(f"_n{i}") for i in range(n_languages)]


def _counts(names: list[str]) -> Column:
    return F.array(*names)


def identify(df: DataFrame, model: TextModel, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carry..., language, posterior, text_language, kept) from (id, text, declared, host, domain, suffix).

    log posterior = text evidence + log P(declared | language) + log P(suffix | language) + log P(language | host). The
    likelihoods of a declared language and of an address suffix are shares among all rows whose text alone speaks for
    the language, smoothed towards the overall share; the prior of a host is smoothed towards that of its domain, and this
    towards that of all rows. All counts are grouped aggregations over all rows. A null declaration, suffix or host says nothing. A row
    is kept if its best language has ``MIN_POSTERIOR`` at least and is not "und"; without any letters it is "und" with posterior 1.
    Of equally likely languages the first in the model's order is named. Texts are read whole, long ones in slices. Every row is judged, also
    where ids repeat; an empty table gives no rows. Columns other than ``carry`` are left out, so they cannot clash.
    """
    languages = [*model.languages, UNDETERMINED]
    k = len(languages)
    keys = ("id", *carry, "declared", "host", "domain", "suffix")
    rows = stored(text_evidence(df, model, keys), "language-evidence")
    order = F.array_position("log_likelihood", F.array_max("log_likelihood")).cast("int") - 1
    rows = rows.withColumn("_best", F.when(F.col("n_grams") > 0, order).otherwise(k - 1))
    names = [f"_n{i}" for i in range(k)]
    counts = stored(rows.groupBy("declared", "host", "domain", "suffix").agg(*_per_language(F.col("_best"), k)), "language-counts")

    def rolled(*by: str) -> DataFrame:
        return counts.groupBy(*by).agg(*[F.sum(n).alias(n) for n in names])

    # one row; a language that no text speaks for keeps a little of everything
    overall = [float(x or 0) + 0.5 for x in rolled().first()]
    total = sum(overall)
    share = F.array(*[F.lit(x / total) for x in overall])
    n_all = F.array(*[F.lit(x) for x in overall])

    def likelihood(key: str) -> DataFrame:
        own = F.aggregate(_counts(names), F.lit(0.0), lambda a, x: a + x)
        value = F.zip_with(_counts(names), n_all, lambda n, m: F.log((n + PRIOR_WEIGHT * own / total) / (m + PRIOR_WEIGHT)))
        return rolled(key).where(F.col(key).isNotNull()).select(F.col(key).alias(f"_k_{key}"), value.alias(f"_e_{key}"))

    def smoothed(counts: Column, prior: Column) -> Column:
        own = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, prior, lambda n, p: (n + PRIOR_WEIGHT * p) / (own + PRIOR_WEIGHT))

    domains = rolled("domain").where("domain IS NOT NULL").select("domain", smoothed(_counts(names), share).alias("_prior"))
    hosts = rolled("host", "domain").where("host IS NOT NULL").join(domains, "domain")
    hosts = hosts.select(F.col("host").alias("_k_host"), F.transform(smoothed(_counts(names), F.col("_prior")), lambda p: F.log(p)).alias("_e_host"))
    met = rows
    for key, evidence in (("declared", likelihood("declared")), ("suffix", likelihood("suffix")), ("host", hosts)):
        met = met.join(broadcast_bounded(evidence, MAX_BROADCAST_KEYS), F.col(key) == F.col(f"_k_{key}"), "left")
    nothing = F.array(*[F.lit(0.0)] * k)
    fused = F.col("log_likelihood")
    for part, default in (("_e_declared", nothing), ("_e_suffix", nothing), ("_e_host", F.transform(share, lambda p: F.log(p)))):
        fused = F.zip_with(fused, F.coalesce(F.col(part), default), lambda a, b: a + b)
    met = met.withColumn("_fused", fused).withColumn("_top", F.array_max("_fused"))
    weight = F.aggregate("_fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    empty = F.col("n_grams") == 0
    best = F.array_position("_fused", F.col("_top")).cast("int") - 1
    called = F.array(*[F.lit(x) for x in languages])
    language = F.when(empty, UNDETERMINED).otherwise(F.get(called, best))
    posterior = F.when(empty, F.lit(1.0)).otherwise(F.round(1 / weight, 6))
    out = met.select("id", *carry, language.alias("language"), posterior.alias("posterior"), F.get(called, "_best").alias("text_language"))
    return out.withColumn("kept", (F.col("language") != UNDETERMINED) & (F.col("posterior") >= MIN_POSTERIOR))


# What is no text of a page. An element, comment or tag that is never closed reaches to the end of the page, so no part of a page is
# scanned twice.
_MARKUP = r"(?is)<script\b.*?(?:(?=</script)|\z)|<style\b.*?(?:(?=</style)|\z)|<!--.*?(?:-->|\z)|<[a-z/!?][^>]*(?:>|\z)|&#?[a-z0-9]+;"
_DECLARED = r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2})"


def page_fields(pages: DataFrame) -> DataFrame:
    """(id, text, declared, host, domain, suffix) of (page_id, url, html); what an address or page lacks is null.

    A domain stands one label above its suffix, which has two labels where a country registers names under them (``co.uk``).
    """
    html, host = F.col("html"), F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    declared = F.lower(F.regexp_extract(html, _DECLARED, 1))
    return pages.select(
        F.col("page_id").alias("id"),
        F.regexp_replace(html, _MARKUP, " ").alias("text"),
        F.nullif(declared, F.lit("")).alias("declared"),
        F.nullif(host, F.lit("")).alias("host"),
    ).withColumns(site_parts(F.col("host")))


def document_fields(docs: DataFrame) -> DataFrame:
    """The same of documents: ``lang`` is what is declared, ``source`` the host; there is no address."""
    nothing = F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.col("source").alias("domain"), nothing.alias("suffix")
    )
