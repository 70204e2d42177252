"""The operators over their whole tables, with the columns their contracts ask for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.functions.text import let
from inkprint.llm import (
    alignment,
    decontamination,
    language,
    lines,
    near_duplicates,
    packing,
    periodic,
    reputation,
    secrets,
    sharding,
    suffixes,
    topk,
    toxicity,
)
from inkprint.llm.tables import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.similarity_join(table(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document with several label rows counts once, as toxic if one of them says so."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.where(~toxicity.is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = docs.select("doc_id", "text").join(known, "doc_id").withColumnRenamed("doc_id", "id")
    scored = toxicity.tag(docs, toxicity.fit_toxicity(labelled))
    return scored.select(
        "doc_id",
        toxicity.is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "spans",
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    # what is left need not be whole characters
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "spans", text)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = language.fit_text_model(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    of_docs = language.identify(language.document_fields(docs), model).withColumnRenamed("id", "doc_id")
    of_pages = language.identify(language.page_fields(pages), model).withColumnRenamed("id", "page_id")
    columns = ["doc_id", "page_id", "language", "posterior", "text_language", "kept"]
    return of_docs.unionByName(of_pages, allowMissingColumns=True).select(*columns)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


RULES = (
    reputation.Rule("block", "net"),
    reputation.Rule("allow", "example.net", "/en/"),
    reputation.Rule("block", "example.com", "/de/"),
    reputation.Rule("allow", "org", "/fr/"),
)


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document that its address numbers; it is bad where this is labelled toxic or of no quality."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    number = F.regexp_extract(reputation.url_path(F.col("url")), r"/([0-9]{1,18})(?:\.html|/)?\z", 1)
    shown = pages.select("url", number.try_cast("long").alias("doc_id"))
    known = labels.groupBy("doc_id").agg(F.bool_or((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return reputation.judge_urls(pages, shown.join(known, "doc_id"), RULES)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    # digests first: no text moves for the join
    documents = aligned.select("_row", "doc_id", "n_a", "n_b", "n_groups", digest)
    sums = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_links", "n_best", "count_sum")]
    return documents.join(alignment.link_scores(aligned), "_row", "left").select(*documents.columns[1:], *sums)


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where each tenth document, by crc32 of its id, goes on in periods of its own words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.pmod(h, F.lit(10)) == 0

    def planted(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return let(
            F.struct(words.alias("w"), a.alias("a"), p.alias("p")),
            lambda s: F.array_join(
                F.transform(
                    s["w"],
                    lambda _, i: F.get(s["w"], F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]).cast("int")),
                ),
                " ",
            ),
        )

    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), "")
    text = F.when(chosen & F.col("text").isNotNull(), let(words, lambda w: F.when(F.size(w) > 0, planted(w)).otherwise("")))
    return docs.select("doc_id", F.coalesce(text, "text").alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse_runs(_with_planted_periods(table(spark, sf_dir, "documents")))
    # longer in periods, compared exactly; the first of equals stays
    best = F.aggregate(
        "runs", F.get("runs", F.lit(0)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b)
    )
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_ngram_join,
        op2_topk,
        op3_decontaminate,
        op4_toxicity,
        op5_suffix_dedup,
        op6_language_id,
        op7_packing,
        op8_sharding,
        op9_secrets,
        op10_line_dedup,
        op11_url_filter,
        op12_alignment,
        op13_periodic_runs,
    )
}
