"""Exact top-k search: term-at-a-time accumulation over blocks, then selection and merge."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Rows of one block: bounds what a task holds, not what is searched.
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
SCALE = 1024.0


def quantised(vector: Column, scale: float = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)))


def is_finite_vector(vector: Column) -> Column:
    """False for null vectors and those with a null or non-finite component."""

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    return F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False))


def _postings(vectors: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per term, the rows that hold it and their weights."""
    width = max((len(v) for v in vectors), default=0)
    dense = np.zeros((width, len(vectors)), dtype=np.int64)
    for i, v in enumerate(vectors):
        dense[: len(v), i] = v
    return [(rows := np.flatnonzero(column), column[rows]) for column in dense]


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, in order."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= floor)
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], -scores[kept]))][:k]


def _search_block(k: int):
    def search(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(candidates):
            ids = candidates["vec_id"].to_numpy()
            terms = _postings(list(candidates["_vector"]))
            for query_id, number, vector in zip(queries["vec_id"], queries["_query"], queries["_vector"], strict=True):
                scores = np.zeros(len(ids), dtype=np.int64)
                for term in np.flatnonzero(vector[: len(terms)]):
                    rows, weights = terms[term]
                    scores[rows] += vector[term] * weights
                others = np.flatnonzero(ids != query_id)
                best = others[_top(scores[others], ids[others], k)]
                found.append(pd.DataFrame({"query_id": query_id, "_query": number, "vec_id": ids[best], "score": scores[best]}))
        if not found:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "_query", "vec_id", "score")})
        return pd.concat(found)

    return search


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k rows of highest inner product.

    Components are floor(1024 x); scores are exact 64-bit integers, so sums must stay below
    2**63. Ties go to the smaller id; a row never meets rows of its own id. Vectors that are null
    or hold a null, NaN or infinite component take no part; a missing component counts as 0, so an
    empty vector scores 0. Repeated query rows count once, repeated candidate rows each. Queries and
    candidates meet block by block on a grid: every query sees every candidate, a task holds one block of each,
    and only k rows per query and block go on to the merge.
    """
    usable = vectors.where(F.col(id_col).isNotNull() & is_finite_vector(F.col(vector_col)))
    rows = usable.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("_vector"), is_query.alias("_asks"))
    counts = rows.agg(F.count("*"), F.count_if("_asks")).first()
    n_candidates, n_queries = (-(-max(counts[0], 1) // candidate_block), -(-max(counts[1], 1) // query_block))

    def grid(df: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        spread = F.pmod(F.xxhash64("vec_id", "_vector"), F.lit(own_blocks))
        return df.withColumns({own: spread, other: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_blocks - 1).cast("long")))})

    asked = rows.where("_asks").select("vec_id", "_vector").distinct().withColumn("_query", F.xxhash64("_vector"))
    queries = grid(asked, "_qb", n_queries, "_cb", n_candidates)
    candidates = grid(rows.select("vec_id", "_vector"), "_cb", n_candidates, "_qb", n_queries)
    found = (
        queries.groupBy("_qb", "_cb")
        .cogroup(candidates.groupBy("_qb", "_cb"))
        .applyInPandas(_search_block(k), "query_id long, _query long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id", "_query").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
