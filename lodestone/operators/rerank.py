"""Rerank bookkeeping around a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def containment(query: Column, text: Column) -> Column:
    """The default scorer: the share of a query's distinct tokens that a text holds."""
    q = F.array_distinct(T.tokens(query))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, T.tokens(text))) / F.size(q))


def held_share(query_tokens: str = "query_tokens", text_tokens: str = "text_tokens") -> Callable[[Column, Column], Column]:
    """The same scorer over columns of distinct tokens, which are made once for each query and document and not for each pair."""
    q, t = F.col(query_tokens), F.col(text_tokens)
    return lambda query, text: F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))


def distinct_tokens(text: Column) -> Column:
    return F.array_distinct(T.tokens(text))


def matched(ranked: DataFrame, originals: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Reranked rows with their place among the originals (orig_rank, payload), met by the keys: a path and chunk number, or all columns of the
    record. Nulls meet nulls; of several equal originals the first counts; without one the rank is null."""
    first = originals.groupBy(*keys).agg(F.min(F.struct("orig_rank", *payload)).alias("o"))
    renamed = first.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "o")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & ranked[k].eqNullSafe(renamed[f"_k{i}"])
    return ranked.join(renamed, on, "left").select(*[ranked[c] for c in ranked.columns], F.col("o.orig_rank").alias("orig_rank"), *[F.col("o").getField(c).alias(c) for c in payload])


def candidates(rows: DataFrame, cap: int = 50, budget: float | None = None) -> DataFrame:
    """rows(query_id, orig_rank, text, ..): non-empty texts, at most ``cap`` a query, and with a budget only while the running sum of a quarter of the characters stays in it."""
    order = W.partitionBy("query_id").orderBy("orig_rank")
    kept = rows.where(F.col("text").isNotNull() & (F.col("text") != "")).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap)
    if budget is not None:
        kept = kept.withColumn("_t", F.sum(F.length("text") / 4.0).over(order.rowsBetween(W.unboundedPreceding, 0))).where(F.col("_t") <= budget).drop("_t")
    return kept.drop("_n")


def rerank(rows: DataFrame, n: int, score: Callable[[Column, Column], Column] = containment) -> DataFrame:
    """rows(query_id, query, doc_id, orig_rank, text, ..) -> the same with score, rank, rank_improvement and method, the n best of each query.

    A scorer that fails gives null; a query with any null keeps the order it
    came in, with method ``fallback``.
    """
    scored = rows.withColumn("score", F.round(score(F.col("query"), F.col("text")), 6))
    failed = F.max(F.col("score").isNull()).over(W.partitionBy("query_id"))
    marked = scored.withColumn("method", F.when(failed, "fallback").otherwise("scored"))
    order = W.partitionBy("query_id").orderBy(F.when(F.col("method") == "scored", -F.col("score")), "orig_rank", "doc_id")
    ranked = marked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.withColumn("rank_improvement", F.coalesce(F.col("orig_rank") - F.col("rank"), F.lit(0)))


def impact(ranked: DataFrame) -> DataFrame:
    """Per query: how far reranking moved the rows."""
    moved = F.col("orig_rank") - F.col("rank")
    return ranked.groupBy("query_id").agg(
        F.round(F.avg(moved), 6).alias("avg_change"),
        F.max(moved).alias("max_change"),
        F.min(moved).alias("min_change"),
        F.count_if(moved > 0).alias("improved"),
        F.count_if(moved < 0).alias("degraded"),
        F.count_if(moved == 0).alias("unchanged"),
        F.round(F.max("score") - F.min("score"), 6).alias("score_spread"),
    )
