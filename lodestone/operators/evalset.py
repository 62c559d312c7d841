"""Evaluation sets: allocation, deterministic samples, distributions, retrieval measures; and rules for noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .records import filled


def allocation(total: int, shares: dict[str, float]) -> dict[str, int]:
    """Whole numbers for each type; the last takes what rounding leaves."""
    names = list(shares)
    out = {n: int(total * shares[n]) for n in names[:-1]}
    return out | {names[-1]: total - sum(out.values())}


def sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The n rows whose hash of key and seed is smallest: the same on every run and engine. A top-n, not a sort of all rows."""
    return rows.withColumn("draw", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))).orderBy("draw").limit(n)


def questions(chunks: DataFrame, key: str, templates: dict[str, str], counts: dict[str, int], seed: str, **values: Column) -> DataFrame:
    """(key, question_type, question): for each type its number of chunks, drawn by hash, and its template filled from them. A model's wording is out of reach; the plan is the same."""
    out = None
    for kind, n in counts.items():
        one = sample(chunks, key, n, f"{seed}:{kind}").select(key, F.lit(kind).alias("question_type"), filled(templates[kind], **values).alias("question"))
        out = one if out is None else out.unionByName(one)
    return out


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those done: how a run goes on after a checkpoint."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def distributions(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each column and in all, in one pass of grouping sets."""
    cols = [F.col(c) for c in columns]
    return rows.groupingSets([*[[c] for c in cols], []], *cols).agg(F.count("*").alias("n"))


def retrieval(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """hits(query_id, rank, doc_id), truth(query_id, doc_id) -> (n_queries, hit_rate, mrr) at k."""
    first = hits.where(F.col("rank") <= k).join(truth, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    j = truth.select("query_id").distinct().join(first, "query_id", "left")
    return j.agg(F.count("*").alias("n_queries"), F.round(F.avg(F.col("rank").isNotNull().cast("double")), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


# What counts as obvious non-content. Everything else is kept.
NOISE = (
    ("reference", r"^\[[0-9]+\]\s+[^\n]*\([12][0-9]{3}\)"),
    ("page_number", r"^(?:[Pp]age\s+)?[0-9]+$"),
    ("copyright", r"^(?:©|\([cC]\)|Copyright)\s"),
    ("email", r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+$"),
    ("url", r"^https?://\S+$"),
    ("running_head", r"^[^\n|]+\|\s*(?:Volume|Vol\.?)\s*[0-9]+$"),
)


def noise_reason(paragraph: Column) -> Column:
    """Why a paragraph is no content, or null: headings always stay."""
    p = F.trim(paragraph)
    out = F.lit(None).cast("string")
    for name, pattern in reversed(NOISE):
        out = F.when(p.rlike(pattern), name).otherwise(out)
    return F.when(~p.startswith("#"), out)


def kept_if_any(parts: DataFrame, key: list[str]) -> DataFrame:
    """parts(.., decision) of a paragraph that was judged in pieces: one KEEP keeps it."""
    return parts.groupBy(*key).agg(F.bool_or(F.col("decision") == "KEEP").alias("kept"))


def first_of_equals(rows: DataFrame, key: Column, order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_k", key).withColumn("_r", F.row_number().over(W.partitionBy("_k").orderBy(*order))).where("_r = 1").drop("_k", "_r")
