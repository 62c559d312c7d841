"""Claims of answers against their documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def support(claim: Column, doc: Column) -> Column:
    """The default scorer: the share of a claim's distinct tokens that a document holds."""
    c = F.array_distinct(T.tokens(claim))
    return F.when(F.size(c) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(c, T.tokens(doc))) / F.size(c))


def claims_of(answer: Column) -> Column:
    """An answer's claims: numbered items if there are any, else the longer sentences; the first of equal claims stays."""
    items = T.numbered_items(answer)
    return F.array_distinct(F.when(F.size(items) > 0, items).otherwise(T.claims(answer)))


def split_claims(answers: DataFrame) -> DataFrame:
    """answers(answer_id, answer) -> (answer_id, claim_idx, claim)."""
    return answers.select("answer_id", F.posexplode(claims_of(F.col("answer"))).alias("claim_idx", "claim"))


def verify(claims: DataFrame, docs: DataFrame, threshold: float = 0.5, score: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """claims(answer_id, claim_idx, claim), docs(answer_id, doc_idx, text) -> (answer_id, claim_idx, claim, max_score, supporting, is_grounded). An answer's claims meet only that answer's documents.

    Without a scorer it is ``support``, over tokens made once for each claim and document and not for each pair.
    """
    if score is None:
        claims = claims.select("answer_id", "claim_idx", "claim", F.array_distinct(T.tokens(F.col("claim"))).alias("_c"))
        docs = docs.select("answer_id", "doc_idx", F.array_distinct(T.tokens(F.col("text"))).alias("_t"))
        share = F.when(F.size("_c") == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect("_c", "_t")) / F.size("_c"))
    else:
        share = score(F.col("claim"), F.col("text"))
    pairs = claims.join(docs, "answer_id", "left").withColumn("s", F.round(F.coalesce(share, F.lit(0.0)), 6))
    out = pairs.groupBy("answer_id", "claim_idx", "claim").agg(F.max("s").alias("max_score"), F.array_sort(F.collect_list(F.when(F.col("s") >= threshold, F.col("doc_idx")))).alias("supporting"))
    return out.withColumn("is_grounded", F.col("max_score") >= threshold)


def passes(summary_: DataFrame, least: float = 0.7) -> DataFrame:
    """(answer_id, passes): the quick gate, whether enough of an answer's claims are grounded."""
    return summary_.select("answer_id", (F.col("grounding_ratio") >= least).alias("passes"))


def verify_rows(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """rows(answer_id, answer, docs: array of (doc_idx, text)) -> as ``verify`` by ``support``, without any join: an answer lies beside its own
    few documents, whose tokens are made once. An answer without claims gives one row with nulls."""
    of_doc = F.transform("docs", lambda d: F.struct(d["doc_idx"].alias("doc_idx"), F.array_distinct(T.tokens(d["text"])).alias("t")))
    held = rows.select("answer_id", claims_of(F.col("answer")).alias("claims"), of_doc.alias("docs"))
    each = held.select("answer_id", "docs", F.posexplode_outer("claims").alias("claim_idx", "claim")).withColumn("c", F.array_distinct(T.tokens(F.col("claim"))))
    share = lambda d: F.when(F.size("c") == 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect("c", d["t"])) / F.size("c"), 6))
    scored = each.select("answer_id", "claim_idx", "claim", F.transform("docs", lambda d: F.struct(d["doc_idx"].alias("doc_idx"), share(d).alias("s"))).alias("scores"))
    best = F.when(F.col("claim_idx").isNotNull(), F.coalesce(F.array_max(F.transform("scores", lambda x: x["s"])), F.lit(0.0)))
    held_by = F.array_sort(F.transform(F.filter("scores", lambda x: x["s"] >= threshold), lambda x: x["doc_idx"]))
    return scored.select("answer_id", "claim_idx", "claim", best.alias("max_score"), held_by.alias("supporting"), (best >= threshold).alias("is_grounded"))


def summary(answers: DataFrame | None, verified: DataFrame) -> DataFrame:
    """(answer_id, n_claims, n_grounded, grounding_ratio, unsupported): ratio 1 for an answer without claims. ``answers`` is not needed where ``verified`` has a row for each answer."""
    if answers is None:
        n, g = F.count("claim_idx"), F.count_if(F.coalesce("is_grounded", F.lit(False)))
        left = F.array_sort(F.collect_list(F.when(~F.col("is_grounded"), F.struct("claim_idx", "claim"))))["claim"]
        return verified.groupBy("answer_id").agg(n.alias("n_claims"), g.alias("n_grounded"), F.coalesce(F.round(g / F.when(n > 0, n), 6), F.lit(1.0)).alias("grounding_ratio"), left.alias("unsupported"))
    per = verified.groupBy("answer_id").agg(F.count("*").alias("n"), F.count_if("is_grounded").alias("g"), F.array_sort(F.collect_list(F.when(~F.col("is_grounded"), F.struct("claim_idx", "claim"))))["claim"].alias("unsupported"))
    j = answers.select("answer_id").join(per, "answer_id", "left")
    return j.select("answer_id", F.coalesce("n", F.lit(0)).alias("n_claims"), F.coalesce("g", F.lit(0)).alias("n_grounded"), F.coalesce(F.round(F.col("g") / F.col("n"), 6), F.lit(1.0)).alias("grounding_ratio"), F.coalesce("unsupported", F.array().cast("array<string>")).alias("unsupported"))
