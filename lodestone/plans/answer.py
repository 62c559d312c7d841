"""One call from queries to checked answers, and the service surface as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25, chats, dense, fusion, models, rerank, verify
from ..sources.corpus import Params, stored
from .relational import table


def answer(queries: DataFrame, docs: DataFrame, params: Params = Params(), temperatures: tuple[float, ...] = (0.0,)) -> DataFrame:
    """queries(query_id, query), docs(doc_id, text) -> (query_id, temperature, answer, n_sources, n_claims, n_grounded, grounding_ratio).

    Blank queries give no row. All queries share each plan step: lexical and
    dense search, fusion, reranking, context, generation, verification.
    """
    asked = queries.where(F.length(F.trim("query")) > 0)
    k = params.k_papers
    # Both searches read the documents' term counts: made once, then a table.
    counts = stored(bm25.term_counts(docs))
    lexical = bm25.search(bm25.build(docs, markdown=False, counts=counts), bm25.query_terms(asked, "query"), 2 * k)
    near = dense.knn(dense.hashed_vectors(asked, "query", "query_id").withColumnRenamed("id", "query_id"), dense.hashed_vectors(docs, counts=counts), 2 * k, sizes=(asked.count(), docs.count()))
    fused = fusion.fuse(lexical, near.withColumnRenamed("id", "doc_id"), k, (params.lexical_weight, params.dense_weight))
    cand = fused.select("query_id", F.col("rank").alias("orig_rank"), "doc_id").join(docs.select("doc_id", "text"), "doc_id").join(asked, "query_id")
    best = rerank.rerank(rerank.candidates(cand, params.max_rerank), params.n_final)
    items = best.groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("title"), "text"))).alias("items"))
    said = models.generate(items.select("query_id", "query", T.context(F.col("items"), params.n_final).alias("context")), temperatures)
    answers = said.withColumn("answer_id", F.concat_ws("|", F.col("query_id").cast("string"), F.col("temperature").cast("string")))
    sources = best.select("query_id", (F.col("rank") - 1).alias("doc_idx"), "text")
    claims = verify.split_claims(answers)
    checked = verify.verify(claims, answers.select("answer_id", "query_id").join(sources, "query_id").select("answer_id", "doc_idx", "text"), params.grounded)
    total = verify.summary(answers, checked).drop("unsupported")
    n = items.select("query_id", F.size("items").alias("n_sources"))
    return answers.join(total, "answer_id").join(n, "query_id").select("query_id", "temperature", "answer", "n_sources", "n_claims", "n_grounded", "grounding_ratio")


def health(collections: DataFrame) -> DataFrame:
    """Vectors by collection: what the service reports about itself."""
    return collections.groupBy("collection").agg(F.count("*").alias("n"))


def list_papers(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct papers in order; with a limit, of the first rows by id (a limit without an order has no defined result)."""
    rows = chunks.orderBy("chunk_id").limit(limit) if limit else chunks
    return rows.select("file_path", "title").distinct().orderBy("file_path")


def get_messages(turns: DataFrame, owners: DataFrame, chat, user, limit: int = 50) -> DataFrame:
    """A chat's messages for its owner; no rows for anyone else."""
    mine = owners.where((F.col("chat") == F.lit(chat)) & (F.col("owner") == F.lit(user)))
    return chats.messages(turns.join(mine.select("chat"), "chat", "left_semi"), "chat", "at", limit)


def anonymous(header: Column) -> Column:
    """Whether a header's text says the user is anonymous; missing is no."""
    return F.coalesce(F.lower(header) == "true", F.lit(False))


QUERIES, ORACLES = {}, {}


def answers(spark, sf):
    """The whole funnel for the query table, at two temperatures. Its generator is a Python function: no SQL form."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return answer(q, table(spark, sf, "documents").select("doc_id", "text"), temperatures=(0.0, 1.0))


def embedded(spark, sf):
    """The Arrow embedder over all documents: length and norm of each vector."""
    v = table(spark, sf, "documents").select("doc_id", models.embed(F.col("text")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return v.select("doc_id", F.size("v").alias("dim"), F.round(norm, 4).alias("norm"))


def summaries(spark, sf):
    """Map-reduce summaries with a budget of 1000 estimated tokens."""
    return models.summarise(table(spark, sf, "documents"), "doc_id", "text", budget=1000, size=500, overlap=50)


QUERIES |= {f.__name__: f for f in (answers, embedded, summaries)}
