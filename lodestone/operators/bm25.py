"""Okapi BM25 as DataFrames: postings, statistics and a batch search.

All queries are answered by one plan. Query terms meet postings on the term; at
most some hundred thousand are broadcast, more are dealt by the term.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


#: Documents whose words one task counts, and (query, document) pairs whose scores one task sums.
DOC_BLOCK, PAIR_BLOCK = 1 << 12, 1 << 20
#: Rows (query, term) that are few enough to be sent to all tasks: about ten MB.
FEW_TERMS = 1 << 18


@dataclass(frozen=True)
class Index:
    """postings(term, doc_id, tf), docs(doc_id, dl), terms(term, df, idf), corpus(n, avgdl). ``size``: the number of documents, where it is known.
    ``over``: makes the same index over its postings, and over their counts by term, out of tables."""

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    corpus: DataFrame
    size: int | None = None
    over: Callable[..., Index] | None = None

    def write(self, path: str) -> None:
        """The postings are written first and all else is made of them as they lie there, their counts by term once (``counts``), so nothing is kept in memory."""
        spark = self.postings.sparkSession

        def put(rows: DataFrame, name: str) -> DataFrame:
            rows.write.mode("overwrite").parquet(f"{path}/{name}")
            return spark.read.schema(rows.schema).parquet(f"{path}/{name}")

        held, postings = self, put(self.postings, "postings")
        if self.over is not None:
            held = self.over(postings, put(term_totals(postings), "counts"))
        for name in ("docs", "terms", "corpus"):
            put(getattr(held, name), name)

    @classmethod
    def read(cls, spark, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "docs", "terms", "corpus")))


@contextmanager
def kept(rows: DataFrame):
    """Keep what several plans read (memory, then disk) while they run, unless it is kept already."""
    held = rows.storageLevel
    mine = not (held.useMemory or held.useDisk)
    if mine:
        rows.persist()
    try:
        yield rows
    finally:
        if mine:
            rows.unpersist()


def dealt(rows: DataFrame, n: int, block: int, *key: str) -> DataFrame:
    """Rows dealt by a key to so many tasks that each holds about ``block`` of n, however many there are; at least to all cores."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // block)), *key)


def cell(doc_id: str, n: int) -> Column:
    return F.pmod(F.hash(doc_id), F.lit(n)).alias("cell")


def placed() -> Column:
    """A document's place, from 0, by its length in its cell."""
    return (F.row_number().over(W.partitionBy("cell").orderBy("dl", "doc_id")) - 1).cast("long")


def term_counts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", markdown: bool = False, size: int | None = None, cells: tuple[int, int] | None = None) -> DataFrame:
    """(term, doc_id, tf). Everything else is derived from this table with its counts. Texts are dealt by document before their words are counted, so
    a task counts those of some thousand documents, whatever the input, and hands on no row a word. ``size``: the number of documents, if it is known.
    ``cells``: so many tasks and cells, by which the texts are dealt instead; each row then has its cell, its document's length dl and its place by length in the cell."""
    body = T.clean_markdown(F.col("text")) if markdown else F.col("text")
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    if cells is None:
        held, key, words = dealt(held, docs.count() if size is None else size, DOC_BLOCK, "doc_id"), [], T.tokens(body)
    else:
        held, key, words = held.withColumn("cell", cell("doc_id", cells[1])).repartition(cells[0], "cell"), ["cell", "dl", "place"], F.col("words")
        held = held.select("cell", "doc_id", T.tokens(body).alias("words")).withColumn("dl", F.size("words").cast("long")).withColumn("place", placed())
    return held.select(*key, "doc_id", F.explode(words).alias("term")).groupBy(*key, "term", "doc_id").agg(F.count("*").alias("tf"))


def term_totals(postings: DataFrame) -> DataFrame:
    """(term, df, cf): documents that hold a term, and how often they do."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def build(docs: DataFrame, text: str = "text", id_col: str = "doc_id", markdown: bool = True, eps: float = 0.25, counts: DataFrame | None = None) -> Index:
    """Each part that is read apart tokenises anew, unless the postings are kept (``kept``) or ``counts`` are the documents' term counts out of a table."""
    size = docs.count()

    def over(postings: DataFrame, df: DataFrame) -> Index:
        per_doc = postings.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
        lengths = docs.select(F.col(id_col).alias("doc_id")).join(per_doc, "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0)).alias("dl"))
        n = docs.agg(F.count("*")).scalar()
        corpus = df.agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("cf")).select(n.alias("n"), (F.col("cf") / F.nullif(n, F.lit(0))).alias("avgdl"))
        return Index(postings, lengths, weighted(df, n, eps), corpus, size, over)

    postings = term_counts(docs, text, id_col, markdown, size) if counts is None else counts
    return over(postings, term_totals(postings))


def weighted(df: DataFrame, n: Column, eps: float = 0.25) -> DataFrame:
    """(term, df) of n documents -> (term, df, idf); a term in more than half of them gets a share of the mean instead of a negative weight."""
    raw = df.withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean")).scalar()
    return raw.select("term", "df", F.when(F.col("raw") < 0, eps * mean).otherwise(F.col("raw")).alias("idf"))


def query_terms(queries: DataFrame, text: str = "text", id_col: str = "query_id", max_chars: int = 1000, max_tokens: int = 100) -> DataFrame:
    """(query_id, term, qtf): the guards cut a query to its first characters and tokens; a blank query has no terms. Queries are not cleaned of markdown."""
    toks = F.slice(T.tokens(F.substring(F.trim(text), 1, max_chars)), 1, max_tokens)
    return queries.select(F.col(id_col).alias("query_id"), F.explode(toks).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def weight(idf: Column, tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def search(index: Index, terms: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best of the documents that hold a query term; ties go to the smaller id. Scores are rounded to six places before ranking."""
    avgdl = index.corpus.select("avgdl").scalar()
    asked = terms.select("term").distinct()
    size = index.docs.count() if index.size is None else index.size
    n = terms.agg(F.count("*").alias("rows"), F.countDistinct("query_id").alias("queries")).first()
    few = n.rows <= FEW_TERMS
    # A posting's weight is made once, only for terms that some query holds. A task sums the scores of its own documents, so of a bounded number of pairs:
    # some query terms are met where the postings and the documents lie, so no task holds a frequent term's postings; many meet them by term, and their
    # pairs are dealt anew.
    known = index.terms.join(F.broadcast(asked) if few else asked, "term", "left_semi").select("term", "idf")
    held = index.postings.join(F.broadcast(known), "term") if few else index.postings.join(asked, "term", "left_semi").join(known, "term")
    # A task's documents, at most PAIR_BLOCK, are a hash table that its postings pass by, so these are not sorted.
    lengths = dealt(index.docs, size * n.queries, PAIR_BLOCK, "doc_id").hint("shuffle_hash")
    held = dealt(held, size * n.queries, PAIR_BLOCK, "doc_id").join(lengths, "doc_id")
    w = weight(F.col("idf"), F.col("tf"), F.col("dl"), avgdl, k1, b)
    hits = held.select("term", "doc_id", w.alias("w")).join(F.broadcast(terms) if few else terms, "term")
    hits = hits if few else dealt(hits, size * n.queries, PAIR_BLOCK, "query_id", "doc_id")
    scored = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qtf") * F.col("w")), 6).alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
