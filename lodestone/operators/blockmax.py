"""Top-k lexical search that leaves most postings unscored: blocks of postings with bounds for their weights.

Documents are dealt into cells; within a cell those of like length lie in blocks
of ``width``. Of the postings of a term in a block, the largest count and the
least length of a document are one row, which bounds their weights; the sum of a
query's bounds in a block holds for all its documents. A search

1. sums the bounds of each (query, block), reading no postings;
2. scores the few blocks with the highest bounds, whose k-th best score is a
   threshold for the query;
3. scores the other blocks whose bound reaches the threshold, and no more.

The result is that of ``bm25.search``: a document left out cannot be among the
k best. How much is left out depends on the queries: of many frequent terms,
wide blocks bound little, and short queries with a rare term leave out nearly all.

Both tables are bucketed by cell, so that a cell's sums, its blocks that
reach a threshold and its documents' scores are made where it is read: only
each task's best rows of a query are shuffled, and no (query, block) is written.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bm25
from ..sources.corpus import stored

#: Scores are rounded to six places before ranking.
SLACK = 2e-6
#: Documents of a cell. Cells are dealt by hash, so a task has half of bm25.DOC_BLOCK in the mean and seldom more than all.
CELL = 1 << 9


def cells(spark: SparkSession, size: int) -> tuple[int, int]:
    """Of so many documents: the number of tasks, which is that of buckets, and of cells."""
    n = max(1, -(-size // CELL))
    return max(min(n, spark.sparkContext.defaultParallelism), -(-2 * size // bm25.DOC_BLOCK)), n


@contextmanager
def met_by_cell(spark: SparkSession):
    """Joins that are planned inside meet where their rows lie by a part of the key."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _bucketed(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """A table that was written in buckets of cells, whose rows are then known to be dealt by cell. Only its name is dropped, here and in ``_put``."""
    name = f"cells_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (cell) INTO {buckets} BUCKETS LOCATION '{path}'")
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def _put(rows: DataFrame, path: str, buckets: int) -> DataFrame:
    name = f"cells_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, "cell").sortBy("block").option("path", path).format("parquet").saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")
    return _bucketed(rows.sparkSession, path, buckets)


@dataclass(frozen=True)
class BlockIndex:
    """blocks(cell, block, term, most, least, n, cf): of the n postings of a term in a block the largest tf, the smallest dl and the sum of tf. postings(cell, block, term, doc_id, tf, dl).
    terms(term, df, idf)."""

    blocks: DataFrame
    postings: DataFrame
    terms: DataFrame
    avgdl: float | None
    width: int
    k1: float = 1.5
    b: float = 0.75

    @classmethod
    def build(cls, index: bm25.Index, path: str, width: int = 64, k1: float = 1.5, b: float = 0.75) -> BlockIndex:
        """Store the postings by cell and block; all else is made of these. Postings that come dealt by cell (``bm25.term_counts``) stay where they are."""
        spark, rows = index.postings.sparkSession, index.postings
        size = index.docs.count() if index.size is None else index.size
        n_tasks, n_cells = cells(spark, size)
        if "cell" not in rows.columns:
            own = rows.groupBy("doc_id").agg(F.sum("tf").alias("dl"), F.collect_list(F.struct("term", "tf")).alias("held"))
            own = own.withColumn("cell", bm25.cell("doc_id", n_cells)).repartition(n_tasks, "cell").withColumn("place", bm25.placed())
            rows = own.select("cell", "dl", "place", "doc_id", F.inline("held"))
        block = F.shiftleft(F.col("cell").cast("long"), 32) + F.floor(F.col("place") / width)
        postings = _put(rows.select("cell", block.alias("block"), "term", "doc_id", "tf", "dl"), f"{path}/postings", n_tasks)
        most = (F.max("tf").alias("most"), F.min("dl").alias("least"), F.count("*").alias("n"), F.sum("tf").alias("cf"))
        blocks = _put(postings.groupBy("cell", "block", "term").agg(*most), f"{path}/blocks", n_tasks)
        held = index
        if index.over is not None:
            held = index.over(postings.select("term", "doc_id", "tf"), stored(blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"))))
        held.terms.write.parquet(f"{path}/terms")
        held.corpus.select("avgdl", F.lit(n_tasks).alias("buckets"), F.lit(width).alias("width"), F.lit(k1).alias("k1"), F.lit(b).alias("b")).write.parquet(f"{path}/about")
        return cls.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> BlockIndex:
        about = spark.read.parquet(f"{path}/about").first()
        blocks, postings = (_bucketed(spark, f"{path}/{x}", about.buckets) for x in ("blocks", "postings"))
        return cls(blocks, postings, spark.read.parquet(f"{path}/terms"), about.avgdl, about.width, about.k1, about.b)

    def _weight(self, tf: str, dl: str) -> Column:
        return bm25.weight(F.col("idf"), F.col(tf), F.col(dl), F.lit(self.avgdl), self.k1, self.b)

    def asked(self, terms: DataFrame) -> DataFrame:
        """(query_id, term, qtf, df, idf) of the terms that are held, written once; few are sent to all tasks."""
        n = terms.count()
        words = terms.select("term").distinct()
        known = self.terms.join(F.broadcast(words) if n <= bm25.FEW_TERMS else words, "term", "left_semi")
        held = stored(terms.join(known, "term").select("query_id", "term", "qtf", "df", "idf"))
        return F.broadcast(held) if n <= bm25.FEW_TERMS else held

    def bounds(self, asked: DataFrame) -> DataFrame:
        """(cell, block, query_id, bound, n): n postings lie there for the query."""
        # A bound holds for documents without the term too, hence never below zero.
        met = self.blocks.select("cell", "block", "term", "most", "least", "n").join(asked, "term")
        most = F.greatest(F.col("qtf") * self._weight("most", "least"), F.lit(0.0))
        return met.groupBy("cell", "block", "query_id").agg(F.sum(most).alias("bound"), F.sum("n").alias("n"))

    def scores(self, asked: DataFrame, chosen: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of the documents in the chosen (cell, block, queries): the queries of a block are an array."""
        met = self.postings.join(chosen, ["cell", "block"]).join(asked, "term").where(F.array_contains("queries", F.col("query_id")))
        scored = met.groupBy("cell", "query_id", "doc_id").agg(F.round(F.sum(F.col("qtf") * self._weight("tf", "dl")), 6).alias("score"))
        return scored.select("query_id", "doc_id", "score")

    def begun(self, terms: DataFrame, k: int = 10, first: int | None = None) -> Search:
        """Steps 1 and 2. ``first``: blocks of step 2, by default for three times k documents."""
        first = first or max(1, -(-3 * k // self.width))
        asked = self.asked(terms)
        best = W.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        high = stored(self.bounds(asked).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= first).select("cell", "block", "query_id", "n"))
        few = high.count() <= bm25.FEW_TERMS
        send = F.broadcast if few else (lambda rows: rows)
        early = stored(self.scores(asked, send(high.groupBy("cell", "block").agg(F.collect_list("query_id").alias("queries")))))
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        least = stored(early.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == k).select("query_id", F.col("score").alias("least_score")))
        rest = self.bounds(asked).join(send(high.select("block", "query_id")), ["block", "query_id"], "left_anti").join(send(least), "query_id", "left")
        open_ = rest.where(F.col("least_score").isNull() | (F.col("bound") >= F.col("least_score") - SLACK)).select("cell", "block", "query_id", "n")
        return Search(self, asked, k, high, early, open_)

    def search(self, terms: DataFrame, k: int = 10, first: int | None = None) -> tuple[DataFrame, DataFrame]:
        """The ``best`` and the ``share`` of a search."""
        begun = self.begun(terms, k, first)
        return begun.best(), begun.share()


@dataclass(frozen=True)
class Search:
    """A search before its third step: high(cell, block, query_id, n) and their early(query_id, doc_id, score), and what else is open_(cell, block, query_id, n)."""

    index: BlockIndex
    asked: DataFrame
    k: int
    high: DataFrame
    early: DataFrame
    open_: DataFrame

    def rest(self) -> DataFrame:
        """(query_id, doc_id, score) of the open blocks, which are few in a task and looked up; its postings pass by unsorted. Plan it ``met_by_cell``."""
        return self.index.scores(self.asked, self.open_.groupBy("cell", "block").agg(F.collect_list("query_id").alias("queries")).hint("shuffle_hash"))

    def best(self) -> DataFrame:
        """(query_id, rank, doc_id, score): the k best of each query."""
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        ranked = self.early.unionByName(self.rest()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k)
        with met_by_cell(ranked.sparkSession):
            return stored(ranked.select("query_id", "rank", "doc_id", "score"))

    def share(self) -> DataFrame:
        """(query_id, n_postings, n_scored): how many of a query's postings are scored."""
        scored = self.high.select("query_id", "n").unionByName(self.open_.select("query_id", "n")).groupBy("query_id").agg(F.sum("n").alias("n_scored"))
        return self.asked.groupBy("query_id").agg(F.sum("df").alias("n_postings")).join(scored, "query_id")
