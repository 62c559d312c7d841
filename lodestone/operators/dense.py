"""Exact dense search in blocks, collections, and hashed feature vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from .bm25 import term_counts

ROW_BLOCK, QUERY_BLOCK = 1 << 16, 1 << 12


def _matrix(t: pa.Table) -> np.ndarray:
    return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)


def block_search(queries: DataFrame, rows: DataFrame, k: int, distinct_from_self: bool = False):
    """What one task does with a block of queries (query_id, v) and one of rows (id, v), and the schema of what it gives: each query's k nearest of the block."""
    qkind, rkind = dict(queries.dtypes)["query_id"], dict(rows.dtypes)["id"]

    def best(q: pa.Table, r: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if q.num_rows and r.num_rows:
            a, b = _matrix(q), _matrix(r)
            ids, qids = r.column("id").to_pylist(), q.column("query_id").to_pylist()
            b2, m = (b * b).sum(axis=1), min(k, len(b) - 1)
            for lo in range(0, len(a), 64):
                part = a[lo : lo + 64]
                p2 = (part * part).sum(axis=1)
                # One product finds who may be near; their distances are then taken exactly.
                rough = b2[None, :] + p2[:, None] - 2 * (part @ b.T)
                slack = 2e-6 + 1e-12 * (b2.max() + p2)
                for i, x in enumerate(part):
                    near = np.flatnonzero(rough[i] <= np.partition(rough[i], m)[m] + slack[i])
                    d = np.round(((b[near] - x) ** 2).sum(axis=1), 6)
                    own = qids[lo + i]
                    top = sorted((y, ids[j]) for y, j in zip(d.tolist(), near.tolist()) if not (distinct_from_self and ids[j] == own))[:k]
                    out[0].extend([own] * len(top))
                    out[1].extend(y for _, y in top)
                    out[2].extend(y for y, _ in top)
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
        return pa.table({"query_id": pa.array(out[0], kinds[qkind]), "id": pa.array(out[1], kinds[rkind]), "distance": pa.array(out[2], pa.float64())})

    return best, f"query_id {qkind}, id {rkind}, distance double"


def knn(queries: DataFrame, rows: DataFrame, k: int, distinct_from_self: bool = False, limit: int = 100, sizes: tuple[int, int] | None = None) -> DataFrame:
    """queries(query_id, v), rows(id, v) -> (query_id, rank, id, distance): the k nearest by squared L2, ties to the smaller id; k is at most ``limit``.

    Every pair of a query block and a row block is one task that compares them
    by matrix products and hands on k rows a query. ``sizes``: bounds of the numbers of
    queries and rows, where they are known more cheaply than by counting.
    """
    k = min(k, limit)
    n_queries, n_rows = sizes or (queries.count(), rows.count())
    nr, nq = max(1, -(-n_rows // ROW_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    part = lambda id, n: F.pmod(F.xxhash64(id), F.lit(n)).cast("int")
    qb, rb = part("query_id", nq) * nr, part("id", nr)
    left = queries.select("query_id", "v", F.explode(F.sequence(qb, qb + (nr - 1))).alias("block"))
    right = rows.select("id", "v", F.explode(F.sequence(rb, rb + nr * (nq - 1), F.lit(nr))).alias("block"))
    best, schema = block_search(queries, rows, k, distinct_from_self)
    # Dealt by number and not by hash, so no task gathers and sorts several pairs of blocks.
    left, right = (side.repartitionById(nr * nq, F.col("block")) for side in (left, right))
    found = left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(best, schema)
    order = W.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def knn_in_collections(queries: DataFrame, rows: DataFrame, k: int, collections: tuple[int, ...] = (1, 2), **how) -> DataFrame:
    """queries(query_id, query, v, collection), rows(id, v, collection) -> (query_id, collection, rank, id, distance): each query in the collection it names. Blank queries give no row; one that names another collection raises."""
    other = queries.where(~F.col("collection").isin(*collections) | F.col("collection").isNull())
    if not other.isEmpty():
        raise ValueError(f"a query's collection is one of {collections}")
    asked = queries.where(F.length(F.trim("query")) > 0)
    out = None
    for c in collections:
        here = F.col("collection") == c
        found = knn(asked.where(here).select("query_id", "v"), rows.where(here).select("id", "v"), k, **how).withColumn("collection", F.lit(c))
        out = found if out is None else out.unionByName(found)
    return out.select("query_id", "collection", "rank", "id", "distance")


def within(rows: DataFrame, column: str, values) -> DataFrame:
    """Rows whose column is among the values; an empty or missing set filters nothing."""
    return rows.where(F.col(column).isin(list(values))) if values else rows


def overfetch(hits: DataFrame, allowed: Column, k: int) -> DataFrame:
    """Filter after a search of ten times k, then cut to k: may return fewer."""
    order = W.partitionBy("query_id").orderBy("rank")
    return hits.where(F.col("rank") <= 10 * k).where(allowed).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def collection_stats(rows: DataFrame, by: str, vec: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.max(F.size(vec)).cast("long").alias("dim"))


def hashed_vectors(docs: DataFrame, text: str = "text", id_col: str = "doc_id", dim: int = 64, counts: DataFrame | None = None) -> DataFrame:
    """(id, v): a deterministic stand-in for an embedding model: terms hashed to signed dimensions by their MD5, unit length. Terms meet by document once, each dimension being a sum of its own. ``counts``: the documents' term counts, where they are at hand."""
    digits = F.lit("0123456789abcdef")
    digit = lambda i: F.position(F.substring("h", i, 1), digits).cast("long") - 1  # noqa: E731  the i-th hexadecimal digit
    at = ((digit(1) * 16 + digit(2)) * 16 + digit(3)) * 16 + digit(4)
    signed = F.when(digit(5) % 2 == 0, F.col("tf")).otherwise(-F.col("tf")).cast("double")
    terms = (term_counts(docs, text, id_col) if counts is None else counts).select(F.col("doc_id").alias("id"), "tf", F.md5(F.col("term").cast("binary")).alias("h"))
    cells = terms.select("id", (at % dim).alias("at"), signed.alias("x"))
    by_doc = cells.groupBy("id").agg(*[F.sum(F.when(F.col("at") == i, F.col("x")).otherwise(0.0)).alias(f"x{i}") for i in range(dim)])
    return by_doc.select("id", V.normalised(F.array(*[f"x{i}" for i in range(dim)])).alias("v"))
