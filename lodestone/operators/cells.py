"""Approximate dense search by cells: rows lie in the cell of their nearest centroid, a query looks into its nearest cells only.

The centroids are fitted on a bounded sample (a parameter), every row is
indexed. A search is an equality join on the cell, so its work grows with the
cells looked into and not with all rows; crowded cells are dealt in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .dense import QUERY_BLOCK, ROW_BLOCK, block_search


def fit(rows: DataFrame, cells: int, sample: int = 20_000, rounds: int = 10) -> np.ndarray:
    """rows(id, v) -> centroids (at most ``cells``, fewer if there are fewer rows), by Lloyd's rounds over the ``sample`` rows whose ids hash smallest."""
    held = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    if not held.num_rows:
        return np.zeros((0, 0))
    v = held.column("v").combine_chunks()
    return lloyd(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1), cells, rounds)


def lloyd(x: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    """At most n centres of the rows of x, from the first rows on."""
    at = x[:n].copy()
    for _ in range(rounds if len(at) else 0):
        own = nearest(x, at, 1)[:, 0]
        held = np.bincount(own, minlength=len(at))
        total = np.zeros_like(at)
        np.add.at(total, own, x)
        at[held > 0] = total[held > 0] / held[held > 0, None]
    return at


def nearest(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Each row's n nearest centroids, in no order."""
    d = (centroids * centroids).sum(axis=1)[None, :] - 2 * x @ centroids.T
    n = min(n, len(centroids))
    return np.argpartition(d, n - 1, axis=1)[:, :n]


def assigned(rows: DataFrame, centroids: np.ndarray, n: int = 1) -> DataFrame:
    """rows(key, v) -> (key, v, cell): a row for each of the n nearest cells. The centroids, bounded by their number, travel with the tasks."""
    key = rows.columns[0]
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not len(centroids):
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            at = nearest(x, centroids, n)
            rows_ = pa.array(np.repeat(np.arange(b.num_rows), at.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows_), b.column(1).take(rows_), pa.array(at.reshape(-1).astype(np.int32))], names=[key, "v", "cell"])

    return rows.select(key, "v").mapInArrow(run, f"`{key}` {kind}, v array<double>, cell int")


def search(queries: DataFrame, index: DataFrame, centroids: np.ndarray, k: int, probe: int, distinct_from_self: bool = False, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """queries(query_id, v), index(id, v, cell) -> (query_id, rank, id, distance): the k nearest of the ``probe`` cells nearest to each query, by squared L2, ties to the smaller id. All cells make it exact."""
    asked = assigned(queries.select("query_id", "v"), centroids, probe)
    sizes = index.groupBy("cell").agg(F.ceil(F.count("*") / row_block).cast("int").alias("rs"))
    crowds = asked.groupBy("cell").agg(F.ceil(F.count("*") / query_block).cast("int").alias("qs"))
    shape = sizes.join(crowds, "cell")
    left = asked.join(shape, "cell").select("query_id", "v", "cell", F.pmod(F.xxhash64("query_id"), "qs").cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.col("rs") - 1)).alias("r"))
    right = index.join(shape, "cell").select("id", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), F.pmod(F.xxhash64("id"), "rs").cast("int").alias("r"))
    best, schema = block_search(queries, index, k, distinct_from_self)
    found = left.groupBy("cell", "q", "r").cogroup(right.groupBy("cell", "q", "r")).applyInArrow(best, schema)
    order = W.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
