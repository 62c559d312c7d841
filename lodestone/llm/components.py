"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges(u, v) with u > v. Large star: each vertex hands its larger neighbours to its smallest; small star: its smaller ones and itself."""
    if small:
        seen = edges
    else:
        seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # The minima are cut off first: the join then has an exchange on either side, so AQE can split a vertex with very many neighbours.
    low = cut(seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    near = seen.join(low, "u")
    if small:
        moved = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = low.select("u", F.col("m").alias("v"))
        out = moved.unionByName(own)
    else:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return cut(out.where("u <> v").distinct())


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs -> (node, label): label is the smallest node reachable. Nodes without an edge are not listed."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == (sign.n, sign.s) or sign.n == 0:
            break
        before = (sign.n, sign.s)
        now = _star(_star(now, small=False), small=True)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
