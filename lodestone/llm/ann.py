"""Approximate nearest neighbours by largest inner product: a hash-prefix forest.

Every tree hashes a vector to a string of 64 signs of random projections. A
tree is its block's strings in sorted order, so rows with a common prefix are
neighbours. A query descends each tree to its longest-prefix match, then all
trees ascend together; the rows under the current prefixes are compared
exactly, in double precision, on the original vectors. Two strings agree in
one sign with a chance of 1 - angle / pi, so the ascent can end by itself: it
goes on until a row as near as the last of the k best so far would be under a
common prefix in some tree with a chance of ``target``. On clustered data
that is soon, on isotropic data late, and the rule is the same for blocks of
every size.

Inner products become angles by one more coordinate: rows get
sqrt(M^2 - |x|^2) for the largest norm M, queries get 0, so the order of
angles is the order of products.

Rows are dealt into index blocks and the query set into query blocks of fixed
sizes, and each pair of blocks is one task: memory is bounded by the two block
sizes, and the answers do not depend on the cluster. Equal vectors are one
index entry that carries its k + 1 smallest ids, which is all that can enter a
result of k.

Cases: vectors that are null, zero, of another length than the commonest, or
with null or non-finite components take no part. Ties go to the smaller id. A
query with fewer than k candidates gets all. Rows of one id count once, with
the smallest of their usable vectors; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

DEPTH = 64
INDEX_BLOCK, QUERY_BLOCK = 1 << 14, 1 << 14
#: Trees, and the chance with which a row as near as the k-th best is met.
TREES, TARGET = 48, 0.8


class Forest:
    """Sorted arrays of 64-bit hash strings of the rows of x, one for each tree."""

    def __init__(self, x: np.ndarray, trees: int, seed: int):
        rng = np.random.default_rng(seed)
        self.planes = rng.standard_normal((trees, x.shape[1], DEPTH)).astype(np.float32)
        self.order, self.keys = [], []
        for t in range(trees):
            k = self.hash(x, t)
            o = np.argsort(k, kind="stable")
            self.order.append(o)
            self.keys.append(k[o])

    def hash(self, x: np.ndarray, t: int) -> np.ndarray:
        signs = (x.astype(np.float32) @ self.planes[t]) > 0
        return np.packbits(signs, axis=1).view(">u8").reshape(-1).astype(np.uint64)

    def ranges(self, keys: list[np.ndarray], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query where the rows with the query's first ``bits`` signs begin and end."""
        free = np.where(bits >= DEPTH, np.uint64(0), (np.uint64(2**64 - 1) >> np.minimum(bits, DEPTH - 1).astype(np.uint64)))
        lo = np.stack([np.searchsorted(s, k & ~free, "left") for s, k in zip(self.keys, keys)])
        hi = np.stack([np.searchsorted(s, k | free, "right") for s, k in zip(self.keys, keys)])
        return lo, hi

    def descend(self, keys: list[np.ndarray], least: int) -> np.ndarray:
        """For each query the longest prefix that holds ``least`` entries over all trees. The count only falls as it grows, so halving finds it."""
        low, high = np.zeros(len(keys[0]), np.int64), np.full(len(keys[0]), DEPTH, np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            lo, hi = self.ranges(keys, mid)
            enough = (hi - lo).sum(axis=0) >= least
            low, high = np.where(enough, mid, low), np.where(enough, high, mid - 1)
        return low

    def rows(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The rows in one range of each tree."""
        met = np.zeros(len(self.order[0]), bool)
        for o, a, b in zip(self.order, lo.tolist(), hi.tolist()):
            met[o[a:b]] = True
        return np.flatnonzero(met)


def longest(cos: float, trees: int, target: float) -> int:
    """The longest common prefix that a row at this cosine has in some tree with the chance ``target``."""
    same = 1 - np.arccos(min(1.0, max(-1.0, cos))) / np.pi
    if same >= 1:
        return DEPTH
    return min(DEPTH, int(np.log(1 - (1 - target) ** (1 / trees)) / np.log(max(same, 1e-9))))


def nearest(x: np.ndarray, q: np.ndarray, near: int, trees: int = TREES, target: float = TARGET, seed: int = 7):
    """For each query (its place, rows compared, their products with it). ``near``: the ascent aims at so many of the nearest rows."""
    norm2 = (x * x).sum(axis=1)
    most = float(np.sqrt(norm2.max()))
    forest = Forest(np.column_stack([x, np.sqrt(np.maximum(0, most * most - norm2))]), trees, seed)
    near = min(near, len(x))
    for first in range(0, len(q), 1024):
        part = q[first : first + 1024]
        lifted = np.column_stack([part, np.zeros(len(part))])
        keys = [forest.hash(lifted, t) for t in range(trees)]
        scale = most * np.sqrt((part * part).sum(axis=1))
        bits = forest.descend(keys, 4 * near)
        todo = np.arange(len(part))
        while len(todo):
            lo, hi = forest.ranges([k[todo] for k in keys], bits[todo])
            again = []
            for at, i in enumerate(todo.tolist()):
                rows = forest.rows(lo[:, at], hi[:, at])
                product = x[rows] @ part[i] if 4 * len(rows) < len(x) else (x @ part[i])[rows]
                if bits[i] and len(rows) < len(x):
                    found = len(rows) >= near
                    need = longest(np.partition(product, len(product) - near)[len(product) - near] / scale[i], trees, target) if found else bits[i] - 1
                    if need < bits[i]:
                        bits[i] = max(0, need)
                        again.append(i)
                        continue
                yield first + i, rows, product
            todo = np.array(again, np.int64)


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    v = t.column(name).combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def _search(index: pa.Table, queries: pa.Table, k: int, near: int, trees: int, target: float, seed: int) -> pa.Table:
    names = ["query_id", "vec_id", "score"]
    if not index.num_rows or not queries.num_rows:
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    x, q = _matrix(index, "v"), _matrix(queries, "v")
    ids = index.column("ids").to_pylist()
    qids = queries.column("query_id").to_pylist()
    out: tuple[list, list, list] = ([], [], [])
    for i, rows, score in nearest(x, q, near, trees, target, seed):
        if len(rows) > k + 1:  # all ties with the last stay in
            last = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
            rows, score = rows[score >= last], score[score >= last]
        own = qids[i]
        best = sorted((-s, v) for n, s in zip(rows.tolist(), score.tolist()) for v in ids[n] if v != own)[:k]
        out[0].extend([own] * len(best))
        out[1].extend(v for _, v in best)
        out[2].extend(-s for s, _ in best)
    return pa.table(dict(zip(names, (pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())))))


def usable(rows: DataFrame, vec: str) -> DataFrame:
    """Rows (vec_id, v array<double>) that take part."""
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    held = rows.where(F.col("vec_id").isNotNull()).select("vec_id", v.alias("v")).where(F.coalesce(fine, F.lit(False)))
    size = held.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return held.where(F.size("v") == (size["n"] if size else 0))


def search(
    rows: DataFrame, is_query, vec: str = "embedding", k: int = 20, trees: int = TREES, target: float = TARGET, seed: int = 7, index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """rows(vec_id, vec) -> (query_id, rank, vec_id, score): each query's k nearest found among all other rows.

    Rows are dealt by a hash, so a block holds about its share of a query's k
    nearest; its ascent aims at that share and two deviations more.
    """
    # The smallest vector of an id; a plain aggregate, so rows of one id meet after a partial one.
    held = written(usable(rows.select("vec_id", vec), vec).groupBy("vec_id").agg(F.min("v").alias("v")))
    classes = held.groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    # The k + 1 smallest ids of each vector; only vectors that occur more than once pass through the ranking.
    many = held.join(classes.where("n > 1").select("v"), "v")
    top = many.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    index = classes.where("n = 1").select("v", F.array("low").alias("ids")).unionByName(top.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    index = written(index)
    queries = held.where(is_query).select(F.col("vec_id").alias("query_id"), "v")
    n, m = index.count(), queries.count()
    nb, mb = max(1, -(-n // index_block)), max(1, -(-m // query_block))
    near = min(k, int(np.ceil(k / nb + 2 * np.sqrt(k / nb) + 1)))
    left = index.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(nb))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(mb - 1))))
    right = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(mb)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nb - 1).cast("long"))))
    run = lambda a, b: _search(a, b, k, near, trees, target, seed)
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, "query_id long, vec_id long, score double")
    # At most nb * k rows a query meet here.
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest(spark, sf_dir):
    """query_id, rank, vec_id, score: the 20 nearest found for every vec_id divisible by 20, against all rows."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, F.col("vec_id") % 20 == 0)
