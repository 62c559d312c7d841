"""Nearest neighbours within groups that each query names for itself: chunks of its own papers, vectors of its own labels.

A query meets a row only through a group that it allows, by an equality join.
Rows and queries of a group travel as packs, so each joined pair of packs is
one matrix product; a group with very many rows, or one that very many queries
allow, has more packs, and none is larger than its bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROW_PACK, QUERY_PACK = 4096, 1024


def packs(rows: DataFrame, id: str, size: int, name: str) -> DataFrame:
    """rows(group, <id>, v) -> (group, <name>): arrays of (id, v), of about ``size`` at most. The parts of a group follow from its count."""
    parts = rows.groupBy("group").agg(F.ceil(F.count("*") / size).alias("parts"))
    dealt = rows.join(parts, "group").select("group", F.pmod(F.xxhash64(id), "parts").alias("part"), F.struct(F.col(id).alias("id"), "v").alias("x"))
    return dealt.groupBy("group", "part").agg(F.collect_list("x").alias(name)).select("group", name)


def _plain(x):
    return tuple(x.values()) if isinstance(x, dict) else x


def _matrix(v: pa.Array) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)


def _nearest(k: int):
    """Of each pair of packs: each query's k nearest rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, held = batch.column("queries"), batch.column("rows")
            for i in range(batch.num_rows):
                q, r = asked[i].values, held[i].values
                a, b, ids = _matrix(q.field("v")), _matrix(r.field("v")), [_plain(x) for x in r.field("id").to_pylist()]
                b2, m = (b * b).sum(axis=1), min(k, len(b)) - 1
                who, what, far = [], [], []
                for j, x in enumerate(a):
                    # One product finds who may be near; those distances are then taken exactly.
                    rough = b2 - 2 * (b @ x)
                    near = np.flatnonzero(rough <= np.partition(rough, m)[m] + 2e-6 + 1e-12 * (b2.max() + x @ x))
                    d = np.round(((b[near] - x) ** 2).sum(axis=1), 6)
                    for y, _, n in sorted((y, ids[n], n) for y, n in zip(d.tolist(), near.tolist()))[:k]:
                        who.append(j)
                        what.append(n)
                        far.append(y)
                yield pa.RecordBatch.from_arrays([q.field("id").take(pa.array(who, pa.int64())), r.field("id").take(pa.array(what, pa.int64())), pa.array(far, pa.float64())], names=["query_id", "id", "distance"])

    return run


def search(queries: DataFrame, rows: DataFrame, allowed: DataFrame, k: int, row_pack: int = ROW_PACK, query_pack: int = QUERY_PACK) -> DataFrame:
    """queries(query_id, v), rows(group, id, v), allowed(query_id, group) -> (query_id, rank, id, distance): the k nearest by squared L2 among the rows of the groups a query allows; ties go to the smaller id.

    A query that allows no group, or only groups without rows, has no result. A
    row in several groups of one query counts once for each; one without a vector not at all. Ids may be of any
    type that can be ordered, structs included.
    """
    pairs = allowed.select("query_id", "group").distinct()
    asked = pairs.join(queries.where("v is not null").select("query_id", "v"), "query_id")
    wanted = rows.where("v is not null").select("group", "id", "v").join(pairs.select("group").distinct(), "group", "left_semi")
    met = packs(asked, "query_id", query_pack, "queries").join(packs(wanted, "id", row_pack, "rows"), "group").select("queries", "rows")
    kinds = dict(queries.dtypes)["query_id"], dict(rows.dtypes)["id"]
    found = met.mapInArrow(_nearest(k), f"query_id {kinds[0]}, id {kinds[1]}, distance double")
    order = W.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
