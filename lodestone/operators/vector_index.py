"""A stored approximate index: rows by cell on disk, product-quantised residuals, exact ranking of the survivors.

``build`` fits cell centres and one codebook for each stretch of dimensions on
a bounded sample (a parameter), then places and encodes every row and writes
Parquet partitioned by cell: id, codes (one byte a stretch) and the vector. A
search looks into the cells nearest to its queries: the scan prunes the others,
and reads ids and codes only. Query tables of distances to the codebooks give
each row a rough distance; the best ``rerank`` times k of a query meet their
vectors again by cell and id and are ranked exactly.

Rows and queries of a cell travel in packs of bounded size, so a cell that
holds most rows, or one that most queries look into, is dealt to many tasks.
Rows without a vector are left out; ids are taken to be unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import cells, scoped

SAMPLE, CODEWORDS = 20_000, 256


@dataclass(frozen=True)
class VectorIndex:
    """centres (cells x dimensions), books (stretches x codewords x their dimensions) and the stored rows (cell, id, codes, v)."""

    centres: np.ndarray
    books: np.ndarray
    rows: DataFrame

    @classmethod
    def build(cls, rows: DataFrame, path: str, n_cells: int, stretches: int = 8, sample: int = SAMPLE) -> VectorIndex:
        """rows(id, v) -> the index at the path, which must be new. The dimensions must be a multiple of the stretches."""
        spark = rows.sparkSession
        rows = rows.where("v is not null").select("id", V.doubles(F.col("v")).alias("v"))
        centres = cells.fit(rows, n_cells, sample)
        placed = cells.assigned(rows, centres)
        books = _books(placed, centres, stretches, sample)
        coded = placed.mapInArrow(_encode(centres, books), f"id {dict(rows.dtypes)['id']}, v array<double>, cell int, codes binary")
        coded.hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(f"{path}/rows")
        model = [("centre", i, 0, x.tolist()) for i, x in enumerate(centres)] + [("book", i, j, x.tolist()) for i, b in enumerate(books) for j, x in enumerate(b)]
        spark.createDataFrame(model, "kind string, i int, j int, v array<double>").coalesce(1).write.parquet(f"{path}/model")
        return cls.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> VectorIndex:
        model = spark.read.parquet(f"{path}/model").orderBy("kind", "i", "j").collect()
        centres = np.array([r.v for r in model if r.kind == "centre"])
        books = np.array([r.v for r in model if r.kind == "book"])
        n = 1 + max((r.i for r in model if r.kind == "book"), default=-1)
        return cls(centres, books.reshape(n, len(books) // max(n, 1), -1) if n else books, spark.read.parquet(f"{path}/rows"))

    def within(self, asked: DataFrame) -> DataFrame:
        """The stored rows of the cells that queries look into; the scan skips the other folders. Cells are as many as centres at most."""
        return self.rows.where(F.col("cell").isin([r.cell for r in asked.select("cell").distinct().collect()]))

    def search(self, queries: DataFrame, k: int, probe: int, rerank: int = 10, distinct_from_self: bool = False) -> DataFrame:
        """queries(query_id, v) -> (query_id, rank, id, distance): of the ``probe`` cells nearest to each query, the rows with the best codes, ranked by exact squared L2; ties go to the smaller id."""
        queries = queries.where("v is not null").select("query_id", V.doubles(F.col("v")).alias("v"))
        asked = cells.assigned(queries, self.centres, probe)
        held = self.within(asked)
        n = rerank * k + distinct_from_self
        q = scoped.packs(asked.select(F.col("cell").alias("group"), "query_id", "v"), "query_id", scoped.QUERY_PACK, "queries")
        r = scoped.packs(held.select(F.col("cell").alias("group"), "id", F.col("codes").alias("v")), "id", 16 * scoped.ROW_PACK, "rows")
        kinds = dict(queries.dtypes)["query_id"], dict(self.rows.dtypes)["id"]
        rough = q.join(r, "group").mapInArrow(_rough(self.centres, self.books, n), f"query_id {kinds[0]}, id {kinds[1]}, cell int, rough double")
        best = W.partitionBy("query_id").orderBy("rough", "id")
        few = rough.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= n).select("query_id", "id", "cell")
        if distinct_from_self:
            few = few.where("id <> query_id")
        met = few.join(held.select("cell", "id", F.col("v").alias("w")), ["cell", "id"]).join(queries, "query_id")
        exact = met.select("query_id", "id", F.round(V.l2(F.col("v"), F.col("w")), 6).alias("distance"))
        order = W.partitionBy("query_id").orderBy("distance", "id")
        return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _matrix(v: pa.Array) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)


def _books(placed: DataFrame, centres: np.ndarray, stretches: int, sample: int) -> np.ndarray:
    """A codebook for each stretch of what is left of vectors beyond their centres, on as many rows as the centres."""
    held = placed.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    if not held.num_rows:
        return np.zeros((0, 0, 0))
    left = _matrix(held.column("v").combine_chunks()) - centres[held.column("cell").to_numpy()]
    return np.array([cells.lloyd(np.ascontiguousarray(x), CODEWORDS) for x in np.split(left, stretches, axis=1)])


def _encode(centres: np.ndarray, books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                left = _matrix(b.column("v")) - centres[b.column("cell").to_numpy()]
                codes = np.stack([cells.nearest(np.ascontiguousarray(x), book, 1)[:, 0] for x, book in zip(np.split(left, len(books), axis=1), books)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), b.column("cell"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "v", "cell", "codes"])

    return run


def _rough(centres: np.ndarray, books: np.ndarray, n: int):
    """Of each pair of packs: each query's n best rows by the distances between its residual and the codebooks."""
    lengths = (books * books).sum(axis=2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, asked, held = batch.column("group"), batch.column("queries"), batch.column("rows")
            for i in range(batch.num_rows):
                q, r = asked[i].values, held[i].values
                codes = np.frombuffer(b"".join(r.field("v").to_pylist()), np.uint8).reshape(len(r), -1)
                left = _matrix(q.field("v")) - centres[cell[i].as_py()]
                m = min(n, len(r))
                who, what, far = [], [], []
                for j, x in enumerate(left):
                    table = lengths - 2 * np.einsum("sd,swd->sw", x.reshape(len(books), -1), books)
                    d = table[0, codes[:, 0]].copy()
                    for s in range(1, len(books)):
                        d += table[s, codes[:, s]]
                    near = np.argpartition(d, m - 1)[:m]
                    who.append(np.full(m, j))
                    what.append(near)
                    far.append(d[near] + x @ x)
                who, what, far = (np.concatenate(x) for x in (who, what, far))
                yield pa.RecordBatch.from_arrays([q.field("id").take(pa.array(who)), r.field("id").take(pa.array(what)), pa.array(np.full(len(far), cell[i].as_py(), np.int32)), pa.array(far)], names=["query_id", "id", "cell", "rough"])

    return run
