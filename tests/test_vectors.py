"""Searches within each query's own groups against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import dense, scoped
from lodestone.operators.vector_index import VectorIndex


@pytest.mark.parametrize(("rows_", "queries_"), [(4096, 1024), (3, 2), (1, 1)])
def test_scoped_search(spark, rows_, queries_):
    """Whatever the size of packs; ties, rows in several groups, groups without rows, queries without groups, null vectors."""
    rng = random.Random(1)
    vec = lambda: [float(rng.randint(-2, 2)) for _ in range(3)]
    rows = [(rng.choice(["a", "a", "a", "b", "c"]), i, vec()) for i in range(60)] + [("b", 3, [0.0, 0.0, 0.0]), ("b", 70, None)]
    queries = [(i, vec()) for i in range(8)] + [(9, None)]
    allowed = [(i, g) for i in range(10) for g in "abcx" if rng.random() < 0.5] + [(1, "a"), (1, "a")]
    want = []
    for q, v in queries:
        mine = {g for i, g in allowed if i == q}
        near = sorted((round(sum((x - y) ** 2 for x, y in zip(v, w)), 6), i) for g, i, w in rows if v and w and g in mine)
        want += [(q, r + 1, i, d) for r, (d, i) in enumerate(near[:4])]
    table = lambda data, schema: spark.createDataFrame(data, schema)
    args = table(queries, "query_id int, v array<double>"), table([(*r, "x") for r in rows], "group string, id long, v array<double>, queries string"), table(allowed, "query_id int, group string")
    assert sorted(tuple(r) for r in scoped.search(*args, 4, rows_, queries_).collect()) == sorted(want)


def test_scoped_search_by_struct_ids(spark):
    rows = spark.range(50).select(F.lit(1).alias("group"), F.struct((50 - F.col("id")).alias("doc"), F.col("id").alias("part")).alias("id"), F.array((F.col("id") % 5).cast("double")).alias("v"))
    queries = spark.createDataFrame([("q", [0.0])], "query_id string, v array<double>")
    got = scoped.search(queries, rows, spark.createDataFrame([("q", 1)], "query_id string, group int"), 3, 7, 7).collect()
    assert [(r.rank, r.id.doc, r.distance) for r in sorted(got)] == [(1, 5, 0.0), (2, 10, 0.0), (3, 15, 0.0)]
    assert scoped.search(queries, rows.limit(0), spark.createDataFrame([("q", 1)], "query_id string, group int"), 3).collect() == []


def test_scoped_search_makes_no_pairs(spark):
    rows = spark.range(10).select((F.col("id") % 2).alias("group"), "id", F.array(F.lit(1.0)).alias("v"))
    p = scoped.search(rows.select(F.col("id").alias("query_id"), "v"), rows, rows.select(F.col("id").alias("query_id"), "group"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in p and "NestedLoop" not in p


@pytest.fixture(scope="module")
def clusters(spark):
    """2,000 rows about 20 centres in 16 dimensions, a third of them one vector."""
    rng = random.Random(4)
    centres = [[rng.gauss(0, 4) for _ in range(16)] for _ in range(20)]
    rows = [(f"r{i:04d}", [x + rng.gauss(0, 1) for x in rng.choice(centres)] if i % 3 else centres[0]) for i in range(2000)]
    queries = [(i, [x + rng.gauss(0, 1) for x in rng.choice(centres)]) for i in range(30)]
    return spark.createDataFrame([*rows, ("none", None)], "id string, v array<double>"), spark.createDataFrame([*queries, (99, None)], "query_id int, v array<float>")


def test_index_of_all_cells_is_exact(spark, clusters, tmp_path):
    """All cells and enough survivors give the exact search, ties of equal vectors included; another session reads the same index."""
    rows, queries = clusters
    VectorIndex.build(rows, str(tmp_path / "x"), 16, stretches=4)
    index = VectorIndex.read(spark, str(tmp_path / "x"))
    assert index.rows.count() == 2000
    want = dense.knn(queries.where("v is not null").withColumn("v", F.col("v").cast("array<double>")), rows.where("v is not null"), 5)
    assert sorted(index.search(queries, 5, 16, rerank=400).collect()) == sorted(want.collect())


def test_index_prunes_cells(spark, clusters, tmp_path):
    rows, queries = clusters
    index = VectorIndex.build(rows, str(tmp_path / "x"), 16, stretches=4)
    want = {(r.query_id, r.id) for r in dense.knn(queries.where("v is not null").withColumn("v", F.col("v").cast("array<double>")), rows.where("v is not null"), 5).collect()}
    got = {(r.query_id, r.id) for r in index.search(queries, 5, 4, rerank=20).collect()}
    assert len(want & got) >= 0.9 * len(want)
    one = index.search(queries.limit(1), 5, 2)
    p = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in p and "ReadSchema: struct<id:string,codes:binary>" in p and "NestedLoop" not in p
    read = index.within(spark.createDataFrame([(3,), (5,)], "cell int"))
    assert {r.cell for r in read.select("cell").distinct().collect()} == {3, 5}


def test_index_of_no_rows(spark, clusters, tmp_path):
    rows, queries = clusters
    few = VectorIndex.build(rows.limit(3), str(tmp_path / "few"), 16, stretches=4)
    assert few.search(queries, 5, 16).groupBy("query_id").count().where("count <> 3").isEmpty()


def test_a_task_of_the_block_search_holds_one_pair_of_blocks(spark, monkeypatch):
    """However many blocks there are; dealt by hash, some tasks held several."""
    import pyarrow as pa

    rows = spark.range(70).select("id", F.array(*[(F.col("id") * p % 7).cast("double") for p in (1, 3, 5)]).alias("v"))
    asked = rows.where("id % 5 = 0").withColumnRenamed("id", "query_id")
    plain = sorted(map(str, dense.knn(asked, rows, 6).collect()))
    monkeypatch.setattr(dense, "ROW_BLOCK", 5)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 4)
    assert sorted(map(str, dense.knn(asked, rows, 6).collect())) == plain

    def where(queries, rows, k, distinct_from_self=False):
        def best(q, r):
            from pyspark import TaskContext

            return pa.table({"query_id": [TaskContext.get().partitionId()], "id": [r.num_rows], "distance": [0.0]})

        return best, "query_id long, id long, distance double"

    monkeypatch.setattr(dense, "block_search", where)
    tasks = [x.query_id for x in dense.knn(asked, rows, 100).collect()]
    assert len(tasks) > 40 and len(set(tasks)) == len(tasks)
