"""Stored tables that change in place: versions, conflicts, untouched files."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.sources.keyed import KeyedTable
from lodestone.sources.versions import Conflict

SCHEMA = "a string, b int, v double, tags array<string>"


def rows_of(table):
    return sorted(map(str, (tuple(r) for r in table.collect())))


def test_changes_against_a_dict(spark, tmp_path):
    """Random upserts and deletes, null keys included; older versions stay readable."""
    rng = random.Random(6)
    make = lambda: (rng.choice(["x", "y", None]), rng.choice([*range(12), None]), rng.random(), [str(rng.random())])
    held = {r[:2]: r for r in (make() for _ in range(30))}
    table = KeyedTable.create(spark.createDataFrame(list(held.values()), SCHEMA), str(tmp_path / "t"), ["a", "b"], buckets=8)
    seen = [dict(held)]
    for step in range(4):
        change = {r[:2]: r for r in (make() for _ in range(5))}
        if step % 2:
            table.delete(spark.createDataFrame(list(change.values()), SCHEMA))
            held = {k: r for k, r in held.items() if k not in change}
        else:
            table.upsert(spark.createDataFrame(list(change.values()), SCHEMA))
            held |= change
        seen.append(dict(held))
    for version, want in enumerate(seen, 1):
        assert rows_of(table.read(version)) == sorted(map(str, want.values()))
    assert rows_of(KeyedTable(spark, str(tmp_path / "t")).read()) == sorted(map(str, held.values()))


def test_untouched_files_keep_their_names(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").cast("string").alias("a"), F.lit(1).alias("v"))
    table = KeyedTable.create(rows, str(tmp_path / "t"), ["a"], buckets=16)
    before = table.versions.read()[1]["files"]
    table.upsert(spark.createDataFrame([("7", 2)], "a string, v int"))
    after = table.versions.read()[1]["files"]
    assert sum(before[b] != after[b] for b in before) == 1 and before.keys() == after.keys()
    assert table.read().where("v = 2").count() == 1 and table.read().count() == 400
    assert table.vacuum() == 1 and table.read().count() == 400 and table.vacuum() == 0


def test_two_writers_and_bad_keys(spark, tmp_path):
    table = KeyedTable.create(spark.createDataFrame([("k", 1)], "a string, v int"), str(tmp_path / "t"), ["a"], buckets=2)
    number, held = table.versions.read()
    table.upsert(spark.createDataFrame([("k", 2)], "a string, v int"))
    with pytest.raises(Conflict):
        table.versions.publish(number + 1, held)
    assert [r.v for r in table.read().collect()] == [2]
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([("q", 1), ("q", 2)], "a string, v int"))
    table.delete(spark.createDataFrame([("k",)], "a string"))
    assert table.read().collect() == [] and table.read().columns == ["a", "v"]
    with pytest.raises(Conflict):
        KeyedTable.create(spark.createDataFrame([("k", 1)], "a string, v int"), str(tmp_path / "t"), ["a"])


def test_segments_against_an_index_built_anew(spark, tmp_path):
    """Random additions, replacements and deletions; each version equals a rebuilt index, older ones stay readable, merges bound the segments."""
    from lodestone.operators import bm25
    from lodestone.operators.segments import SegmentedIndex

    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(["red", "green", "blue", "stone", "river", "sky", "x1"]) for _ in range(rng.randint(0, 8)))
    index, held, states = SegmentedIndex(spark, str(tmp_path / "i"), fanout=2), {}, []
    terms = bm25.query_terms(spark.createDataFrame([(1, "red stone"), (2, "sky x1 blue"), (3, "none")], "query_id int, q string"), "q")
    for step in range(7):
        if step % 3 == 2:
            gone = rng.sample(range(30), 6)
            index.delete(spark.createDataFrame([(i,) for i in [*gone, 999]], "doc_id long"))
            held = {k: t for k, t in held.items() if k not in gone}
        else:
            new = {rng.randrange(30): text() for _ in range(6)}
            index.add(spark.createDataFrame(list(new.items()), "doc_id long, text string"))
            held |= new
        states.append(dict(held))
    for version in (2, 5, 7):
        rebuilt = bm25.build(spark.createDataFrame(list(states[version - 1].items()), "doc_id long, text string"), markdown=False)
        now = index.index(version)
        rounded = lambda t: sorted((r.term, r.df, round(r.idf, 9)) for r in t.collect())
        assert rounded(now.terms) == rounded(rebuilt.terms) and rows_of(now.docs) == rows_of(rebuilt.docs) and rows_of(now.postings) == rows_of(rebuilt.postings)
        assert rows_of(bm25.search(now, terms, 5)) == rows_of(bm25.search(rebuilt, terms, 5))
    number, newest = index.versions.read()
    assert number == 7 and len(newest["segments"]) <= 5
    index.vacuum()
    assert rows_of(index.index().docs) == sorted(str((k, len(t.split()))) for k, t in held.items())


def test_segments_of_nothing(spark, tmp_path):
    from lodestone.operators import bm25
    from lodestone.operators.segments import SegmentedIndex

    index = SegmentedIndex(spark, str(tmp_path / "i"))
    terms = bm25.query_terms(spark.createDataFrame([(1, "red")], "query_id int, q string"), "q")
    assert bm25.search(index.index(), terms, 5).collect() == []
    index.add(spark.createDataFrame([(1, None), (2, ""), (3, "red red")], "doc_id long, text string"))
    index.delete(spark.createDataFrame([(3,)], "doc_id long"))
    assert bm25.search(index.index(), terms, 5).collect() == [] and index.index().docs.count() == 2


@pytest.mark.parametrize("width", [1, 3, 64])
def test_blocks_give_the_same_search(spark, tmp_path, width):
    """Ties, documents without terms, queries that find less than k, and a query of a rare term that leaves most postings unscored."""
    from lodestone.operators import bm25
    from lodestone.operators.blockmax import BlockIndex

    rng = random.Random(width)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(40)], k=rng.randint(0, 30)))) for i in range(300)] + [(300, None), (301, "rare w0 w0"), (302, "w0 w0 rare")]
    index = bm25.build(spark.createDataFrame(docs, "doc_id long, text string"), markdown=False)
    terms = bm25.query_terms(spark.createDataFrame([(1, "w0 w1 w2"), (2, "rare w0"), (3, "w39 w38"), (4, "nothing"), (5, "w5 w5 w5 w1")], "query_id int, q string"), "q")
    blocks = BlockIndex.build(index, str(tmp_path / "b"), width)
    got, share = blocks.search(terms, 5, first=2)
    assert rows_of(got) == rows_of(bm25.search(index, terms, 5))
    rows = {r.query_id: (r.n_scored, r.n_postings) for r in share.collect()}
    assert all(a <= n for a, n in rows.values())
    if width == 3:
        two, share = blocks.search(terms.where("query_id = 2"), 2, first=2)
        assert rows_of(two) == rows_of(bm25.search(index, terms.where("query_id = 2"), 2))
        assert share.first().n_scored < 0.2 * share.first().n_postings


def test_log_until_the_first_bad_line(spark, tmp_path):
    """Each file by itself, over several splits; blank lines, other JSON and a bad first line."""
    from lodestone.sources import corpus

    log = tmp_path / "log"
    log.mkdir()
    row = lambda i: f'{{"a": {i}, "b": "{"x" * 50}"}}\n'
    (log / "good.jsonl").write_text(row(1) + "\n  \n" + row(2))
    (log / "long.jsonl").write_text("".join(row(i) for i in range(1000, 4000)) + '{"a": 1\n' + row(9) + "also bad\n" + row(9))
    (log / "first.jsonl").write_text("oops\n" + row(9))
    (log / "other.jsonl").write_text('[1, 2]\nnull\n{"b": "y"}\nnot json\n' + row(9))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = sorted(str(tuple(r)) for r in corpus.jsonl_until_bad(spark, str(log), "a long, b string").select("a").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted([*[f"({i},)" for i in [1, 2, *range(1000, 4000)]], "(None,)", "(None,)", "(None,)"])


def test_sketches(spark):
    """Merged hours answer within a hundredth; one value, equal values and nulls."""
    from lodestone.operators import sketches

    rows = spark.range(60_000).selectExpr("if(id % 3 = 0, 'a', 'b') as k", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(id % 48 as int)) as t", "pow(id * 7919 % 60000, 2) as v")
    rows = rows.unionByName(spark.sql("select 'one' as k, timestamp'2024-01-01' as t, 5.0D as v union all select 'one', timestamp'2024-01-01', null union all select 'none', timestamp'2024-01-01', null"))
    at = {"p50": 0.5, "p99": 0.99}
    hours = sketches.hourly(rows, "v", "t", ["k"])
    assert hours.where("k = 'a'").count() == 16 and hours.where("k = 'none'").count() == 0
    found = sketches.quantiles(sketches.merged(hours, ["k"]), at)
    days = rows.withColumn("day", F.date_trunc("day", "t"))
    errors = sketches.rank_error(days, "v", found, ["k", "day"], at).collect()
    assert len(errors) == 5 and all(r.p50_error <= 0.01 and r.p99_error <= 0.01 for r in errors)
    assert [r.p50 for r in found.where("k = 'one'").collect()] == [5.0]


def test_summaries_by_levels(spark):
    """Against a plain loop; texts that do not get shorter end too."""
    from lodestone.operators import summaries as S

    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 5, 6, 40, 700)] + [None, "\n \t "]
    want = []
    for k, t in enumerate(texts):
        t, level = t or "", 0
        while len(t.split()) > 5:
            w = t.split()
            new = "\n\n".join(f"Section {i + 1}:\n" + " ".join(w[s : s + 2]) for i, s in enumerate(range(0, len(w), 10)))
            level, shorter, t = level + 1, len(new) < len(t), new
            if not shorter:
                break
        want.append((k, t, level))
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, body string")
    got = S.by_levels(docs, "k", "body", lambda t: F.size(S.words(t)) <= 5, S.word_chunks(10), S.first_words(2))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert S.by_levels(docs.limit(0), "k", "body", lambda t: F.size(S.words(t)) <= 5, S.word_chunks(10), S.first_words(2)).collect() == []


def test_tasks_count_and_score_a_bounded_number_of_documents(spark, monkeypatch):
    """Texts are dealt by document before their words are counted, and scores are summed by document, in tasks whose number follows the input."""
    from lodestone.operators import bm25

    docs = spark.createDataFrame([(i, f"cat w{i} dog w{i % 7}") for i in range(60)], "doc_id long, text string")
    terms = bm25.query_terms(spark.createDataFrame([(1, "cat w3"), (2, "dog")], "query_id long, query string"), "query")
    plain = rows_of(bm25.search(bm25.build(docs, markdown=False), terms, 5))
    monkeypatch.setattr(bm25, "DOC_BLOCK", 2)
    monkeypatch.setattr(bm25, "PAIR_BLOCK", 3)
    counts, found = bm25.term_counts(docs), bm25.search(bm25.build(docs, markdown=False), terms, 5)
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan(counts) and ", 30), REPARTITION_BY_NUM" in plan(counts) and ", 40), REPARTITION_BY_NUM" in plan(found)
    assert rows_of(found) == plain
    monkeypatch.setattr(bm25, "FEW_TERMS", 1)
    many = bm25.search(bm25.build(docs, markdown=False), terms, 5)
    assert "hashpartitioning(query_id" in plan(many) and rows_of(many) == plain


@pytest.mark.parametrize("kind", ["write", "blocks", "segment"])
def test_an_index_reads_its_texts_once(spark, tmp_path, kind):
    from lodestone.operators import bm25
    from lodestone.operators.blockmax import BlockIndex
    from lodestone.operators.segments import SegmentedIndex

    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    docs = spark.createDataFrame([(i, f"cat w{i} dog") for i in range(40)], "doc_id long, text string").repartition(2)
    docs = docs.withColumn("text", F.udf(read, "string")("text"))
    if kind == "segment":
        SegmentedIndex(spark, str(tmp_path / "i")).add(docs)
    else:
        index = bm25.build(docs, markdown=False)
        index.write(str(tmp_path / "i")) if kind == "write" else BlockIndex.build(index, str(tmp_path / "i"))
        assert not index.postings.storageLevel.useMemory
    assert seen.value == 40


def test_writing_an_index_keeps_nothing_in_memory(spark, tmp_path, monkeypatch):
    """Its parts are made of the postings as written; a text without words, a null and an overwritten index included."""
    from pyspark.sql.classic.dataframe import DataFrame

    from lodestone.operators import bm25

    def never(self, *_):
        raise AssertionError("kept in memory")

    for texts in (["cat cat", "dog"], ["cat dog dog", "", None, "cat", "fish cow", "cow"]):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        index = bm25.build(docs, markdown=False)
        with monkeypatch.context() as m:
            m.setattr(DataFrame, "persist", never)
            index.write(str(tmp_path / "i"))
        back = bm25.Index.read(spark, str(tmp_path / "i"))
        for part in ("postings", "docs", "terms", "corpus"):
            assert sorted(map(str, getattr(back, part).collect())) == sorted(map(str, getattr(index, part).collect()))


def test_few_query_terms_meet_postings_where_they_lie(spark, tmp_path):
    """No task gathers and sorts a frequent term's postings."""
    from lodestone.operators import bm25

    docs = spark.createDataFrame([(i, f"cat w{i}") for i in range(40)], "doc_id long, text string")
    terms = bm25.query_terms(spark.createDataFrame([(1, "cat w3"), (2, "w7 dog")], "query_id long, query string"), "query")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = bm25.search(bm25.build(docs, markdown=False), terms, 3)
        assert "SortMergeJoin [term" not in found._jdf.queryExecution().executedPlan().toString()
        got = rows_of(found.select("query_id", "rank", "doc_id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == ["(1, 1, 3)", "(1, 2, 0)", "(1, 3, 1)", "(2, 1, 7)"]


def test_postings_pass_by_their_documents_unsorted(spark):
    """A scoring task holds its documents' lengths; its postings are not sorted to meet them."""
    from lodestone.operators import bm25

    docs = spark.createDataFrame([(i, f"cat w{i}") for i in range(40)], "doc_id long, text string")
    terms = bm25.query_terms(spark.createDataFrame([(1, "cat w3"), (2, "w7 dog")], "query_id long, query string"), "query")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = bm25.search(bm25.build(docs, markdown=False), terms, 3)
        met = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [doc_id" in x and "Inner" in x]
        assert met and all("ShuffledHashJoin" in x and "BuildRight" in x for x in met)
        got = rows_of(found.select("query_id", "rank", "doc_id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == ["(1, 1, 3)", "(1, 2, 0)", "(1, 3, 1)", "(2, 1, 7)"]


@pytest.mark.parametrize("dealt", [True, False])
def test_blocks_are_searched_where_they_lie(spark, tmp_path, monkeypatch, dealt):
    """No row of a (query, block) or of a chosen block's posting is shuffled; several buckets, cells that share one, and a search written back."""
    from lodestone.operators import blockmax, bm25

    monkeypatch.setattr(blockmax, "CELL", 16)
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(rng.choices([f"w{j}" for j in range(30)], [1 / (j + 1) for j in range(30)], k=rng.randint(0, 20)))) for i in range(200)], "doc_id long, text string")
    terms = bm25.query_terms(spark.createDataFrame([(1, "w0 w9 w0"), (2, "w3 w4 w29"), (3, "w1 none")], "query_id int, q string"), "q")
    counts = bm25.term_counts(docs, cells=blockmax.cells(spark, 200)) if dealt else None
    index = bm25.build(docs, markdown=False, counts=counts)
    tables = spark.catalog.listTables()
    blocks = blockmax.BlockIndex.build(index, str(tmp_path / "b"), 2)
    assert spark.catalog.listTables() == tables
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        begun = blocks.begun(terms, 4, first=2)
        assert "Exchange hashpartitioning" not in plan(begun.open_)
        with blockmax.met_by_cell(spark):
            assert "Exchange hashpartitioning" not in plan(begun.rest())
        found, share = begun.best(), begun.share()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows_of(found) == rows_of(bm25.search(bm25.build(docs, markdown=False), terms, 4))
    have = index.postings.join(terms, "term").groupBy("query_id").count()
    assert {r.query_id: r.n_postings for r in share.collect()} == {r.query_id: r["count"] for r in have.collect()}
    assert all(r.n_scored <= r.n_postings for r in share.collect())
