"""Hand-made cases for the functions and operators."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import bm25, chats, chunk, dense, evalset, fusion, rerank, traces, verify
from lodestone.sources import corpus


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_markdown(spark):
    t = "# Head\n\nSee [the link](http://x.y) and `code` and **bold** *it* $a+b$ $$c\nd$$\n```\nblock\n```\n| a | b |\n|---|---|"
    assert one(spark, T.clean_markdown(F.col("t")), t=t) == "Head See the link and and bold it a b"


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("t")), t="The state-of-the-art naïve Don't BM25!") == ["the", "state-of-the-art", "bm25"]
    assert "naïve" in one(spark, T.tokens(F.col("t"), unicode=True), t="naïve")


def test_titles_and_items(spark):
    assert one(spark, T.title(F.col("t"), F.lit("stem")), t="## My paper\nx") == "My paper"
    assert one(spark, T.title(F.col("t"), F.lit("stem")), t="no head") == "stem"
    assert one(spark, T.numbered_items(F.col("t")), t="1. first claim\n2) second claim\n3. no\nother") == ["first claim", "second claim"]
    assert one(spark, T.tidy_title(F.col("t"), F.col("q")), t='"A Title"', q="q") == "A Title"
    assert one(spark, T.tidy_title(F.col("t"), F.col("q")), t="x", q="y" * 60) == "y" * 50
    assert one(spark, T.truncated(F.col("t"), 50), t="z" * 51) == "z" * 50 + "..."


def test_tables_and_page_breaks(spark):
    assert one(spark, T.looks_like_table(F.col("t")), t="| a | b |\n|---|---|\n| 1 | 2 |")
    assert one(spark, T.looks_like_table(F.col("t")), t="a | b | c\nd | e | f\ng | h | i")
    assert not one(spark, T.looks_like_table(F.col("t")), t="a | b\nc | d")
    assert one(spark, T.without_page_breaks(F.col("t")), t="text\n---\n12\n{3}---\n\n| a |\n---\n| b |\nend") == "text\n\n| a |\n---\n| b |\nend"


def test_orphans(spark):
    pieces = F.split(F.col("t"), "#")
    assert one(spark, chunk.with_orphans(pieces), t="(1)#para#Eq. 3#next#[4]") == ["(1)", "para\nEq. 3", "next\n[4]"]


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ('```json\n{"decision": "KEEP", "reason": "fine"}\n```', ("KEEP", "fine")),
        ('so: {"a": {"b": 1}} {"decision": "OUT", "reason": "page number"} done', ("OUT", "page number")),
        ('broken "decision": "keep", "reason": "because', ("KEEP", "no reason given")),
        ('{"decision": "OUT", "about": {"x": {"y": "}"}}, "reason": "nested"} and {"z": 1}', ("OUT", "nested")),
        ('"Decision" : "out", then "REASON": "in words", end', ("OUT", "in words")),
        ('{"decision": "two words", "reason": 3}', ("two words", "3")),
        ('decision: "KEEP"', None),
        ("nothing", None),
    ],
)
def test_decisions(spark, answer, want):
    got = one(spark, T.decision(F.col("t")), t=answer)
    assert (tuple(got) if got else None) == want


def test_other_text(spark):
    assert json.loads(one(spark, T.outer_json(F.col("t")), t='```json\n[1, [2]]\n``` ok')) == [1, [2]]
    assert one(spark, T.delta(F.col("a"), F.col("b")), a="abcd", b="ab") == "cd"
    assert one(spark, T.delta(F.col("a"), F.col("b")), a="xyz", b="ab") == "xyz"
    assert one(spark, T.pretty_name(F.col("t")), t="/a/b/my_paper-one.md") == "my paper one"
    assert one(spark, T.html_to_text(F.col("t")), t="<p>a &amp; b<script>x()</script></p><!-- c -->d") == "a & b d"
    assert one(spark, T.by_token_ratio(F.col("t"), F.lit(10), 5), t="abcdefghij") == "abcde"
    assert one(spark, T.tail_by_ratio(F.col("t"), F.lit(10), 3), t="abcdefghij") == "hij"
    assert one(spark, T.sigmoid(F.lit(0.0)), t="") == 0.5 and one(spark, T.yes_probability(F.lit(1.0), F.lit(1.0)), t="") == 0.5


def ranges(spark, column, n):
    words = F.split(F.array_join(F.sequence(F.lit(1), F.lit(n)), " "), " ")
    return [(c.start, c.end) for c in spark.range(1).select(column(words).alias("c")).first().c]


def test_fixed_and_uniform_chunks(spark):
    fixed = lambda w: chunk.fixed(w, 800, 200)
    assert ranges(spark, fixed, 800) == [(0, 800), (600, 800)]
    assert ranges(spark, fixed, 900) == [(0, 800), (600, 900)]
    assert ranges(spark, fixed, 1400) == [(0, 800), (600, 1400), (1200, 1400)]
    uniform = lambda w: chunk.uniform(w, 19000, 1500)
    assert ranges(spark, uniform, 19000) == [(0, 19000)]
    assert ranges(spark, uniform, 20000) == [(0, 10750), (9250, 20000), (18500, 20000)]
    assert ranges(spark, uniform, 40000)[-1] == (38502, 40000) and len(ranges(spark, uniform, 40000)) == 4


def test_paragraph_chunks(spark):
    rows = spark.createDataFrame([([1] * 5,), ([500],), ([],)], "n array<int>")
    got = [[(c.start, c.end) for c in r.c] for r in rows.select(chunk.paragraph_ranges("n", 100, 2).alias("c")).collect()]
    assert got == [[(0, 5), (3, 5), (4, 5)], [(0, 1)], []]


@pytest.mark.parametrize(("size", "overlap", "older"), [(100, 2, False), (30, 0, False), (60, 3, True), (1, 1, True)])
def test_paragraph_chunks_against_a_loop(spark, size, overlap, older):
    import random

    rng = random.Random(size)
    lists = [[rng.choice([0, 1, 5, 20, 90]) for _ in range(rng.randint(0, 40))] for _ in range(60)]
    want = []
    for counts in lists:
        i, out = 0, []
        while i < len(counts):
            n, j = 0, i
            while j < len(counts) and (j == i or n + counts[j] <= size):
                n, j = n + counts[j], j + 1
            out.append((i, j))
            if older and j == len(counts):
                break
            i = max(i + 1, j - (min(overlap, j - i - 1) if older else overlap))
        want.append(out)
    rows = spark.createDataFrame(list(enumerate(lists)), "id int, n array<int>")
    got = {r.id: [(c.start, c.end) for c in r.c] for r in rows.select("id", chunk.paragraph_ranges("n", size, overlap, older).alias("c")).collect()}
    assert [got[i] for i in range(len(lists))] == want


def test_very_many_paragraphs(spark):
    """100,000 paragraphs of one text are packed in seconds."""
    import time

    began = time.time()
    r = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: (i % 7).cast("int")).alias("n")).select(F.size(chunk.paragraph_ranges("n", 50, 1)).alias("c")).first()
    assert r.c > 5000 and time.time() - began < 60


def test_recursive_and_header_chunks(spark):
    t = "alpha beta. gamma delta\n\n" + "word " * 100
    d = spark.createDataFrame([(1, t), (2, None), (3, "")], "id long, text string")
    got = chunk.recursive(d, "text", 60, 10, ["id"]).collect()
    assert {r.id for r in got} == {1} and max(len(r.chunk) for r in got) <= 60 and "alpha beta. gamma delta" in got[0].chunk
    h = spark.createDataFrame([(1, "# A\n" + "a" * 100 + "\n## B\n" + "b" * 100 + "\n# C\n" + "c" * 1000)], "id long, text string")
    parts = [r.chunk for r in chunk.by_headers(h, "text", 60, 5, ["id"]).collect()]
    assert parts[0].startswith("# A") and "## B" in parts[0] and any("c" * 100 in p for p in parts[1:])


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "cat sat mat"), (2, "dog sat"), (3, "bird flew far away"), (4, "")], "doc_id long, text string")
    index = bm25.build(docs)
    q = spark.createDataFrame([(1, "cat sat"), (2, " "), (3, "cat cat")], "query_id long, text string")
    got = bm25.search(index, bm25.query_terms(q), 10).collect()
    assert [r.doc_id for r in got if r.query_id == 1] == [1, 2] and not [r for r in got if r.query_id == 2]
    one_, two = (next(r.score for r in bm25.search(index, bm25.query_terms(spark.createDataFrame([(9, x)], "query_id long, text string")), 1).collect()) for x in ("cat", "cat cat"))
    assert two == pytest.approx(2 * one_)


def test_bm25_round_trip(spark, tmp_path):
    index = bm25.build(spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string"))
    index.write(str(tmp_path))
    assert bm25.Index.read(spark, str(tmp_path)).terms.count() == 3


def test_fusion(spark):
    lists = lambda *x: spark.createDataFrame([(1, r + 1, d) for r, d in enumerate(x)], "query_id long, rank int, doc_id string")
    got = fusion.fuse(lists("A", "B"), lists("B", "C")).orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 6)) for r in got] == [("B", 0.85), ("C", 0.35), ("A", 0.3)]
    assert fusion.fuse(lists(), lists("A", "A")).first().score == pytest.approx(1.05)
    got = {r.doc_id: r.score for r in fusion.fuse_by_position(lists("A", "B"), lists("B", "A", "B"), 2).collect()}
    assert got == {"A": pytest.approx(0.825), "B": pytest.approx(0.925)}
    with pytest.raises(ValueError):
        fusion.fuse_by_position(lists("A"), lists("B"), 2, (0.5, 0.6))


def cands(spark, texts):
    return spark.createDataFrame([(1, "red fox", i, i, t) for i, t in enumerate(texts, 1)], "query_id long, query string, doc_id long, orig_rank int, text string")


def test_rerank(spark):
    rows = cands(spark, ["nothing", None, "a red fox", "", "red"])
    kept = rerank.candidates(rows)
    assert kept.count() == 3
    got = rerank.rerank(kept, 3).orderBy("rank").collect()
    assert [(r.doc_id, r.rank_improvement, r.method) for r in got] == [(3, 2, "scored"), (5, 3, "scored"), (1, -2, "scored")]
    failed = rerank.rerank(kept, 2, lambda q, t: F.when(t != "red", 1.0)).orderBy("rank").collect()
    assert [(r.doc_id, r.method) for r in failed] == [(1, "fallback"), (3, "fallback")]
    assert rerank.candidates(cands(spark, ["x"] * 120), 50).count() == 50
    assert rerank.candidates(cands(spark, ["x" * 40] * 5), 50, 25.0).count() == 2


def test_verify(spark):
    answers = spark.createDataFrame([(1, "1. The red fox jumped.\n2. Blue whales sing loudly."), (2, "short")], "answer_id long, answer string")
    docs = spark.createDataFrame([(1, 0, "the red fox jumped high"), (1, 1, "something else")], "answer_id long, doc_idx int, text string")
    v = verify.verify(verify.split_claims(answers), docs)
    got = {r.claim_idx: (r.is_grounded, r.supporting) for r in v.collect()}
    assert got == {0: (True, [0]), 1: (False, [])}
    s = {r.answer_id: (r.n_claims, r.grounding_ratio) for r in verify.summary(answers, v).collect()}
    assert s == {1: (2, 0.5), 2: (0, 1.0)}


def test_search_by_cells(spark):
    """A few of the cells give nearly the exact neighbours of clustered vectors, from a part of the rows, also where cells are dealt in parts."""
    import numpy as np

    from lodestone.operators import cells

    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 16))[rng.integers(0, 40, 3000)] + 0.3 * rng.standard_normal((3000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    queries = rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    at = cells.fit(rows, 32, sample=1000)
    index = cells.assigned(rows, at)
    assert index.count() == 3000 and index.select("cell").distinct().count() > 16
    got = cells.search(queries, index, at, 10, 4, distinct_from_self=True, row_block=100, query_block=7).collect()
    hits, compared = 0, index.join(cells.assigned(queries, at, 4), "cell").count()
    for q in range(0, 3000, 50):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        mine = [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        assert len(mine) == 10
        hits += len(set(mine) & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits / 600 >= 0.9 and compared < 0.5 * 3000 * 60
    empty = rows.where("false")
    none = cells.fit(empty, 8)
    assert len(none) == 0 and cells.search(queries, cells.assigned(empty, none), none, 10, 4).count() == 0


def test_verify_in_rows_equals_joins(spark):
    """Both forms of verification agree, also for answers without claims or documents."""
    texts = ["the red fox jumped high over the wall", "something else entirely is written here", "blue whales sing loudly at night"]
    rows = [(i, ". ".join(texts[: i % 4]) + ". ", [(k, t) for k, t in enumerate(texts[i % 3 :])] if i != 5 else []) for i in range(8)]
    nested = spark.createDataFrame(rows, "answer_id long, answer string, docs array<struct<doc_idx: int, text: string>>")
    flat = nested.select("answer_id", F.inline("docs"))
    joined = verify.verify(verify.split_claims(nested), flat)
    got = verify.verify_rows(nested)
    key = lambda r: (r.answer_id, r.claim_idx, r.claim, r.max_score, r.supporting, r.is_grounded)
    assert sorted(map(key, joined.collect())) == sorted(key(r) for r in got.collect() if r.claim is not None)
    both = [sorted((r.answer_id, r.n_claims, r.n_grounded, r.grounding_ratio, tuple(r.unsupported)) for r in s.collect()) for s in (verify.summary(nested, joined), verify.summary(None, got))]
    assert both[0] == both[1] and len(both[0]) == 8


def test_runtime_and_parsers(spark, tmp_path):
    from lodestone.operators import models, runtime

    assert [runtime.tier(x)["tier"] for x in (80, 64, 40, 8)] == ["large", "large", "medium", "small"]
    assert runtime.shuffle_partitions(10 << 30, 40) == 80 and runtime.shuffle_partitions(0, 8) == 1
    with runtime.pool(spark, "retrieval"):
        assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") == "retrieval"
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    pairs = spark.createDataFrame([("q", "a"), ("q", "bbb")], "q string, t string")
    yes = [r.s for r in pairs.select(models.score_yes_no(F.col("q"), F.col("t"), lambda: lambda ps: [(len(t), 1.0) for _, t in ps]).alias("s")).collect()]
    assert yes[0] == pytest.approx(0.5) and yes[1] == pytest.approx(1 / (1 + 2.718281828459045**-2))
    (tmp_path / "a.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "b.pdf").write_bytes(b"bad")

    def load():
        def parse(path, content):
            if content == b"bad":
                raise ValueError("no pages")
            return models.plain_pages(path, content)

        return parse

    got = sorted((r.path[-5:], r.page if r.page is not None else -1, r.text, r.error) for r in models.parse_pages(corpus.binary(spark, str(tmp_path)), load).collect())
    assert got == [("a.pdf", 0, "one", None), ("a.pdf", 1, "two", None), ("b.pdf", -1, None, "ValueError: no pages")]


def test_dense(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "id long, v array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, v array<double>")
    assert [r.id for r in dense.knn(q, rows, 2).orderBy("rank").collect()] == [1, 3]
    assert dense.within(rows, "id", set()).count() == 3 and dense.within(rows, "id", {1}).count() == 1
    assert spark.createDataFrame([([3.0, 4.0],)], "v array<double>").select(V.norm(F.col("v")).alias("n")).first().n == 5.0


def test_traces(spark):
    s = spark.createDataFrame([(1, "a", 5.0, "success"), (1, "b", 7.0, "skipped"), (2, "a", 1.0, "error"), (3, "a", 1.0, "running")], "trace_id long, stage string, duration_ms double, status string")
    assert {r.trace_id: r.status for r in traces.final_status(s).collect()} == {1: "success", 2: "error", 3: "partial"}
    assert {r.trace_id: r.slowest_stage for r in traces.bottleneck(s).collect()}[1] == "b"
    assert {r.trace_id: r.failed_stage for r in traces.first_missing(s, ("a", "b")).collect()} == {1: "unknown", 2: "b", 3: "b"}


def test_feedback_prefix(spark):
    steps = spark.createDataFrame([("ab_user", 1), ("abc_user", 0), ("zz", 1)], "step_id string, value int")
    entries = spark.createDataFrame([("ab",), ("abc",), ("",)], "entry_id string")
    assert {r.step_id: r.entry_id for r in chats.feedback(steps, entries).collect()} == {"ab_user": "ab", "abc_user": "abc"}


def test_pages_by_key(spark):
    t = spark.createDataFrame([(i, i % 3) for i in range(8)] + [(None, 1)], "k long, n long")
    order = [(-F.col("n")).alias("less"), F.col("k")]
    keys = [(r.k, r.n) for r in t.orderBy(*order).collect()]
    seen, cursor = [], None
    while True:
        p = chats.page(t, order, 4, cursor, before=len(seen)).orderBy("rank").collect()
        assert [r["rank"] for r in p] == list(range(len(seen) + 1, len(seen) + len(p) + 1))
        seen += [(r.k, r.n) for r in p]
        assert all(r.has_next == (len(seen) < 9) for r in p)
        if not p[0].has_next:
            break
        cursor = F.struct(F.lit(-seen[-1][1]).cast("long").alias("less"), F.lit(seen[-1][0]).cast("long").alias("k"))
    assert seen == keys
    assert [r.k for r in chats.page(t, order, 1, F.lit(None).cast("struct<less: bigint, k: bigint>")).collect()] == [keys[0][0]]
    assert chats.page(t.where("false"), order, 3).count() == 0


def test_titles_and_traces_of_owners(spark):
    c = spark.createDataFrame([("a", "u", None), ("b", "u", "has one"), ("c", "v", None)], "chat string, owner string, title string")
    new = spark.createDataFrame([("a", "u", "New"), ("b", "u", "Late"), ("c", "u", "Not mine"), ("a", "v", "Nor this")], "chat string, user string, title string")
    assert {r.chat: r.title for r in chats.retitled(c, new).collect()} == {"a": "New", "b": "has one", "c": None}
    asked = spark.createDataFrame([("a", "u"), ("a", "v"), ("z", "u")], "chat string, user string")
    t = spark.createDataFrame([("a", "t1"), ("a", "t2"), ("b", "t3")], "chat string, trace_id string")
    got = sorted((r.chat, r.user, r.access, r.trace_id or "") for r in chats.traces_of(asked, c.select("chat", "owner"), t).collect())
    assert got == [("a", "u", "owner", "t1"), ("a", "u", "owner", "t2"), ("a", "v", "other", ""), ("z", "u", "missing", "")]


def test_listed_claims(spark):
    t = "1. Alpha beta\n2) alpha BETA\nx\n3. abc\n  A line that is long enough to stay\n4 not a list item but it is long\n"
    assert one(spark, T.listed_claims(F.col("t")), t=t) == ["Alpha beta", "A line that is long enough to stay"]


def test_gate(spark):
    s = spark.createDataFrame([(1, 0.7), (2, 0.69), (3, 1.0)], "answer_id long, grounding_ratio double")
    assert {r.answer_id: r.passes for r in verify.passes(s).collect()} == {1: True, 2: False, 3: True}


def test_records_matched(spark):
    ranked = spark.createDataFrame([("p", 1, "t"), ("p", None, "t"), ("q", 9, "u")], "file_path string, chunk_index int, text string")
    originals = spark.createDataFrame([("p", 1, "t", 3, 0.5), ("p", 1, "t", 2, 0.4), ("p", None, "t", 7, 0.1), ("p", 1, "other", 1, 0.9)], "file_path string, chunk_index int, text string, orig_rank int, distance double")
    by_key = rerank.matched(ranked, originals, ["file_path", "chunk_index"], ["distance"]).collect()
    assert sorted((r.file_path, str(r.chunk_index), r.orig_rank, r.distance) for r in by_key if r.orig_rank) == [("p", "1", 1, 0.9), ("p", "None", 7, 0.1)] and len(by_key) == 3
    whole = rerank.matched(ranked, originals, ["file_path", "chunk_index", "text"], ["distance"]).collect()
    assert sorted((r.orig_rank, r.distance) for r in whole if r.orig_rank) == [(2, 0.4), (7, 0.1)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["# A", "## B c", "plain"]), st.lists(st.integers(0, 120), max_size=6)), max_size=8), st.integers(5, 40), st.integers(0, 12))
def test_header_chunks_by_properties(parts, size, overlap):
    """Chunks hold all units in order, each but a unit over the size fits, no chunk could have taken the next unit, and what is repeated is the end of the chunk before."""
    text = "\n".join(f"{head}\n" + "\n\n".join(f"p{i}" + "x" * n for i, n in enumerate(ps)) for head, ps in parts)
    units, places = [], []
    for s in chunk.sections(text):
        big = len(s) // 4 > size
        units += s.split("\n\n") if big else [s]
        places += [1] + [2] * s.count("\n\n") if big else [0]
    plan = chunk.packing([(len(u), p) for u, p in zip(units, places)], size, overlap)
    assert [k for _, a, b in plan for k in range(a, b)] == list(range(len(units)))
    before = None
    for at, (carried, a, b) in enumerate(plan):
        n = carried + sum(len(u) for u in units[a:b]) + 2 * (b - a - (0 if carried else 1)) if b > a else carried
        if at:
            assert carried in (0, chunk.tail_size(before, overlap)) and (carried == 0 or a == len(units) or places[a] != 2)
        if b < len(units) and places[b] != 1:
            assert n // 4 + len(units[b]) // 4 > size
        held = carried
        for k in range(a, b):
            assert not held or places[k] == 1 or k == a or held // 4 + len(units[k]) // 4 <= size
            held += len(units[k]) + (2 if held else 0)
        before = n
    if not overlap:
        assert all(c == 0 for c, _, _ in plan)


@settings(max_examples=100, deadline=None)
@given(st.text("ab .\n", max_size=300), st.integers(3, 40), st.integers(0, 2))
def test_recursive_chunks_by_properties(text, size, overlap):
    """No chunk passes the size, and chunks hold all letters of the text in order, repeating some of the chunk before at most."""
    text = "".join(chr(0x4E00 + i) if c in "ab" else c for i, c in enumerate(text))  # every letter is another
    letters = [c for c in text if c > "\u3000"]
    chunks = chunk.split_recursively(text, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    at = 0
    for c in chunks:
        mine = [x for x in c if x > "\u3000"]
        if not mine:
            continue
        begin = letters.index(mine[0])
        assert at - overlap <= begin <= at and mine == letters[begin : begin + len(mine)]
        at = max(at, begin + len(mine))
    assert at == len(letters)


def test_allocation():
    assert list(evalset.allocation(400, {"a": 0.6, "b": 0.2, "c": 0.1, "d": 0.1}).values()) == [240, 80, 40, 40]
    assert list(evalset.allocation(350, {"a": 0.5, "b": 0.3, "c": 0.2}).values()) == [175, 105, 70]


def test_noise(spark):
    for text, want in {"[1] Smith, J. (2020). Title. Journal.": "reference", "Page 23": "page_number", "© 2020 Press": "copyright", "a@b.org": "email", "http://j.org/x": "url", "Journal of Science | Volume 10": "running_head", "# 12": None, "Real text.": None}.items():
        assert one(spark, evalset.noise_reason(F.col("t")), t=text) == want


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title A\nbody")
    (tmp_path / "b.md").write_text("  \n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.md").write_text("plain")
    assert [(r.stem, r.title) for r in corpus.markdown(spark, str(tmp_path)).collect()] == [("a", "Title A")]
    assert {r.stem for r in corpus.markdown(spark, str(tmp_path), recursive=True).collect()} == {"a", "c"}
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n\n{bad\n{"a": 2}\n')
    rows = corpus.jsonl(spark, str(tmp_path / "log.jsonl"), "a int").collect()
    assert [r.a for r in rows if r._corrupt_record is None] == [1, 2]
    corpus.append_jsonl(spark.range(2), str(tmp_path / "out"), gzip=True)
    assert corpus.json_document(spark, str(tmp_path / "out"), "id long").count() >= 1
    col = spark.createDataFrame([("p", "x", [1.0]), ("p", "x", [1.0]), ("q", "y", [2.0])], "collection string, chunk_id string, v array<double>")
    corpus.write_collection(col, str(tmp_path / "vec"))
    assert corpus.collection(spark, str(tmp_path / "vec"), "p").count() == 1


def test_config():
    assert corpus.resolve({"a": {"b": "x"}, "p": "${a.b}/y", "q": ["${p}/z", "${no.such}"]})["q"] == ["x/y/z", "${no.such}"]


def test_models(spark):
    from lodestone.operators import models

    d = spark.createDataFrame([(1, "red fox"), (2, None)], "id long, text string")
    v = {r.id: r.v for r in d.select("id", models.embed(F.col("text")).alias("v")).collect()}
    assert len(v[1]) == 64 and sum(x * x for x in v[1]) == pytest.approx(1, abs=1e-6) and not any(v[2])

    def broken():
        def run(pairs):
            raise ValueError

        return run

    rows = cands(spark, ["a", "b"])
    assert {r.method for r in rerank.rerank(rows, 2, lambda q, t: models.score(q, t, broken)).collect()} == {"fallback"}
    ctx = spark.createDataFrame([(1, "red fox", "The red fox ran. Cats sleep. A fox is red. Dogs bark.")], "query_id long, query string, context string")
    got = {r.temperature: r.answer for r in models.generate(ctx, (0.0, 1.0), 2).collect()}
    assert got == {0.0: "The red fox ran. A fox is red.", 1.0: "Cats sleep. Dogs bark."}


def test_summaries(spark):
    from lodestone.operators import models

    long = "\n".join(f"# Part {i}\nSentence one of {i}. " + "More words here. " * 40 for i in range(30))
    d = spark.createDataFrame([(1, long), (2, "Short. Text. Here."), (3, "x " * 20000)], "k long, text string")
    got = {r.k: r for r in models.summarise(d, "k", "text", budget=300, size=200, overlap=10).collect()}
    assert got[2].summary == "Short. Text." and got[2].rounds == 0 and got[1].rounds >= 1 and set(got) == {1, 2, 3}
    assert all(len(r.summary) // 4 <= 300 for r in got.values())


def test_answer(spark):
    from lodestone.plans.answer import answer

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["The red fox jumped over the lazy dog in the yard.", "Blue whales sing long songs in the deep sea.", "Stones are hard."])], "doc_id long, text string")
    q = spark.createDataFrame([(1, "red fox jumped"), (2, " ")], "query_id long, query string")
    got = answer(q, docs).collect()
    assert len(got) == 1 and "red fox" in got[0].answer and got[0].grounding_ratio > 0


def test_streams_twice(spark, tmp_path):
    """Files that come later join what was said before; the fold's state goes on."""
    from lodestone.streaming import events as S

    schema = "conversation_id long, seq int, type string, payload string"
    for n, rows in enumerate([[(1, 1, "token", "He"), (2, 1, "token", "x")], [(1, 2, "token", "llo"), (1, 3, "done", None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    stream = S.read(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], schema).schema)
    got = {r.conversation_id: (r.answer, r.done) for r in S.drain_latest(S.token_state(stream), "conversation_id").collect()}
    assert got == {1: ("Hello", 1), 2: ("x", 0)}


def test_late_rows_and_streams_joined(spark, tmp_path):
    """Four files, one a batch: a row behind the watermark is dropped, one within it counts, a window goes out once it is passed; a start without its end goes out when none can come."""
    from lodestone.streaming import events as S

    schema = "event_id long, ts timestamp, event_type string, value double"
    batches = [["10:01", "10:50"], ["10:45", "12:00"], ["11:55"], ["10:30", "14:00"]]
    for n, times in enumerate(batches):
        rows = [(10 * n + i, f"2024-01-01 {t}:00") for i, t in enumerate(times)]
        spark.createDataFrame(rows, "event_id long, t string").selectExpr("event_id", "cast(t as timestamp) as ts", "'a' as event_type", "1.0D as value").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    stream = lambda: S.read(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], schema).schema)
    got = {str(r.start)[11:16]: r.n for r in S.drain(S.windows(stream(), "1 hour")).collect()}
    assert got == {"10:00": 3, "11:00": 1, "12:00": 1}
    starts = stream().where("event_id in (0, 1, 10, 31)").selectExpr("event_id as id", "ts")
    ends = stream().where("event_id in (10, 20, 31)").selectExpr("if(event_id = 31, 31, event_id - 10) as done_id", "ts as done_ts")
    joined = {r.id: r.done_ts is not None for r in S.drain(S.started_and_done(starts, ends)).collect()}
    assert joined == {0: True, 1: False, 10: False, 31: True}


def test_passages_of_any_length(spark, tmp_path):
    """Hits are counted for passages of one, two, four and nine words."""
    import duckdb

    from lodestone import catalog

    texts = ["alpha beta gamma delta epsilon zeta eta theta iota kappa", "beta only", "nothing of it", "x gamma delta epsilon zeta y", "kappa"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(["kappa", "beta only", "gamma delta epsilon zeta", "beta gamma delta epsilon zeta eta theta iota kappa", "lacking words"])), "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES["retrieval_hit_rate"]).fetchone()
    got = catalog.QUERIES["retrieval_hit_rate"](spark, str(tmp_path)).first()
    assert tuple(got) == want and got.n_queries == 4


def test_sinks(spark, tmp_path):
    """Logs, checkpoints, collections, texts and evaluation sets come back as they were written."""
    log = str(tmp_path / "log")
    corpus.append_jsonl(spark.createDataFrame([(1, "old"), (2, "old")], "id long, value string"), log)
    corpus.rewrite_jsonl(spark.read.schema("id long, value string").json(log).selectExpr("id", "if(id = 2, 'new', value) as value"), log)
    assert sorted(tuple(r) for r in spark.read.schema("id long, value string").json(log).collect()) == [(1, "old"), (2, "new")]
    corpus.log_lines(spark.createDataFrame([(1, None), (2, "b")], "id long, value string"), str(tmp_path / "lines"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lines")).collect()) == ['{"id":1}', '{"id":2,"value":"b"}']
    state = str(tmp_path / "state")
    assert corpus.checkpoint(spark, state, "id long").count() == 0
    corpus.save_checkpoint(spark.range(3), state)
    assert [r.id for r in corpus.pending(spark.range(5), corpus.checkpoint(spark, state, "id long"), "id").orderBy("id").collect()] == [3, 4]
    vectors = spark.createDataFrame([("c1", "a", [1.0]), ("c1", "a", [1.0]), ("c1", "b", [2.0])], "collection string, chunk_id string, v array<double>")
    corpus.write_collection(vectors, str(tmp_path / "vectors"))
    corpus.write_collection(vectors.unionByName(spark.createDataFrame([("c2", "a", [3.0]), ("c1", "z", [4.0])], vectors.schema)), str(tmp_path / "vectors"))
    assert sorted((r.collection, r.chunk_id) for r in spark.read.parquet(str(tmp_path / "vectors")).collect()) == [("c1", "a"), ("c1", "b"), ("c1", "z"), ("c2", "a")]
    parts = spark.createDataFrame([(1, 1, "b", True), (1, 0, "a", True), (1, 2, "c", False), (2, 0, "d", False)], "doc_id long, idx int, paragraph string, kept boolean")
    corpus.write_filtered(parts, str(tmp_path / "filtered"))
    assert {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "filtered/text")).collect()} == {1: "a\n\nb", 2: ""}
    assert {(r.doc_id, r.total, r.kept, r.removed) for r in spark.read.json(str(tmp_path / "filtered/meta")).collect()} == {(1, 3, 2, 1), (2, 1, 0, 1)}
    corpus.write_triple(spark.createDataFrame([(1, "# a", '{"n": 1}', "[]")], "doc_id long, markdown string, metadata string, layout string"), str(tmp_path / "triple"))
    assert {p.name for p in (tmp_path / "triple").iterdir()} == {"markdown", "metadata", "layout"}
    corpus.write_eval_set(spark.createDataFrame([("q1", "a"), ("q2", "b"), ("q3", "a")], "question string, kind string"), str(tmp_path / "eval"), ["kind"])
    assert {(r.kind, r.n) for r in spark.read.schema("kind string, n long").json(str(tmp_path / "eval/metadata")).collect()} == {("a", 2), ("b", 1), (None, 3)}
    corpus.append_stages(spark.createDataFrame([("t", "bm25", 1.5)], "trace_id string, stage string, duration_ms double"), str(tmp_path / "stages"))
    corpus.append_stages(spark.createDataFrame([("t", "fusion", 2.5)], "trace_id string, stage string, duration_ms double"), str(tmp_path / "stages"))
    assert traces.wide(spark.read.parquet(str(tmp_path / "stages"))).select("bm25", "fusion", "rerank").first() == (1.5, 2.5, None)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.md").write_text("x")
    (tmp_path / "in" / "a.md").write_text("xyz")
    (tmp_path / "in" / "c.md").write_text("")
    assert [(r.path[-4:], r.length) for r in corpus.inputs(spark, str(tmp_path / "in"), "*.md").collect()] == [("a.md", 3), ("b.md", 1)]
    with pytest.raises(FileNotFoundError):
        corpus.inputs(spark, str(tmp_path / "nowhere"))
    assert spark.range(1).select(corpus.chunk_id(F.lit("p"), F.lit(1), F.lit(7)).alias("x")).first().x == "p_idx1_chunk7"


def test_collections_named_by_queries(spark):
    q = spark.createDataFrame([(1, "a", [1.0], 1), (2, " ", [1.0], 2)], "query_id long, query string, v array<double>, collection int")
    r = spark.createDataFrame([(1, [1.0], 1), (2, [1.5], 1), (3, [1.0], 2)], "id long, v array<double>, collection int")
    assert [(x.query_id, x.id) for x in dense.knn_in_collections(q, r, 5).orderBy("rank").collect()] == [(1, 1), (1, 2)]
    with pytest.raises(ValueError):
        dense.knn_in_collections(q.withColumn("collection", F.lit(3)), r, 5)


def test_records(spark):
    from lodestone.operators import records as R

    row = spark.sql("select array(1.00005D, 2.00015D, 3.0D) as s, map('a', 1.0D, 'b', 2.0D, 'c', 2.0D) as m, array(named_struct('title', 't', 'file_path', 'p'), named_struct('title', null, 'file_path', 'q'), named_struct('title', null, 'file_path', null)) as d")
    got = row.select(R.capped(F.col("s"), 2).alias("s"), R.top_of_map(F.col("m"), 2).alias("m"), R.display_sources(F.col("d")).alias("d"), R.zipped(F.array(F.lit("x"), F.lit("y")), F.array(F.lit(1.0))).alias("z"), R.filled("a {b} {b}", b=F.lit("c")).alias("f")).first()
    assert got.s == [1.0, 2.0002] and [tuple(x) for x in got.m] == [(2.0, "b"), (2.0, "c")] and got.d == ["t", "q", "Unknown"] and [tuple(x) for x in got.z] == [(1, "x", 1.0)] and got.f == "a c c"
    assert spark.range(1).select(R.sse_line("id").alias("x")).first().x == 'data: {"id":0}\n\n'
    for bad in ({"query": " "}, {"query": "q", "k": 101}, {"query": "q", "collection": 3}, {"query": "q" * 2001}):
        with pytest.raises(ValueError):
            R.SearchRequest(**bad)


def test_claims_keep_digits_and_lose_spaces(spark):
    """A claim whose place among the sentences begins or ends like the claim itself keeps its digits; outer spaces go."""
    t = " ".join(f"{i} is the number of this sentence {i}." for i in range(25)) + "  A last one, with spaces behind it   "
    want = [f"{i} is the number of this sentence {i}." for i in range(25)] + ["A last one, with spaces behind it"]
    assert one(spark, T.claims(F.col("t")), t=t) == want


def test_index_and_vectors_of_kept_counts_split_no_text(spark, tmp_path):
    """Out of a table of term counts come the index and the vectors that the texts give, and no text is split for them."""
    docs = spark.createDataFrame([(i, f"Document {i} tells of w{i} and of w{i % 5}.") for i in range(30)], "doc_id long, text string")
    bm25.term_counts(docs).write.parquet(str(tmp_path / "c"))
    counts = spark.read.parquet(str(tmp_path / "c"))
    rows = lambda x: sorted(map(str, x.collect()))
    made, anew = bm25.build(docs, markdown=False, counts=counts), bm25.build(docs, markdown=False)
    for name in ("postings", "docs", "terms", "corpus"):
        assert "split(" not in getattr(made, name)._jdf.queryExecution().optimizedPlan().toString()
        assert rows(getattr(made, name)) == rows(getattr(anew, name))
    assert rows(dense.hashed_vectors(docs, counts=counts)) == rows(dense.hashed_vectors(docs))


def test_hit_rate_makes_windows_once(spark, sf):
    """The documents that hold a passage are found once and kept: no later use hashes windows anew."""
    from lodestone import catalog

    plan = catalog.QUERIES["retrieval_hit_rate"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" not in plan
