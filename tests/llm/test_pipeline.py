"""The pipeline's stages, each against a plain version on its own input."""

import random
from itertools import combinations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from lodestone.llm import bpe, nearcopies, quality  # noqa: E402
from lodestone.llm.common import written  # noqa: E402
from tests.llm.test_llm import closure, fp_of, spans_of  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], "/root/testdata/sf0.001")))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "pii", "mix_sources", "bpe"]
    assert all(d.columns == COLUMNS for d in stages[:-1])


def test_quality_stage(stages):
    kept = {r.doc_id for r in quality.judge(stages[0]).where("quality.kept").select("row.doc_id").collect()}
    assert {r.doc_id for r in stages[1].collect()} == kept and 0 < len(kept) < stages[0].count()


def shingled(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near_pairs(sets, least=0.8):
    return [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]


def test_dedup_stage(stages):
    """Five words and a similarity of 0.8, as near-duplicate stages take; op7's four words and four bits bind its query alone."""
    sets = {r.doc_id: shingled(r.text) for r in stages[1].collect()}
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(set(closure(set(sets), near_pairs(sets)).values())) and stages[2].count() < len(sets)


def test_pii_stage(stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    after = {r.doc_id: r.text for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for i, t in before.items():
        assert not spans_of(after[i]) and (after[i] == t) == (not spans_of(t) and "[secret]" not in after[i])


def test_mix_and_bpe_stages(stages):
    before = {r.doc_id: r.text for r in stages[3].collect()}
    mixed = [(r.doc_id, r.text) for r in stages[4].collect()]
    assert all(before[i] == t for i, t in mixed) and len(mixed) > len(before)
    tok = bpe.load(bpe.tokenizer_path())
    got = sorted((r.doc_id, list(r.ids)) for r in stages[5].collect())
    assert got == sorted((i, tok.encode(t, add_special_tokens=False).ids) for i, t in mixed)


def test_dedup_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "q r s t u v w"), (3, None)]
    docs = written(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"))
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "None"]


def test_dedup_reaches_similarity(spark):
    rng = random.Random(5)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(200)] for _ in range(40)]
    for t in texts[:30]:  # one to seven words changed: similarity 0.95 to 0.7
        copy = list(t)
        for at in range(rng.randrange(1, 8)):
            copy[20 * at + 9] = "changed"
        texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = {i: shingled(t) for i, t in rows}
    near = near_pairs(sets)
    far = sum((fp_of(rows[a][1]) ^ fp_of(rows[b][1])).bit_count() > 4 for a, b in near)
    assert far > 3 and len(near) < 30
    docs = written(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"))
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(closure(set(sets), near).values()))


@pytest.mark.parametrize("limit", [1024, 7])
def test_crowded_buckets_lose_no_link(spark, limit):
    """A large cluster, chains of copies of copies and loners, with buckets dealt in chunks."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    base, texts = [word() for _ in range(120)], []
    for _ in range(60):
        texts.append(list(base))
        texts[-1][rng.randrange(120)] = word()
    for _ in range(4):
        chain = list(base[:60]) + [word() for _ in range(60)]
        for k in range(8):
            texts.append(list(chain))
            chain[60 + 7 * k] = word()
    texts += [[word() for _ in range(80)] for _ in range(20)] + [[], ["one"], ["one"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = {i: shingled(t) for i, t in rows}
    want = sorted(set(closure(set(sets), near_pairs(sets)).values()))
    docs = written(spark.createDataFrame(rows, "id long, text string").selectExpr("monotonically_increasing_id() as row", "id", "text"))
    kept = nearcopies.firsts(docs, limit=limit)
    assert sorted(r.id for r in docs.join(kept, "row").collect()) == want and len(want) < len(rows) - 60


def test_stages_with_clashing_columns_nulls_and_no_rows(spark):
    """Extra columns of any name ride through every stage but the last; null, empty and repeated rows and empty tables give what the docstrings say."""
    text = "the river of the old town is wide and the bridge is long . " + " ".join(f"word{i} of the place{i}" for i in range(20)) + " mail a@b.com"
    names = ["n_words", "kept", "found", "base", "_t", "_row", "row", "quality", "doc", "mix_uid", "copies", "node", "label", "s", "u"]
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0), (None, text + " tail", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"{i} as `{n}`" for i, n in enumerate(names)], "1 as `a.b`")
    for frame, kept in ((docs, 1), (docs.where("false"), 0)):
        now = written(frame)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = written(stage(spark, now, ""))
            assert now.columns == docs.columns
            if name == "pii":
                got = now.collect()
                assert len(got) == kept and all("[email]" in r.text and [r[n] for n in names] == list(range(len(names))) for r in got)
        assert corpus_pipeline.STAGES[-1][1](spark, now, "").count() == now.count()


def test_run_equals_stages(spark, stages):
    a = corpus_pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id", "ids_sha256").collect()
    assert sorted(map(tuple, a)) == sorted((r.doc_id, r.ids_sha256) for r in stages[5].collect())
    assert corpus_pipeline.ORACLE_SQL is None
