"""Small fixtures against brute force for every operator of the llm package: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import json
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

pytest.importorskip("lodestone.llm")
from lodestone.llm import ann, bpe, deepshallow, langid, licenses, mixing, pii, quality, quotes, simhash, substrings  # noqa: E402
from lodestone.llm.components import components  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, size string, key int"


def docs_of(spark, rows):
    """Rows (doc_id, text[, lang, source]) with two extra columns whose names clash with the operators' own."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), "x", 1) for r in rows]
    return spark.createDataFrame(full, DOC)


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "river", "stone", "walked", "bright", "under", "song", "to"]) + rng.choice(["", "s", "ed", "ing", str(rng.randint(0, 9))]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(1, 120))) for i in range(40)]
    rows += [(40, rows[3][1]), (41, rows[3][1] + " tail"), (41, rows[3][1] + " tail"), (42, None), (43, ""), (44, " \n\t "), (45, "a b c"), (None, rows[5][1]), (46, prose(rng, 30_000)), (47, "é漢 " * 50 + "\n" + "x" * 5000)]
    return rows


@pytest.mark.parametrize("window_hash", [quality.WINDOW_HASH, "5L", "xxhash64(length(_w[i]))"])
def test_quality_counts(spark, corpus, window_hash):
    """Whatever the windows' hashes: all windows of a text may share one."""
    want = []
    for i, t in corpus:
        t = t or ""
        w = WORD.findall(t)
        c = Counter(zip(w, w[1:], w[2:]))
        at = {k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        n = len(w)
        want.append((-1 if i is None else i, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(at), n < 50 or 100 * len(at) > 50 * n))
    judged = quality.judge(docs_of(spark, corpus), window_hash=window_hash).select("row.doc_id", *[f"quality.{c}" for c in (*quality.COUNTS, "base_failed")])
    assert sorted(tuple(r) for r in judged.fillna(-1).collect()) == sorted(want)


def test_quality_of_a_very_long_text(spark):
    """Four million different words: where two windows share a shortened hash, the words decide."""
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.array_join(F.sequence(F.lit(0), F.lit(3_999_999)), " ").alias("text"))
    r = quality.judge(docs).select("quality.n_words", "quality.n_repeat_words").first()
    assert (r.n_words, r.n_repeat_words) == (4_000_000, 0)


def test_quality_empty_and_rules(spark):
    assert quality.judge(docs_of(spark, [])).count() == 0
    clash = docs_of(spark, [(1, "a b"), (2, None)]).selectExpr("*", "1 n_words", "2 _w", "3 kept", "4 row", "5 quality", "6 n_symbols", "7 `a.b`")
    got = quality.judge(clash, keep=tuple(clash.columns)).select("row.*").collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in clash.collect())
    good = ("The river is wide and the stone bridge of the old town is long . " * 1 + " ".join(f"word{i} of the place{i}" for i in range(20)))
    rows = [(1, good), (2, " ".join(f"wo{i}%%% the### of$$$" for i in range(40))), (3, good.upper().replace(" ", "!! "))]
    kept = {r.row.doc_id: r.quality.kept for r in quality.judge(docs_of(spark, rows)).collect()}
    assert kept == {1: True, 2: False, 3: False}


def fp_of(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(nodes, linked):
    par = {n: n for n in nodes}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(spark, corpus):
    rows = [r for r in corpus if r[0] is not None]
    got = {(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs_of(spark, rows)).collect()}
    fps = [(i, fp_of(t)) for i, t in rows]
    links = [(a, b) for a, x in fps for b, y in fps if (x ^ y).bit_count() <= 4]
    comp = closure({i for i, _ in fps}, links)
    assert got == {(i, f, comp[i]) for i, f in fps}
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [4096, 20, 3])
def test_pigeonring_chains_lose_no_link(spark, limit):
    rng = np.random.default_rng(limit)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = list(base)
    for b in base:
        for _ in range(4):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            fps.append(np.uint64(x))
    fps = np.unique(np.array(fps, dtype=np.uint64))
    signed = [int(x) for x in fps.view(np.int64)]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), limit)
    got = {r.node: r.label for r in components(edges).collect()}
    linked = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    assert {n: got.get(n, n) for n in signed} == closure(signed, linked)


def test_crowded_buckets_give_spanning_links(spark):
    """All pairs of a cluster link, yet the links grow with its size, at every depth of the chains."""
    flips = [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i in range(64) for j in range(i))]
    fps = np.array([0x0123456789ABCDEF ^ x for x in flips], dtype=np.uint64)
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for limit in (4096, 500, 3):
        edges = simhash.links(nodes, limit).cache()
        assert edges.count() < 20 * len(fps)
        got = components(edges)
        assert got.count() == len(fps) and got.select("label").distinct().count() == 1


def test_components_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def test_components_of_a_long_chain(spark):
    """Many rounds: each must plan as fast as the first."""
    at = list(range(3000))
    random.Random(3).shuffle(at)
    edges = spark.createDataFrame(list(zip(at, at[1:])), "a long, b long")
    got = components(edges)
    assert got.count() == 3000 and [r.label for r in got.select("label").distinct().collect()] == [0]


def spans_of(t):
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0

    def ok(k, m):
        d = re.sub("[^0-9]", "", m)
        return k == "email" or k == "ip" and all(int(x) <= 255 for x in m.split(".")) or k == "card" and 16 <= len(d) <= 19 and luhn(d) or k == "phone" and 8 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in pats.items() for m in re.finditer(p, t) if ok(k, m.group())]


PRIVATE = [
    "a@b.com_x@d.org é a@@b.c@d.e", "1.2.3.4.5.6.7.8 0001.2.3.255 1.2.3.256 " + "1." * 3000, "4111 1111-1111 1111 x 4111111111111111 " + "1 " * 9000,
    "+1 (2) 3-4.5 6 7 8 +49 89 1234567-+1", "a" * 20000 + "@b.c" + ".c" * 9000, "😀 x@y.zz 😀+12345678", 'token = "' + "0a1b2c3d4e" * 4 + '" then', None, "",
]


def test_pii_base_and_secret(spark):
    rows = [(i, t) for i, t in enumerate(PRIVATE)] + [(0, PRIVATE[0])]
    secrets = [(100 + i, f'word token = "{hashlib.sha1(bytes([i])).hexdigest()}" more') for i in range(12)]
    plain = [(200 + i, f"see chapter{i} of_the_long_identifier_number_{i} here") for i in range(12)]
    got = pii.detect(docs_of(spark, rows + secrets + plain)).collect()
    for r in got:
        t = dict(rows + secrets + plain)[r.doc_id] or ""
        assert [tuple(s) for s in r.base] == spans_of(t)
    added = {r.doc_id: [tuple(s) for s in r.added] for r in got}
    assert all(added[100 + i] == [("secret", 14, 54)] for i in range(12))
    assert not any(added[200 + i] for i in range(12))
    assert pii.detect(docs_of(spark, [])).count() == 0
    # Found by two patterns, given in the order of the text: the announced secret stands before the long one.
    both = [(i, f"password = Ab12cd9x and then token: {hashlib.sha1(bytes([i])).hexdigest()} end") for i in range(12)]
    assert all([tuple(s) for s in r.added] == [("secret", 11, 19), ("secret", 36, 76)] for r in pii.detect(docs_of(spark, both + plain)).collect() if r.doc_id < 12)


def test_redact(spark):
    d = pii.redact(docs_of(spark, [(1, "mail a@b.com or 1.2.3.4"), (2, None), (3, "nothing")]))
    assert {r.doc_id: r.text for r in d.collect()} == {1: "mail [email] or [ip]", 2: None, 3: "nothing"}
    assert {r.doc_id: r.n_chars for r in d.collect()} == {1: 20, 2: 0, 3: 7}


def test_redact_unites_overlaps_and_keeps_columns(spark):
    long = "é" * 700 + " a@b.com " + "😀" * 1300 + " 1.2.3.4"
    rows = [(1, "+49 30 1234567.anna@example.org and"), (2, long), (3, None), (4, "a@b.com")]
    docs = docs_of(spark, rows).selectExpr("*", "1 found", "2 base", "3 _t", "4 _s", "5 row", "6 t", "7 u", "8 cells", "9 s", "1 `x.y`")
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[1].text == "[phone] and" and got[2].text == "é" * 700 + " [email] " + "😀" * 1300 + " [ip]" and got[3].text is None and got[4].text == "[email]"
    assert pii.redact(docs).columns == docs.columns and (got[2].cells, got[2]["x.y"], got[2].n_chars) == (8, 1, len(got[2].text))
    assert pii.redact(docs_of(spark, [])).count() == 0


def test_many_matches_in_one_text(spark):
    n = 200_000
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("u"), i.cast("string"), F.lit("@b.co"))), " ").alias("text"))
    began = time.time()
    r = pii.detect(docs).select(F.size("base").alias("n"), F.element_at("base", -1).alias("last"), F.size("added").alias("a")).first()
    end = sum(len(f"u{i}@b.co") + 1 for i in range(1, n + 1)) - 1
    assert (r.n, r.last.start, r.last.end, r.a) == (n, end - len(f"u{n}@b.co"), end, 0)
    assert pii.redact(docs).select(F.md5(F.col("text").cast("binary")).alias("h")).first().h == hashlib.md5(" ".join(["[email]"] * n).encode()).hexdigest()
    assert time.time() - began < 60


def test_secrets_of_any_length(spark):
    """600 and 100,000 characters, after a bare sign too, and short ones that are announced."""
    hexes = lambda seed, n: "".join(hashlib.sha1(f"{seed}:{i}".encode()).hexdigest() for i in range(n // 40 + 1))[:n]
    secrets = [hexes(i, n) for i, n in enumerate((40, 64, 600, 100_000))]
    rows = [(10 * i + j, t.format(v)) for i, v in enumerate(secrets) for j, t in enumerate(('token = "{}" then', "api_key={} then", "secret: {}"))]
    rows += [(100 + i, f"password = {q}hunter{i}abc{q} and more") for i, q in enumerate(("'", '"', ""))]
    rows += [(200 + i, f"the word secret has no value here, {w} neither") for i, w in enumerate(("password", "token", "a secret: yes"))]
    got = {r.doc_id: [(s.kind, dict(rows)[r.doc_id][s.start : s.end]) for s in r.added] for r in pii.detect(docs_of(spark, rows)).collect()}
    for i, v in enumerate(secrets):
        assert all(got[10 * i + j] == [("secret", v)] for j in range(3))
    assert [got[100 + i] for i in range(3)] == [[("secret", f"hunter{i}abc")] for i in range(3)]
    assert not any(got[200 + i] for i in range(3))


def test_votes_and_classifier_against_plain_version(spark):
    """EM and naive Bayes over candidates, by a loop over single candidates instead of counts of patterns."""
    rng = random.Random(6)
    cands = [(hashlib.sha1(str(i).encode()).hexdigest(), rng.choice(['token = "', "key: ", "see "]), '" x') for i in range(300)]
    cands += [(f"plain_identifier_of_chapter{i}", rng.choice(["see ", "in ", "name = "]), " x") for i in range(200)]
    frame = spark.createDataFrame(cands, "value string, before string, after string")
    v, b, a = F.col("value"), F.col("before"), F.col("after")
    seen = frame.select(F.array(*pii.labelers(v, b, a).values()).alias("votes"), F.struct(*[x.alias(k) for k, x in pii.features(v, b, a).items()]).alias("f"), pii.train(frame)(v, b, a).alias("p")).collect()
    n, share = 5, 0.5
    yes, no = [{1: 0.7, 0: 0.2, -1: 0.1} for _ in range(n)], [{1: 0.1, 0: 0.4, -1: 0.5} for _ in range(n)]

    def chance(votes):
        x, y = share, 1 - share
        for i, z in enumerate(votes):
            x, y = x * yes[i][z], y * no[i][z]
        return x / (x + y)

    for _ in range(50):
        post = [chance(r.votes) for r in seen]
        share = (sum(post) + 1) / (len(seen) + 2)
        yes, no = ([{z: (sum(w for w, r in zip(ws, seen) if r.votes[i] == z) + 1) / (sum(ws) + 3) for z in (-1, 0, 1)} for i in range(n)] for ws in (post, [1 - x for x in post]))
    post = [chance(r.votes) for r in seen]
    one, none = sum(post), len(seen) - sum(post)
    for r in seen:
        odds = np.log((one + 1) / (none + 1))
        for k in r.f.asDict():
            values = {x.f[k] for x in seen}
            same = [x.f[k] == r.f[k] for x in seen]
            odds += np.log((sum(w for w, s in zip(post, same) if s) + 0.5) / (one + 0.5 * len(values))) - np.log((sum(1 - w for w, s in zip(post, same) if s) + 0.5) / (none + 0.5 * len(values)))
        assert r.p == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-6)


def test_mixing(spark, corpus):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(0, 60)), "en", rng.choice(["a", "b", "b", "b", "c", None, "é"])) for i in range(600)] + [(9, None, "en", "a"), (None, "x y", None, "c")]
    got = mixing.copies(docs_of(spark, rows)).collect()
    size = lambda t: len(WORD.findall(t or ""))
    total = Counter()
    for r in rows:
        total[r[3]] += size(r[1])
    names = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(total.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            free.remove(s)
    target |= {s: level * weight[s] for s in free}
    assert len(got) == len(rows)
    source = {r[0]: r[3] for r in rows if r[0] is not None and r[0] != 9}
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        if r.doc_id in source:
            s = source[r.doc_id]
            assert r.target == pytest.approx(target[s]) and r.source_size == total[s]
            taken[s] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 62 + 120  # one document's words, and the rows left out above
    again = mixing.copies(docs_of(spark, rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.copies(docs_of(spark, [])).count() == 0


def test_mixing_is_unbiased(spark):
    rows = spark.range(4000).selectExpr("1 as part", "4000L as n", "xxhash64(id) as h", "id as uid", "1.0D + id % 7 as size", "0.3D as p")
    up = mixing.round_copies(rows, 4000).groupBy("up").count().collect()
    assert {r.up for r in up} == {0, 1} and abs(sum(r["count"] for r in up if r.up) - 1200) < 60


@pytest.mark.parametrize("name", ["0.001", "0.01"])
def test_mixing_comes_near_every_target(spark, name):
    """Every source, also one of ten documents, within 1 % of its target or within the words of its smallest document."""
    sf = f"/root/testdata/sf{name}"
    sources = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    got = mixing.op5_mix_sources(spark, sf).join(sources, "doc_id").groupBy("source")
    for r in got.agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.min("size").alias("least")).collect():
        assert abs(r.taken - r.target) <= max(0.01 * r.target, r.least)


def test_mixing_spreads_equal_rows(spark):
    """100,000 equal rows: exact counts, no bucket of the tree holds them, and the rows taken do not depend on the partitions."""
    docs = spark.range(100_000).selectExpr("cast(null as bigint) as doc_id", "'a b c' as text", "'s' as source").unionByName(spark.range(500).selectExpr("id as doc_id", "repeat('w ', cast(id % 9 as int)) as text", "if(id % 2 = 0, 's', 't') as source"))
    got = mixing.copies(docs.repartition(6))
    total = got.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(total) == 2 and all(abs(r.taken - r.target) <= 9 for r in total)
    tally = lambda d: sorted(map(str, d.groupBy("doc_id", "size", "taken").count().collect()))
    assert tally(got) == tally(mixing.copies(docs.repartition(3)))


def test_bpe_join_is_exact():
    tok = bpe.load(bpe.tokenizer_path())
    rng = random.Random(5)
    kinds = [list("abcdefgh"), list("ab '!sret 12é"), ["a"], ["!", "'"], ["<|endoftext|>", "the", " ", "é", "漢字", "😀", "́", "Σ", "İ", "'re", "'l"], ["th", "ing", "er"]]
    for i in range(60):
        s = "".join(rng.choice(kinds[i % 6]) for _ in range(rng.randint(200, 2500)))
        k = rng.randint(50, 700)
        one = bpe.join_tree(tok, [bpe.Part.of(tok, s[j : j + k]) for j in range(0, len(s), k)])
        assert one.ids.tolist() == tok.encode(s, add_special_tokens=False).ids


def test_bpe_pieces_are_exact():
    tok = bpe.load(bpe.tokenizer_path())
    assert bpe.Pieces.fits(tok)
    other = json.loads(tok.to_str())
    other["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] += "|,\\s"
    assert not bpe.Pieces.fits(Tokenizer.from_str(json.dumps(other)))
    rng = random.Random(4)
    al = ["th", "E", ",", ".", "'s", " ", "\n", "\t", "İ", "é", "é", "Å", "!", "12", "漢", "<|endoftext|>", "<|ENDOFTEXT|>", "ß", "Σ", "\xa0", "\x1c", "'re", "ǅ"]
    pieces = bpe.Pieces(tok, most=50)
    texts = ["".join(rng.choice(al) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    for i in range(0, 600, 60):
        for t, (ids, decoded) in zip(texts[i:], pieces.encode(texts[i : i + 60])):
            a, b = pieces.part(t), bpe.Part.of(tok, t)
            assert all((getattr(a, c) == getattr(b, c)).all() for c in ("ids", "at", "end")) and (a.borders() == b.borders()).all()
            want = tok.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want and decoded == tok.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("deal", [0, 5000, bpe.DEAL])
def test_bpe_query_form(spark, corpus, deal):
    """Blocks joined in one task, dealt over all, and some of each."""
    tok = bpe.load(bpe.tokenizer_path())
    got = sorted(map(str, bpe.encode(docs_of(spark, corpus), bpe.tokenizer_path(), block=700, deal=deal).collect()))
    want = []
    for i, t in corpus:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        d = hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        want.append(f"Row(doc_id={i}, n_tokens={len(ids)}, ids_sha256='{hashlib.sha256(np.array(ids, '<u4').tobytes()).hexdigest()}', decoded_sha256='{d}', ids={ids})")
    assert got == sorted(want)
    assert bpe.encode(docs_of(spark, []), bpe.tokenizer_path()).count() == 0


def test_deepshallow_sort():
    rng = random.Random(2)
    for _ in range(80):
        al = rng.choice([b"ab", b"abcdefgh"])
        st = [bytes(rng.choice(al) for _ in range(50)) for _ in range(rng.randint(0, 50))]
        st = [rng.choice(st)[: rng.randint(10, 50)].ljust(50, b"a") if rng.random() < 0.5 else x for x in st]
        rows = np.frombuffer(b"".join(st), np.uint8).reshape(-1, 50) if st else np.zeros((0, 50), np.uint8)
        order, first = deepshallow.sort(rows)
        got = [st[i] for i in order]
        assert got == sorted(st) and list(first) == [i == 0 or got[i] != got[i - 1] for i in range(len(got))]


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    for m, most in ((0, 3), (1, 3), (5000, 3), (20_000, 2**40)):
        chars = rng.integers(0, most, (m, 2), dtype=np.uint64)
        order, first = deepshallow.multikey(chars)
        want = sorted(map(tuple, chars.tolist()))
        assert [tuple(x) for x in chars[order].tolist()] == want
        assert first.tolist() == [i == 0 or want[i] != want[i - 1] for i in range(m)]


def removed(rows):
    first, enc = {}, [((1 << 63) if i is None else i, i, (t or "").encode()) for i, t in rows]
    for v, _, b in enc:
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(v, first.get(b[p : p + 50], v))
    out = []
    for v, i, b in enc:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < v:
                gone[p : p + 50] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("how", [{}, {"hot_at": 0, "pack_bytes": 500}, {"hot_at": 2, "pack_bytes": 2000, "class_limit": 2, "bucket_bytes": 4000}])
def test_repeated_substrings(spark, how):
    rng = random.Random(3)
    base = ["lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore", "a" * 300, "The " * 60, "", "é漢" * 40]
    rows = [(i, rng.choice(base)[rng.randint(0, 20) : rng.randint(40, 300)] + rng.choice(["", f" x é{i} "]) + rng.choice(base)) for i in range(60)]
    rows += [(None, base[0]), (None, base[0]), (7, base[0] * 2), (100, None), (101, base[0][:49]), (102, base[0][:50])]
    rng.shuffle(rows)
    got = sorted((tuple(r) for r in substrings.remove_repeats(docs_of(spark, rows), **how).collect()), key=str)
    assert got == removed(rows)


def test_repeated_substrings_of_nothing(spark):
    assert substrings.remove_repeats(docs_of(spark, [])).count() == 0


def test_repeats_of_one_anchor_in_one_pack(spark):
    """One passage 200,000 times in one text, each time beside other digits, is worked through in bounded parts."""
    passage = "the quick brown fox jumps over the lazy dog and runs far away from it "
    text = "".join(f"{passage}{i:07d}" for i in range(200_000))
    rows = [(1, text), (2, text), (3, "x" * 60 + passage + "y" * 60), (4, None)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in substrings.remove_repeats(docs_of(spark, rows)).collect()}
    size = len(text)
    assert got == {1: (size, 0, 0), 2: (size, size, 1), 3: (120 + len(passage), len(passage), 1), 4: (0, 0, 0)}


def test_language_id(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = langid.train(docs.where(langid.fold() != 1).select("doc_id", "text", "lang"))
    extra = docs_of(spark, [(-1, None), (-2, ""), (-3, "12 34 %"), (-4, "é" * 200_000)])
    odd = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(extra, learned).collect()}
    assert odd[-1] == odd[-2] == odd[-3] == ("und", 0.0) and odd[-4][0] in learned
    got = langid.identify(docs, learned).join(docs.select("doc_id", "lang"), "doc_id").where(langid.fold() == 1).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.train(docs_of(spark, []).select("doc_id", "text", "lang")) == {}
    assert {r.lang_pred for r in langid.identify(extra, {}).collect()} == {"und"}


def clustered(rng, n, d=32, centres=100):
    x = rng.standard_normal((centres, d))[rng.integers(0, centres, n)] + 0.4 * rng.standard_normal((n, d))
    return x * rng.uniform(0.9, 1.1, (n, 1))


@pytest.mark.parametrize(("kind", "share"), [("clustered", 0.4), ("isotropic", 0.95)])
def test_forest_recall(kind, share):
    """The rows compared, not only the answers, show that the ascent ends by itself."""
    rng = np.random.default_rng(3)
    x = clustered(rng, 16_384) if kind == "clustered" else rng.standard_normal((16_384, 32))
    q, k = x[::400], 20
    best = np.argsort(-(q @ x.T), axis=1)[:, :k]
    hits = compared = 0
    for i, rows, product in ann.nearest(x, q, k):
        hits += len(set(rows.tolist()) & set(best[i].tolist()))
        compared += len(rows)
        assert np.allclose(product, x[rows] @ q[i])
    assert hits / (k * len(q)) >= 0.9 and compared / (len(q) * len(x)) < share


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(8)
    v = clustered(rng, 4000)
    rows = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(rows, "vec_id % 20 = 0", index_block=1000, query_block=80).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    s = v @ v.T
    hits = 0
    for q in range(0, 4000, 20):
        s[q, q] = -np.inf
        assert [x for x, _ in sorted(got[q])] == list(range(1, 21))
        hits += len({x for _, x in got[q]} & set(np.argsort(-s[q])[:20].tolist()))
    assert hits / (20 * len(got)) >= 0.9


def test_language_id_against_plain_version(spark):
    """Every answer is the language whose dictionary gives the fewest bytes over all blocks of the text's letters, by a loop over texts."""
    import zstandard as z

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learned = langid.train(docs.where(langid.fold() != 1).select("doc_id", "text", "lang"))
    assert all(0 < len(x) <= 65536 for x in learned.values()) and len(learned) > 1
    coders = {}
    for lang, content in learned.items():
        params = z.ZstdCompressionParameters.from_level(9, write_content_size=0, write_checksum=0, write_dict_id=0)
        coders[lang] = z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params)
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, learned).collect()}
    for r in docs.collect():
        data = "".join(c if c.isalpha() else " " for c in (r.text or "").lower())
        data = re.sub(" +", " ", data).encode()
        if not data.strip():
            assert got[r.doc_id] == "und"
            continue
        sizes = {k: sum(len(c.compress(data[i : i + 4096])) for i in range(0, len(data), 4096)) for k, c in coders.items()}
        assert sizes[got[r.doc_id]] == min(sizes.values())


def test_dictionaries_reach_all_parts_of_texts(spark):
    """A language whose texts open alike is learned from what follows, too."""
    rows = [(i, "opening words that all of these texts share " * 60 + f"ending{chr(97 + i)} " * 40, "xx") for i in range(20)]
    learned = langid.train(docs_of(spark, rows).select("doc_id", "text", "lang"))["xx"].decode()
    assert all(f"ending{chr(97 + i)}"[:5] in learned for i in range(20)) and "opening words" in learned


def test_nearest(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((700, 16)) * rng.uniform(0.5, 2, (700, 1))
    v[100:140] = v[100]
    rows = [(i, [float(x) for x in y], i) for i, y in enumerate(v)] + [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] * 16, 0), (1060, [1.0], 0), (1080, [None] * 16, 0), (20, [float(x) + 9 for x in v[20]], 1), (20, [float(x) for x in v[20]], 1), (20, None, 1)]
    v[20] = min(v[20].tolist(), (v[20] + 9).tolist())
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int"), "vec_id % 20 = 0").collect()
    s = v @ v.T
    hits = 0
    for q in range(0, 700, 20):
        want = sorted((-s[q, j], j) for j in range(700) if j != q)[:20]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 21))
        hits += len({j for _, j in want} & {j for _, j, _ in mine})
        for _, j, x in mine:
            assert x == pytest.approx(s[q, j], abs=1e-9)
    assert hits / (35 * 20) > 0.9 and {r.query_id for r in got} == set(range(0, 700, 20))
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id % 20 = 0").count() == 0


def test_licences(spark):
    rows = [
        ("a/b/c/x.txt", "foo\nLicensed under the Apache License, Version 2.0.\nbar", False), ("a/b/c/y.txt", "nothing", False), ("a/b/LICENSE", "Released under the MIT License.", True), ("a/z.txt", None, False),
        ("a/b/d/w.txt", "", False), (None, "Released under the MIT License.", False), ("top.txt", "no", None), ("a/b/c/q.txt", "copyright of things that nobody wrote down before", False), ("a/b/c/y.txt", "nothing", False),
    ]
    got = sorted((str(r.path), r.licence, r.how, r.inherited_from) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string, is_licence_file boolean")).collect())
    assert got == sorted(
        [("a/b/c/x.txt", "Apache-2.0", "header", None), ("a/b/c/y.txt", "MIT", "inherited", "a/b"), ("a/b/c/y.txt", "MIT", "inherited", "a/b"), ("a/b/LICENSE", "MIT", "header", None), ("a/z.txt", None, "none", None),
         ("a/b/d/w.txt", "MIT", "inherited", "a/b"), ("None", "MIT", "header", None), ("top.txt", None, "none", None), ("a/b/c/q.txt", "MIT", "inherited", "a/b")], key=str
    )
    assert licenses.scan(spark.createDataFrame([], "path string, text string, is_licence_file boolean")).count() == 0


def test_licence_files_notices_and_tags(spark):
    texts, note = licenses.TEXTS, licenses.NOTICES
    code = "\nint main() { return 0; }\n"
    want = {f"t/{k}/LICENSE": (v, k) for k, v in texts.items()}
    want |= {f"n/{k}.c": ("Copyright 2020 Some Body\n" + v + code, k) for k, v in note.items()}
    want |= {f"s/{k}.c": (f"// SPDX-License-Identifier: {k}{e}" + code, k) for k, e in (("MIT", ""), ("GPL-3.0", "-or-later"), ("LGPL-2.1", "-only"))}
    want |= {"m/COPYING.txt": ("Copyright (c) 2021 Jane Doe\n\n" + texts["MIT"], "MIT"), "m/x.c": (code, "MIT"), "z/x.c": ("// SPDX-License-Identifier: Zlib" + code, None)}
    rows = [(p, t, False) for p, (t, _) in want.items()]
    got = licenses.scan(spark.createDataFrame(rows, "path string, text string, is_licence_file boolean")).collect()
    assert {r.path: r.licence for r in got} == {p: k for p, (_, k) in want.items()}


MESSAGES = "conv_id long, turn long, role string, text string, uid string"


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there.\n\nHow do I build\nthe thing?", "x"), (1, 1, "assistant", "> How do I build the\n> thing?\nRun make.", "x"), (1, 2, "user", "On Monday, Al wrote:\n> > how do I BUILD the thing?\n> Run make.\n\nThanks!", "x"),
        (1, 3, "user", "> never said\nok", "x"), (2, 5, "user", None, "x"), (2, 6, "user", "", "x"), (None, None, None, "> a\nb", "x"), (1, 3, "user", "> never said\nok", "x"),
        (3, 0, "user", "On Friday, the poet wrote:\r\nnothing\u0001 at all", "x"), (3, 1, "user", "On Friday, Al wrote:\n\n> nothing\u0001 at all\nyes", "x"),
    ]
    got = sorted((str(r.conv_id), str(r.turn), r.reply_to, r.n_quotes, r.n_linked, r.body) for r in quotes.link(spark.createDataFrame(rows, MESSAGES)).collect())
    assert got == sorted(
        [("1", "0", None, 0, 0, "Hello there.\n\nHow do I build\nthe thing?"), ("1", "1", 0, 1, 1, "Run make."), ("1", "2", 1, 2, 2, "Thanks!"), ("1", "3", 2, 1, 0, "ok"), ("1", "3", 2, 1, 0, "ok"), ("2", "5", None, 0, 0, ""), ("2", "6", 5, 0, 0, ""), ("None", "None", None, 1, 0, "b"),
         ("3", "0", None, 0, 0, "On Friday, the poet wrote:\nnothing\u0001 at all"), ("3", "1", 0, 1, 0, "yes")]
    )
    assert quotes.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_threads_and_reply_order(spark):
    """Every message's thread and depth by a plain walk, and answers after what they answer in the conversations built."""
    rng = random.Random(4)
    rows = []
    for c in range(6):
        said = []
        for t in range(0, 60 if c else 300):
            if rng.random() < 0.1:
                continue
            quote = f"> {rng.choice(said)}\n" if said and rng.random() < 0.6 else ""
            said.append(f"message {c} {t} of the talk")
            rows.append((c, t, "user", quote + said[-1], "x"))
    rows += [rows[7], (None, 3, "user", "alone", "x"), (9, None, "user", "alone", "x")]
    messages = spark.createDataFrame(rows, MESSAGES)
    got = quotes.order(quotes.link(messages)).collect()
    up = {(r.conv_id, r.turn): r.reply_to for r in got}
    assert len(got) == len(rows)
    for r in got:
        at, depth = r.turn, 0
        while up[r.conv_id, at] is not None:
            at, depth = up[r.conv_id, at], depth + 1
        assert (r.thread, r.depth) == (at, depth)
    seen = set()
    for r in quotes.conversations(messages).collect():
        assert r.reply_to is None or (r.conv_id, r.reply_to) in seen
        assert ">" not in r.line.replace("<|user|>", "") and r.line.endswith(r.body + "\n")
        seen.add((r.conv_id, r.turn))
    assert quotes.conversations(spark.createDataFrame([], MESSAGES)).count() == 0


def test_written_tables_can_be_cleaned(spark):
    import os

    from lodestone.llm import common

    common.clean(spark)
    d = common.written(spark.range(3))
    path = common._written[-1].removeprefix("file:")
    assert d.count() == 3 and os.path.isdir(path)
    common.clean(spark)
    assert not os.path.exists(path) and not common._written
