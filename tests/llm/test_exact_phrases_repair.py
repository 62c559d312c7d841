"""Exact dedup, phrase mining and conversation repair against plain versions: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("lodestone.llm")
from lodestone.llm import exact, phrases, repair  # noqa: E402

DOC = "doc_id long, text string, lang string, row int, dedup string"


def docs_of(spark, rows):
    """Rows (doc_id, text[, lang]) with two columns that bear the operators' own names."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", 7, "x") for r in rows], DOC)


def plain_groups(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    groups = {}
    for r, t in zip(rows, norm):
        groups.setdefault(t, []).append(r[0])
    return [(r[0], min(groups[t], key=lambda x: (x is None, x or 0)), len(groups[t]), t) for r, t in zip(rows, norm)]


@pytest.mark.parametrize(("prefix", "slots"), [(exact.PREFIX, exact.SLOTS), (1, 64), (4, 64)])
def test_refine(spark, prefix, slots):
    """Also where nearly all pairs of length and prefix share a slot, and where prefixes say little."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 6))) for _ in range(120)]
    rows = list(enumerate(texts)) + [(200, None), (201, ""), (202, " \t"), (203, "\x0b"), (None, "ab"), (None, None), (204, "é "), (205, "é "), (206, "x" * 300_000), (207, "x" * 300_000), (208, "x" * 299_999 + "y")]
    got = exact.refine(docs_of(spark, rows), keep=("doc_id", "row", "text"), prefix=prefix, slots=slots)
    out = [(r.row.doc_id, r.dedup.keep_id, r.dedup.group_size, re.sub(r"[\x20\x09-\x0D]+", " ", r.row.text or "")) for r in got.collect()]
    assert sorted(map(str, out)) == sorted(map(str, plain_groups(rows)))
    kept = got.where("dedup.kept").collect()
    assert sorted(str(r.row.doc_id) for r in kept) == sorted({str(x[1]) for x in plain_groups(rows)})


def test_refine_repeats_and_no_rows(spark):
    rows = [(1, "a b"), (1, "a  b"), (1, "a\nb"), (2, "a b"), (3, "c")]
    docs = docs_of(spark, rows)
    got = exact.refine(docs, keep=("doc_id",)).collect()
    assert sorted((r.row.doc_id, r.dedup.keep_id, r.dedup.group_size) for r in got) == [(1, 1, 4)] * 3 + [(2, 1, 4), (3, 3, 1)]
    assert sorted(r.row.doc_id for r in got if r.dedup.kept) == [1, 3]
    stays = exact.deduplicate(docs)
    assert stays.columns == docs.columns and sorted(r.doc_id for r in stays.collect()) == [1, 3]
    assert exact.refine(docs.limit(0)).collect() == []


def test_whole_texts_are_hashed_for_survivors_only(spark):
    """Texts alone with their length are settled without a hash; a text that shares length and prefix with another is not."""
    keys = docs_of(spark, [(1, "aaaa"), (2, "aaab"), (3, "bbbbb"), (4, "aaaa"), (5, "zz")]).select(*exact._short(exact.normalised(exact.quoted("text")), 3))
    assert sorted(r.length for r in exact.survivors(keys).collect()) == [4]
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(exact.F.sha2(exact.F.lit(""), 256).alias("h")).first().h


def plain_phrases(rows, least, first):
    f, n = Counter(), Counter()
    for r in rows:
        lang = "und" if len(r) > 2 and r[2] is None else (r[2] if len(r) > 2 else "en")
        text = re.sub("[A-Z]", lambda m: m.group().lower(), r[1] or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in found.items():
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        held = any(l == lang and len(x) > len(w) and 100 * b >= 80 * a and any(x[i : i + len(w)] == w for i in range(len(x))) for (l, x), b in found.items())
        if not held:
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:first]))


@pytest.mark.parametrize(("least", "first", "slots", "size"), [(3, 2000, 1 << 17, 1 << 20), (4, 7, 1 << 14, 13), (2, 30, 1 << 14, 200)])
def test_phrases(spark, least, first, slots, size):
    """Also in stretches of a few bytes, and with nearly every slot taken."""
    rng = random.Random(5)
    words = ["The", "river", "é漢", "x" * 40, "of", "a", "\x00", "it's", "B"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\x0b", " " * 30]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 60)), rng.choice(["en", "de", None, "und", ""])) for i in range(60)]
    rows += [(60, None, "en"), (61, "", "en"), (62, " .,! ", "fr"), (None, rows[3][1], "en"), (3, rows[3][1], rows[3][2]), (63, text(3000).replace(".", " ").replace("\n", " "), "en")]
    got = phrases.mine(docs_of(spark, rows), first=first, least=least, slots=slots, size=size)
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, least, first)


def test_phrases_of_no_rows(spark):
    assert phrases.mine(docs_of(spark, [(1, "a b a b a b a b", "en")]).limit(0), least=2).collect() == []
    assert phrases.mine(docs_of(spark, [(1, "a b", None)]), least=2).collect() == []


def test_phrase_scores_are_exact(spark):
    """Products beyond 64 bits."""
    big = 10**15 + 7
    found = spark.createDataFrame([("en", "a", 1, 3 * big), ("en", "b", 1, 2 * big), ("en", "a b", 2, big)], "lang string, phrase string, k int, n long")
    r = phrases.score(found).first()
    assert (r.a, r.l, r.r, r.score) == (big, 3 * big, 2 * big, 2_000_000 * big // (5 * big))


def plain_repair(rows):
    """rows (conv, turn, role, text) -> conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, hash); by the least (cost, letters) of each suffix."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, msgs in convs.items():
        msgs.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1], hashlib.sha256(m[2].encode()).hexdigest()))
        turns = [m[0] for m in msgs if m[0] is not None]
        kinds, seen = [], set()
        for _, role, text in msgs:
            t = text.strip(" \t\n\x0b\x0c\r")
            kinds.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
            seen.add((role, text))
        step = {"": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}
        best = {q: (0, "", ()) for q in ("", "A")}
        for i in range(len(msgs), -1, -1):
            if i < len(msgs):
                (_, role, text), kind, here = msgs[i], kinds[i], {}
                more = 3 if kind == "truncated" else 0
                for q in step:
                    ways = []
                    if q in best:
                        ways.append((4 + best[q][0], "D" + best[q][1], best[q][2]))
                    if kind in ("", "truncated"):
                        for c, letter, name in [(0, "K", role), (3, "R", "user"), (3, "R", "assistant")]:
                            to = step[q].get(name[:1])
                            if to in best:
                                ways.append((c + more + best[to][0], letter + best[to][1], (name + ":" + text, *best[to][2])))
                    if ways:
                        here[q] = min(ways)
                best = here
            for _ in range(4):
                for q in step:
                    for name in ("user", "assistant"):
                        to = step[q].get(name[0])
                        if to in best:
                            best[q] = min(best.get(q, (1 << 60,)), (3 + best[to][0], "I" + best[to][1], (name + ":", *best[to][2])))
        cost, audit, said = best[""]
        firsts = [m[1][:1] for m in msgs]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(11)
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 14)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", None, "", "s", "uu"])
            text = rng.choice(["Hello.", "hi", "What?", " \n", "", None, "So. ", "é!", "x" * 20 + ".\x0b", "a.b"])
            rows += [(conv if conv else None, rng.choice([turn, turn, turn, None, turn // 2, turn + 3]), role, text)] * rng.choice([1, 1, 1, 1, 1, 2, 3])
    rows += [(900, t, ["user", "assistant"][t % 2], f"text {t}" + "." * (t % 5 > 0)) for t in range(5000)]
    return rows


@pytest.mark.parametrize("rows", [1, 2, 5, repair.ROWS])
def test_repair(spark, talks, rows):
    """Whatever the size of blocks, down to one message."""
    talks = talks if rows > 2 else talks[:-4800]
    messages = spark.createDataFrame([(*r, 1, "x") for r in talks], "conv_id long, turn long, role string, text string, block int, kinds string")
    done = repair.Repair(messages, rows=rows)
    said = {r.conv_id: (r.audit, r.repaired_sha256) for r in repair.digests(done).collect()}
    got = {r.conv_id: (*tuple(r)[1:], *said[r.conv_id]) for r in done.summary.collect()}
    assert got == plain_repair(talks)
    stays = {}
    for r in done.messages().orderBy("conv_id", "at").collect():
        stays.setdefault(r.conv_id, []).append(r.role[:1])
    assert all(re.fullmatch("s?(ua)+", "".join(x)) for x in stays.values())


def test_repair_query(spark, sf):
    """The query damages, repairs and gives every conversation a row, also one that lost all its messages."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    left = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        r = (conv, turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
        left += [] if h == 0 else [r] * (2 if h == 3 else 1)
    want = plain_repair(left)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = repair.op11_conversation_repair(spark, sf).collect()
    assert sorted(tuple(r) for r in got) == sorted((c, *want.get(c, none)) for c in {r[0] for r in rows})
    assert got[0].asDict().keys() == {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"}


def test_damage_of_nulls(spark):
    """A null is one space in the key and in the row."""
    given = [(c, t, None, None) for c in [None, *range(40)] for t in [None, *range(5)]]
    got = repair.damage(spark.createDataFrame(given, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, _, _ in given:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want += [] if h == 0 else [(c, t, "user" if h == 4 else " ", "" if h == 1 else " ")] * (2 if h == 3 else 1)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_repair_of_no_rows(spark):
    messages = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    done = repair.Repair(messages)
    assert done.summary.collect() == [] and done.messages().collect() == [] and repair.digests(done).collect() == []
