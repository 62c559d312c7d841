"""Personal data: fixed patterns, and secrets found by weak supervision.

One pass of built-in regular expressions finds the spans of the four base
kinds and candidate spans of secrets (runs of 20 and more letters and digits
anywhere, of 6 and more after a name like ``password`` and ``=`` or ``:``).
Three kinds of labelers vote on
each candidate (+1, -1 or 0): regular expressions on its value, a gazetteer on
the name before it, and its context (assignment signs, quotes, neighbours).
Expectation-maximisation over the counts of the vote patterns, at most 3 to
the number of labelers, estimates each labeler's reliability and the share of
real secrets. The expected labels then train the final classifier, a naive
Bayes table over bounded span features; what it gives more than ``threshold``
is added as kind ``secret``.

Positions come from ``split`` and ``regexp_extract_all`` of one pattern: the
pieces between the matches and the matches themselves add up, by a scan of
doubling steps, so a text with very many matches takes n log n. The patterns use
possessive runs and a left border, so they are linear in a text and do not
recurse; for these languages they match what the plain patterns match.

Cases: null counts as the empty text: no spans, hash of the empty string.
Repeated rows are searched each. Without candidates nothing is added. An empty
table gives an empty result. Extra columns are not read by the query;
``redact`` keeps all columns, whatever their names: they travel in one struct.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, quoted, written

KINDS = ("email", "ip", "card", "phone")
_L = r"A-Za-z0-9._%+-"
#: By kind; \G lets a match begin where the one before ended.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_L}]))[{_L}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+",
    "announced": r"(?i:pass(?:word|wd|phrase)|pwd|secret|token|api[_-]?key|access[_-]?key|bearer|credential)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/-]{6,19}(?![A-Za-z0-9_+/-])",
}
#: What stands before the value in a match of an announced secret.
_ANNOUNCEMENT = r"^(?s:.*)[=:]\s{0,3}[\"']?"
#: Cheap tests, one of which must hold for a text to have a match at all.
NEEDS = {"email": "@", "phone": "+", "announced": "=:"}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Names that announce a secret (the gazetteer).
NAMES = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "key", "auth", "bearer", "credential", "access")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digit string passes the Luhn check."""
    n = F.length(digits)
    at = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")  # noqa: E731  i-th digit from the right
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda s, i: s + F.when(i % 2 == 1, at(i)).otherwise(F.when(at(i) > 4, at(i) * 2 - 9).otherwise(at(i) * 2)),
    )
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & F.when(F.length(_digits(m)).between(16, 19), luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


def _test(kind: str):
    return lambda s: _valid(kind, s["value"])


def _is(kind: str):
    return lambda s: s["kind"] == kind


_SPAN = "struct<kind: string, start: bigint, `end`: bigint, value: string, before: string, after: string>"


def scanned(name: str, step: str) -> Column:
    """The running total of an array column: ``step`` is SQL that puts together x and y, the total of the places before. Doubling steps, n log n."""
    earlier = "acc[i - shiftleft(1, k)]"
    once = f"transform(acc, (x, i) -> if(i >= shiftleft(1, k), {step.replace('y', earlier)}, x))"
    return F.expr(f"if(size({name}) < 2, {name}, aggregate(sequence(0, cast(ceil(log2(size({name}))) as int) - 1), {name}, (acc, k) -> {once}))")


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(row: the kept columns, found): all valid base spans and secret candidates of each text, as (kind, start, end, value, before, after) in code
    points; up to 32 characters before and 8 after go with them. Each select is a step whose columns the next one uses more than once."""
    kinds = tuple(PATTERNS)
    held = docs.select(F.struct(*[quoted(c) for c in keep]).alias("row"), F.coalesce(quoted(text), F.lit("")).alias("t"))

    def matches(kind: str) -> Column:
        found = F.regexp_extract_all("t", F.lit(PATTERNS[kind]), F.lit(0))
        if kind not in NEEDS:
            return found
        may = F.lit(False)
        for sign in NEEDS[kind]:
            may = may | F.contains("t", F.lit(sign))
        return F.when(may, found).otherwise(F.array().cast("array<string>"))

    first = held.select("row", "t", *[matches(k).alias(f"m_{k}") for k in kinds])
    second = first.select("row", *[f"m_{k}" for k in kinds], *[F.expr(f"if(size(m_{k}) > 0, split(t, {_sql(PATTERNS[k])}, -1), cast(array() as array<string>))").alias(f"p_{k}") for k in kinds])
    third = second.select("*", *[F.expr(f"transform(m_{k}, (x, i) -> cast(length(p_{k}[i]) + length(x) as bigint))").alias(f"n_{k}") for k in kinds])
    fourth = third.select("row", *[f"{c}_{k}" for k in kinds for c in "mp"], *[scanned(f"n_{k}", "x + y").alias(f"e_{k}") for k in kinds])
    lists = []
    for k in kinds:
        value = f"regexp_replace(x, {_sql(_ANNOUNCEMENT)}, '')" if k == "announced" else "x"
        before = f"concat(p_{k}[i], left(x, length(x) - length({value})))" if k == "announced" else f"p_{k}[i]"
        kind = "secret" if k == "announced" else k
        span = f"named_struct('kind', '{kind}', 'start', e_{k}[i] - length({value}), 'end', e_{k}[i], 'value', {value}, 'before', right({before}, 32), 'after', left(p_{k}[i + 1], 8))"
        got = F.expr(f"if(size(m_{k}) > 0, transform(m_{k}, (x, i) -> {span}), cast(array() as array<{_SPAN}>))")
        lists.append(F.filter(got, _test(kind)))
    return fourth.select("row", F.concat(*lists).alias("found"))


def labelers(v: Column, before: Column, after: Column) -> dict[str, Column]:
    """Votes on a candidate: +1 a secret, -1 not one, 0 no opinion."""
    vote = lambda yes, no=None: F.when(yes, 1).when(no if no is not None else F.lit(False), -1).otherwise(0)
    name = "(?i)(?:" + "|".join(NAMES) + r")[\"']?\s*[=:]?\s*[\"']?$"
    return {
        "regex_hex": vote(v.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$") | v.rlike(r"^(?:AKIA|ghp_|sk-|xox)[A-Za-z0-9_-]{16,}$"), v.rlike("^[A-Za-z]+[0-9]{1,4}$")),
        "regex_mixed": vote(F.length(F.regexp_replace(v, "[^0-9]", "")) * 5 >= F.length(v), v.rlike("^[A-Za-z_-]{12,}")),
        "gazetteer": vote(before.rlike(name), before.rlike(r"(?:https?://|/|=[^\"']{8,})\S*$")),
        "assigned": vote(before.rlike(r"[=:]\s*[\"']?$"), before.rlike(r"[A-Za-z]{2}[,.]?\s$")),
        "quoted": vote(before.rlike("[\"']$") & after.rlike("^[\"']"), after.rlike("^[A-Za-z]")),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[dict[int, float]], list[dict[int, float]]]:
    """EM for independent labelers over (votes, count): the share of secrets and each labeler's vote odds given one or given none. At most 3^labelers patterns."""
    n = len(patterns[0][0])
    share = 0.5
    yes = [{1: 0.7, 0: 0.2, -1: 0.1} for _ in range(n)]
    no = [{1: 0.1, 0: 0.4, -1: 0.5} for _ in range(n)]
    total = sum(c for _, c in patterns)
    for _ in range(rounds):
        post = [posterior(share, yes, no, v) for v, _ in patterns]
        one = sum(p * c for p, (_, c) in zip(post, patterns))
        share = (one + 1) / (total + 2)
        for i in range(n):
            for x in (-1, 0, 1):
                yes[i][x] = (sum(p * c for p, (v, c) in zip(post, patterns) if v[i] == x) + 1) / (one + 3)
                no[i][x] = (sum((1 - p) * c for p, (v, c) in zip(post, patterns) if v[i] == x) + 1) / (total - one + 3)
    return share, yes, no


def posterior(share, yes, no, votes) -> float:
    a, b = math.log(share), math.log(1 - share)
    for i, x in enumerate(votes):
        a += math.log(yes[i][x])
        b += math.log(no[i][x])
    return 1 / (1 + math.exp(max(-700.0, min(700.0, b - a))))


def features(v: Column, before: Column, after: Column) -> dict[str, Column]:
    """Bounded features of a candidate for the final classifier."""
    n = F.length(v)
    return {
        "size": F.least(F.floor(F.log2(n.cast("double")) * 2), F.lit(18)).cast("int"),
        "digits": F.floor(F.length(F.regexp_replace(v, "[^0-9]", "")) * 5 / n).cast("int"),
        "upper": F.floor(F.length(F.regexp_replace(v, "[^A-Z]", "")) * 5 / n).cast("int"),
        "sign": F.when(before.rlike(r"=\s*[\"']?$"), 2).when(before.rlike(r":\s*[\"']?$"), 1).otherwise(0),
        "quote": F.when(before.rlike("[\"']$"), 1).otherwise(0) + F.when(after.rlike("^[\"']"), 2).otherwise(0),
        "named": F.when(before.rlike("(?i)(?:" + "|".join(NAMES) + ")"), 1).otherwise(0),
    }


def train(cands: DataFrame):
    """cands(value, before, after) -> a function of these three columns that gives the classifier's probability of a secret.

    To the driver go the counts of vote patterns (at most 3^5) and of feature
    values (a few dozen), never candidates.
    """
    v, b, a = F.col("value"), F.col("before"), F.col("after")
    votes, feats = labelers(v, b, a), features(v, b, a)
    seen = cut(cands.select(F.array(*votes.values()).alias("_votes"), *[f.alias(f"_f_{k}") for k, f in feats.items()]).groupBy("_votes", *[f"_f_{k}" for k in feats]).count())
    counts = [(tuple(r["_votes"]), r["n"]) for r in seen.groupBy("_votes").agg(F.sum("count").alias("n")).collect()]
    if not counts:
        return lambda v, b, a: F.lit(0.0)
    model = fit(counts)
    soft = F.create_map(*[x for p, _ in sorted(counts) for x in (F.lit(",".join(map(str, p))), F.lit(posterior(*model, p)))])
    y = F.element_at(soft, F.array_join(F.col("_votes").cast("array<string>"), ","))
    long = seen.select((y * F.col("count")).alias("y"), "count", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_f_{k}").alias("x")) for k in feats])))
    table = long.groupBy("k", "x").agg(F.sum("y").alias("one"), F.sum(F.col("count") - F.col("y")).alias("none")).collect()
    one, none = (sum(r[c] for r in table) / len(feats) for c in ("one", "none"))
    weights = {}
    for k in feats:
        mine = sorted((r for r in table if r["k"] == k), key=lambda r: r["x"])
        weights[k] = {r["x"]: math.log((r["one"] + 0.5) / (one + 0.5 * len(mine))) - math.log((r["none"] + 0.5) / (none + 0.5 * len(mine))) for r in mine}

    def score(v: Column, b: Column, a: Column) -> Column:
        odds = F.lit(math.log((one + 1) / (none + 1)))
        for k, f in features(v, b, a).items():
            odds = odds + F.coalesce(F.element_at(F.create_map(*[F.lit(z) for x in weights[k].items() for z in x]), f), F.lit(0.0))
        return 1 / (1 + F.exp(-odds))

    return score


def decide(found: DataFrame, score, threshold: float = 0.5) -> DataFrame:
    """(row, base, added): arrays of (kind, start, end), each by kind as listed and then start."""
    bare = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    secret = lambda s: (s["kind"] == "secret") & (score(s["value"], s["before"], s["after"]) > threshold)
    return found.select(
        "row",
        F.transform(F.filter("found", lambda s: s["kind"] != "secret"), bare).alias("base"),
        # Two patterns find secrets, one after the other; all are one kind, so their structs sort by start.
        F.array_sort(F.transform(F.filter("found", secret), bare)).alias("added"),
    )


def _candidates(found: DataFrame) -> DataFrame:
    return found.select(F.inline(F.filter("found", _is("secret")))).select("value", "before", "after")


def detect(docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """One row per input row: (id, base, added). The spans (not the texts) are written once, since the model is learned from them and then applied to them."""
    found = written(spans(docs, text, (id_col,)))
    return decide(found, train(_candidates(found)), threshold).select("row.*", "base", "added")


def _text(spans_col: Column) -> Column:
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark, sf_dir):
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    d = detect(docs)
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return d.select("doc_id", *counts, F.sha2(_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), _text(F.concat("base", "added")).alias("spans"))


#: Code points of a block of text, from which pieces at any place are cut.
_BLOCK = 512


def _piece(a: str, b: str) -> str:
    """SQL of the code points a to b of a text whose blocks are in ``cells``; each costs its length and two blocks."""
    i, j = f"cast(({a}) div {_BLOCK} as int)", f"cast((({b}) - 1) div {_BLOCK} as int)"
    at, rest = f"cast(({a}) % {_BLOCK} as int) + 1", f"cast((({b}) - 1) % {_BLOCK} as int) + 1"
    within = f"substring(get(cells, {i}), {at}, cast(({b}) - ({a}) as int))"
    across = f"concat(substring(get(cells, {i}), {at}), array_join(slice(cells, {i} + 2, {j} - {i} - 1), ''), left(get(cells, {j}), {rest}))"
    return f"case when ({b}) <= ({a}) then '' when {i} = {j} then {within} else {across} end"


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents with every span replaced by its kind in brackets. Spans that overlap are one, from the first start to the last end, and bear the
    kind of the one that starts first (the longer of two that start together).

    The texts are scanned twice, once to learn and once to replace, so that no
    text is shuffled. A column n_chars follows the new text.
    """
    score = train(_candidates(spans(docs, "text", ("doc_id",))))
    hits = decide(spans(docs, "text", tuple(docs.columns)), score, threshold)
    order = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))
    first = hits.select("row", order.alias("s"))
    second = first.select("row", "s", F.expr("transform(s, x -> -x.less)").alias("ends"))
    third = second.select("row", "s", scanned("ends", "greatest(x, y)").alias("most"))
    heads = "filter(sequence(0, size(s) - 1), i -> i = 0 or s[i].start >= most[i - 1])"
    fourth = third.select("row", "s", "most", F.expr(f"if(size(s) = 0, cast(array() as array<int>), {heads})").alias("heads"))
    union = "transform(heads, (h, k) -> named_struct('start', s[h].start, 'end', most[coalesce(get(heads, k + 1), size(s)) - 1], 'kind', s[h].kind))"
    cells = f"if(size(s) = 0, cast(array() as array<string>), regexp_extract_all(row.text, '(?s).{{1,{_BLOCK}}}', 0))"
    fifth = fourth.select("row", F.expr(union).alias("u"), F.expr(cells).alias("cells"))
    body = f"array_join(transform(u, (x, k) -> concat({_piece('coalesce(get(u, k - 1).end, 0L)', 'x.start')}, '[', x.kind, ']')), '')"
    tail = _piece("u[size(u) - 1].end", "cast(length(row.text) as bigint)")
    sixth = fifth.select("row", F.expr(f"if(size(u) = 0, null, concat({body}, {tail}))").alias("new"))
    put = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}
    own = lambda c: F.col("row").getField(c)
    return sixth.select(*[F.when(F.col("new").isNull(), own(c)).otherwise(put[c]).alias(c) if c in put else own(c).alias(c) for c in docs.columns])
