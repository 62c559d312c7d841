"""Quality rules: a table of thresholds compiled into one projection.

``measure`` computes exact counts of every whole text with built-in functions;
``compile_rules`` turns a table of rules into one boolean expression, so a new
rule is a new row and never a new pass over the texts.

Cases: a null or empty text has no words, so every count is 0 and the base
check rejects it. Repeated rows are judged each on its own. An empty table
gives an empty result. Extra columns of the input are not carried by the query
(``doc_id`` names the row); ``judge`` returns the kept columns under the struct
``row`` and its own under the struct ``quality``, so names cannot clash.

Three-word windows are sorted by 64-bit hashes whose low bits give way to the
window's position. Neighbours with one hash are then compared word by word; in
a text where two of these differ, the windows themselves are sorted, so the
counts are exact at every length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, quoted

#: Frequent function words of the languages served (fixed values of this rule set).
STOP_WORDS = (
    "the be to of and that have with in is it for on are was as by at this from or a an "
    "der die das und ist nicht ein eine zu den mit von auf im dem des sich es auch "
    "le la les de des et est un une dans que pour qui sur pas en du il avec "
    "el los las y que en un una por con no para se su al del lo"
).split()
_STOP = "^[\"'(]?(" + "|".join(dict.fromkeys(STOP_WORDS)) + ")[.,;:!?)\"']*$"


@dataclass(frozen=True)
class Rule:
    """Reject a text whose metric lies outside low..high (either may be None)."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table. The base counts are fixed by contract; the ratios follow the published rules for web text.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2.0, 16.0),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.3),
    Rule("shouts_per_word", "n_shouts / n_words", None, 0.3),
    Rule("upper_ratio", "n_upper / word_chars", None, 0.5),
    Rule("stop_word_ratio", "n_stop / n_words", 0.02, None),
    Rule("letter_word_ratio", "n_letter_words / n_words", 0.6, None),
    Rule("duplicate_line_ratio", "n_dup_lines / n_lines", None, 0.5),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines / n_lines", None, 0.5),
)


#: SQL of the hash of a window of three words.
WINDOW_HASH = "xxhash64(_w[i - 1], _w[i], _w[i + 1])"


def measure(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), window_hash: str = WINDOW_HASH) -> DataFrame:
    """Counts of every whole text beside the struct ``row`` of the kept columns. Each select is a step whose columns the next one uses more than once."""
    t = F.coalesce(quoted(text), F.lit(""))
    first = df.select(
        F.struct(*[quoted(c) for c in keep]).alias("row"),
        F.filter(F.split(t, SPACE), lambda x: x != "").alias("_w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(t, r"[^!]+", "")).cast("long").alias("n_shouts"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
    )
    second = first.select(
        "row",
        "n_symbols",
        "n_shouts",
        "n_upper",
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_l", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("_w", lambda x: F.lower(x).rlike(_STOP))).cast("long").alias("n_stop"),
        F.size(F.filter("_w", lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        F.expr("coalesce(shiftleft(1L, cast(ceil(log2(size(_w) + 1.0D)) as int)) - 1L, 0L)").alias("_m"),
    )
    third = second.select(
        "*",
        F.expr(f"sort_array(if(size(_w) < 4, cast(array() as array<bigint>), transform(sequence(1, size(_w) - 2), i -> ({window_hash} & ~_m) | cast(i as bigint))))").alias("_s"),
    )
    # The windows whose hash another has too, in the order (hash, position).
    fourth = third.select(*[c for c in third.columns if c != "_s"], F.expr("filter(_s, (x, j) -> (x | _m) = (get(_s, j - 1) | _m) or (x | _m) = (get(_s, j + 1) | _m))").alias("_r"))
    before = "cast(get(_r, j - 1) & _m as int)"
    differ = " or ".join(f"_w[cast(x & _m as int) {k}] <> _w[{before} {k}]" for k in ("- 1", "", "+ 1"))
    window = "concat(_w[cast(x & _m as int) - 1], ' ', _w[cast(x & _m as int)], ' ', _w[cast(x & _m as int) + 1])"
    fifth = fourth.select(*[c for c in fourth.columns], F.expr(f"size(filter(_r, (x, j) -> j > 0 and (x | _m) = (get(_r, j - 1) | _m) and ({differ}))) > 0").alias("_bad"))
    sixth = fifth.select(
        *[c for c in fifth.columns if c not in ("_w", "_bad")],
        F.expr(f"if(_bad, sort_array(transform(_r, x -> struct({window} as s, x & _m as i))), null)").alias("_q"),
    )
    seventh = sixth.select(
        *[c for c in sixth.columns if c not in ("_m", "_r", "_q")],
        F.expr("sort_array(if(_q is null, transform(_r, x -> x & _m), transform(filter(_q, (x, j) -> x.s = get(_q, j - 1).s or x.s = get(_q, j + 1).s), x -> x.i)))").alias("_p"),
    )
    covered = F.expr("aggregate(_p, named_struct('last', -3L, 'n', 0L), (a, x) -> named_struct('last', x, 'n', a.n + least(3L, x - a.last)), a -> a.n)")
    # The counts leave through a generator: a filter on them stays above it, where the optimizer would else write the whole measuring into the filter.
    counts = [F.col(c) for c in seventh.columns if c not in ("row", "_p")]
    return seventh.select("row", F.inline(F.array(F.struct(*counts, covered.alias("n_repeat_words")))))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """True if no rule rejects. A ratio over nothing (0 / 0) rejects nothing."""
    ok = F.lit(True)
    for r in rules:
        top, _, under = r.metric.partition(" / ")
        value = F.col(top) / F.when(F.col(under) > 0, F.col(under)) if under else F.col(top).cast("double")
        if r.low is not None:
            ok = ok & F.coalesce(value >= F.lit(r.low), F.lit(True))
        if r.high is not None:
            ok = ok & F.coalesce(value <= F.lit(r.high), F.lit(True))
    return ok


def judge(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES, window_hash: str = WINDOW_HASH) -> DataFrame:
    """(row: the kept columns, quality: the counts, base_failed and kept), for each input row."""
    m = measure(df, text, keep, window_hash)
    counts = [c for c in m.columns if c != "row"]
    m = m.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & compile_rules(rules))
    return m.select("row", F.struct(*counts, "base_failed", "kept").alias("quality"))


def op4_quality_rules(spark, sf_dir):
    """doc_id, n_words, the four base counts, base_failed, kept: one row for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("row.doc_id", *[f"quality.{c}" for c in (*COUNTS, "base_failed", "kept")])
