"""Queries over texts: cleaning, tokens, splitting, chunks, duplicates, noise."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk as C
from ..operators import evalset as E
from .relational import table

QUERIES, ORACLES = {}, {}


def query(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


_TOK = r"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}\-'']+'), lambda t: regexp_matches(t, '^[a-z0-9\-]+$'))"
TOK = _TOK.format(x="text")
_CLEAN = "text"
for _p, _to in T.MARKDOWN_STEPS:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '{_to.replace('$1', chr(92) + '1')}', 'g')"
_WORDS = r"list_filter(string_split_regex(text, '[ \t\n]+'), lambda x: x <> '')"


@query(f"SELECT doc_id, length(c)::BIGINT AS n, md5(c) AS clean_md5 FROM (SELECT doc_id, trim({_CLEAN}) AS c FROM documents)")
def clean_text(spark, sf):
    c = T.clean_markdown(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(c).cast("long").alias("n"), F.md5(c.cast("binary")).alias("clean_md5"))


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT doc_id, {TOK} AS t FROM documents)")
def token_stats(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query("SELECT doc_id, CASE WHEN starts_with(l, '#') THEN trim(regexp_replace(l, '^#+\\s*', '')) ELSE 'doc' || doc_id END AS title FROM (SELECT doc_id, string_split(text, chr(10))[1] AS l FROM documents)")
def titles(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.title(F.col("text"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"))).alias("title"))


@query(r"SELECT doc_id, len(p)::BIGINT AS n, coalesce(list_max(list_transform(p, lambda x: length(x))), 0)::BIGINT AS longest FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents)")
def paragraph_stats(spark, sf):
    p = table(spark, sf, "documents").select("doc_id", T.paragraphs(F.col("text"), "\n").alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n"), F.coalesce(F.array_max(F.transform("p", F.length)), F.lit(0)).cast("long").alias("longest"))


_SENT = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


@query(rf"SELECT doc_id, len(c)::BIGINT AS n, md5(array_to_string(c, '|')) AS claims_md5 FROM (SELECT doc_id, list_filter(list_transform({_SENT}, lambda x: trim(x)), lambda x: length(x) > 20) AS c FROM documents)")
def sentence_claims(spark, sf):
    c = table(spark, sf, "documents").select("doc_id", T.claims(F.col("text")).alias("c"))
    return c.select("doc_id", F.size("c").cast("long").alias("n"), F.md5(F.array_join("c", "|").cast("binary")).alias("claims_md5"))


@query(r"SELECT doc_id, len(p) >= 3 AND (len(list_filter(p, lambda x: regexp_matches(x, '^\s*\|[\s\-:|]+\|\s*$'))) > 0 OR (len(list_distinct(n)) = 1 AND n[1] >= 2)) AS is_table FROM (SELECT doc_id, p, list_transform(p, lambda x: length(x) - length(replace(x, '|', ''))) AS n FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: contains(x, '|')) AS p FROM documents))")
def table_flags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.looks_like_table(F.col("text")).alias("is_table"))


@query(r"""SELECT doc_id, md5(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE trim(x) = '' OR contains(x, '|') OR contains(coalesce(p, ''), '|') OR contains(coalesce(n, ''), '|')
  OR NOT (regexp_matches(trim(x), '^[-–—]{3,}$') OR regexp_matches(trim(x), '^[0-9]+\s*$') OR regexp_matches(x, '^\s*\{{0,2}[0-9]+\}{0,2}\s*[-–—]{2,}\s*$'))), '')) AS text_md5
FROM (SELECT doc_id, x, i, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS p, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS n
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) GROUP BY doc_id""")
def page_breaks_removed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.without_page_breaks(F.col("text")).cast("binary")).alias("text_md5"))


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END AS preview FROM documents")
def previews(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.truncated(F.col("text"), 500).alias("preview"))


@query(r"SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY regexp_replace(lower(trim(text)), '\s+', ' ', 'g')")
def dedup_exact(spark, sf):
    """The first document of each normalised text, met by a hash of it rather than the text."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2(T.dedup_key(F.col("text")), 256).alias("k"))
    return d.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n")


@query("SELECT doc_id, substring(md5(text), 1, 8) AS hash8 FROM documents")
def short_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.short_hash(F.col("text")).alias("hash8"))


@query(r"""SELECT page_id, length(t)::BIGINT AS n, md5(t) AS text_md5 FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM pages)""")
def html_text(spark, sf):
    t = T.html_to_text(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.length(t).cast("long").alias("n"), F.md5(t.cast("binary")).alias("text_md5"))


_NOISE_CASE = " ".join(f"WHEN regexp_matches(trim(x), '{p}') THEN '{n}'" for n, p in E.NOISE)


@query(rf"SELECT source, CASE WHEN starts_with(trim(x), '#') THEN 'kept' {_NOISE_CASE} ELSE 'kept' END AS reason, count(*) AS n FROM (SELECT source, unnest(string_split(text, chr(10))) AS x FROM documents) GROUP BY ALL")
def noise_reasons(spark, sf):
    p = table(spark, sf, "documents").select("source", F.explode(T.lines(F.col("text"))).alias("p"))
    return p.groupBy("source", F.coalesce(E.noise_reason(F.col("p")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_NOISE_ANY = " OR ".join(f"regexp_matches(trim(x), '{p}')" for _, p in E.NOISE)


@query(f"SELECT source, count(*) FILTER (WHERE kept) AS n_kept, count(*) FILTER (WHERE NOT kept) AS n_removed FROM (SELECT source, starts_with(trim(x), '#') OR NOT ({_NOISE_ANY}) AS kept FROM (SELECT source, unnest(string_split(text, chr(10))) AS x FROM documents)) GROUP BY ROLLUP (source)")
def noise_summary(spark, sf):
    p = table(spark, sf, "documents").select("source", F.explode(T.lines(F.col("text"))).alias("p")).withColumn("kept", E.noise_reason(F.col("p")).isNull())
    return p.rollup("source").agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_removed"))


@query("SELECT b AS bucket, count(*) AS n FROM (SELECT CASE WHEN n <= 256 THEN 256 WHEN n <= 512 THEN 512 WHEN n <= 1024 THEN 1024 ELSE 2048 END AS b FROM (SELECT length(text) // 4 AS n FROM documents)) GROUP BY b")
def token_buckets(spark, sf):
    return table(spark, sf, "documents").groupBy(T.bucket(T.token_estimate(F.col("text"))).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(array_to_string(l[1:h], chr(10))) AS head_md5, md5(array_to_string(l[h + 1:], chr(10))) AS tail_md5 FROM (SELECT doc_id, l, greatest(1, len(l) // 2) AS h FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
def long_halves(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.halves(F.col("text")).alias("h"))
    return d.select("doc_id", F.md5(F.col("h.head").cast("binary")).alias("head_md5"), F.md5(F.col("h.tail").cast("binary")).alias("tail_md5"))


_CHUNK_SQL = """
WITH w AS (SELECT doc_id, {words} AS w FROM documents), s AS (SELECT doc_id, w, {size} AS size FROM w),
c AS (SELECT doc_id, w, size, unnest(range(0, len(w), size - {o})) AS s FROM s)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS chunk_index, s::INT AS "start", least(s + size, len(w))::INT AS "end", md5(array_to_string(w[s + 1:s + size], ' ')) AS chunk_md5 FROM c"""


def _chunks(docs, column):
    c = docs.select("doc_id", F.posexplode(column).alias("chunk_index", "c"))
    return c.select("doc_id", "chunk_index", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.md5(F.col("c.text").cast("binary")).alias("chunk_md5"))


def _words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.filter(F.split("text", r"[ \t\n]+"), lambda x: x != "").alias("w"))


@query(_CHUNK_SQL.format(words=_WORDS, size="200", o=40))
def chunk_fixed(spark, sf):
    return _chunks(_words(spark, sf), C.fixed(F.col("w"), 200, 40))


@query(_CHUNK_SQL.format(words=_WORDS, size="CASE WHEN len(w) <= 300 THEN greatest(len(w), 1) + 30 ELSE ceil((len(w) + (ceil((len(w) - 30) / 270.0) - 1) * 30) / ceil((len(w) - 30) / 270.0))::BIGINT END", o=30))
def chunk_uniform(spark, sf):
    return _chunks(_words(spark, sf), C.uniform(F.col("w"), 300, 30))


@query(r"""
WITH RECURSIVE p AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda y: y <> ''))) AS n FROM documents),
e AS (SELECT doc_id, i, (SELECT max(j) + 1 FROM (SELECT unnest(range(i, len(n))) AS j) t WHERE j = i OR list_sum(n[i + 1:j + 1]) <= 100) AS e, len(n) AS m FROM (SELECT doc_id, n, unnest(range(0, len(n))) AS i FROM p)),
r AS (SELECT doc_id, i AS s, e, greatest(i + 1, e - 2) AS nxt FROM e WHERE i = 0 UNION ALL SELECT r.doc_id, e.i, e.e, greatest(e.i + 1, e.e - 2) FROM r JOIN e ON r.doc_id = e.doc_id AND e.i = r.nxt)
SELECT doc_id, s::INT AS "start", e::INT AS "end" FROM r""")
def chunk_paragraph(spark, sf):
    p = table(spark, sf, "documents").select("doc_id", F.transform(T.paragraphs(F.col("text"), "\n"), lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda y: y != ""))).alias("n"))
    r = p.select("doc_id", F.explode(C.paragraph_ranges("n", 100, 2)).alias("r"))
    return r.select("doc_id", F.col("r.start").alias("start"), F.col("r.end").alias("end"))


@query(r"""
WITH RECURSIVE p AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda y: y <> ''))) AS n FROM documents),
e AS (SELECT doc_id, i, (SELECT max(j) + 1 FROM (SELECT unnest(range(i, len(n))) AS j) t WHERE j = i OR list_sum(n[i + 1:j + 1]) <= 100) AS e, len(n) AS m FROM (SELECT doc_id, n, unnest(range(0, len(n))) AS i FROM p)),
r AS (SELECT doc_id, i AS s, e, greatest(i + 1, e - least(2, e - i - 1)) AS nxt, m FROM e WHERE i = 0 UNION ALL SELECT r.doc_id, e.i, e.e, greatest(e.i + 1, e.e - least(2, e.e - e.i - 1)), e.m FROM r JOIN e ON r.doc_id = e.doc_id AND e.i = r.nxt WHERE r.e < r.m)
SELECT doc_id, s::INT AS "start", e::INT AS "end" FROM r""")
def chunk_paragraph_older(spark, sf):
    """The older overlap: at most all but one of a chunk's paragraphs are repeated, and the chunk that reaches the end is the last."""
    p = table(spark, sf, "documents").select("doc_id", F.transform(T.paragraphs(F.col("text"), "\n"), lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda y: y != ""))).alias("n"))
    r = p.select("doc_id", F.explode(C.paragraph_ranges("n", 100, 2, older=True)).alias("r"))
    return r.select("doc_id", F.col("r.start").alias("start"), F.col("r.end").alias("end"))


def _recursive_sql(size: int, overlap: int) -> str:
    """Two recursions: pieces over the size are split again by finer separators, and the pieces of each run between them are merged one by one."""
    span = "cs[k - 1] - coalesce(cs[x - 1], 0) + ls * (k - 1 - x)"
    joined = "CASE sep " + " ".join(f"WHEN {x} THEN array_to_string(ps[e.f:e.l], {x})" for x in ("chr(10) || chr(10)", "chr(10)", "'. '", "' '")) + " ELSE array_to_string(ps[e.f:e.l], '') END"
    return rf"""
WITH RECURSIVE sp AS (SELECT [chr(10) || chr(10), chr(10), '. ', ' ', ''] AS seps),
nd AS (SELECT doc_id, []::BIGINT[] AS path, text AS t, 1::BIGINT AS a FROM documents WHERE text <> ''
UNION ALL SELECT doc_id, path || [i], p, sq + 1 FROM (SELECT doc_id, path, sq, unnest(ps) AS p, generate_subscripts(ps, 1)::BIGINT AS i FROM (
  SELECT doc_id, path, sq, string_split(t, seps[sq]) AS ps FROM (SELECT doc_id, path, t, seps, list_filter(range(a, 6), lambda x: x = 5 OR contains(t, seps[x]))[1] AS sq FROM nd, sp))) WHERE length(p) > {size} AND sq < 5),
pc AS (SELECT doc_id, path, sep, unnest(ps) AS p, generate_subscripts(ps, 1)::BIGINT AS i FROM (SELECT doc_id, path, seps[sq] AS sep, string_split(t, seps[sq]) AS ps FROM
  (SELECT doc_id, path, t, seps, list_filter(range(a, 6), lambda x: x = 5 OR contains(t, seps[x]))[1] AS sq FROM nd, sp))),
rn AS (SELECT *, sum((length(p) > {size})::INT) OVER (PARTITION BY doc_id, path ORDER BY i) AS run FROM pc),
cu AS (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id, path, run ORDER BY i) AS c FROM rn WHERE length(p) <= {size}),
r AS (SELECT doc_id, path, run, any_value(sep) AS sep, length(any_value(sep)) AS ls, list(p ORDER BY i) AS ps, list(c ORDER BY i) AS cs, min(i) AS i0, count(*) AS m FROM cu GROUP BY doc_id, path, run),
mg AS (SELECT doc_id, path, run, 1::BIGINT AS k, 1::BIGINT AS b, 0::HUGEINT AS n, []::STRUCT(f BIGINT, l BIGINT)[] AS done FROM r
UNION ALL SELECT doc_id, path, run, k + 1, b2, CASE WHEN b2 = k THEN lp ELSE cs[k - 1] - coalesce(cs[b2 - 1], 0) + ls * (k - 1 - b2) + lp + ls END, CASE WHEN ends THEN done || [{{'f': b, 'l': k - 1}}] ELSE done END FROM (
  SELECT *, CASE WHEN ends THEN list_filter(range(b, k + 1), lambda x: x = k OR ({span} <= {overlap} AND {span} + lp + ls <= {size}))[1] ELSE b END AS b2 FROM (
    SELECT mg.*, r.ls, r.cs, cs[k] - coalesce(cs[k - 1], 0) AS lp, k > b AND n + cs[k] - coalesce(cs[k - 1], 0) + r.ls > {size} AS ends FROM mg JOIN r ON r.doc_id = mg.doc_id AND r.path = mg.path AND r.run = mg.run AND mg.k <= r.m))),
ch AS (SELECT doc_id, path, i0, unnest(d) AS e, generate_subscripts(d, 1)::BIGINT AS c, ps, sep FROM (SELECT mg.doc_id, mg.path, i0, ps, sep, done || [{{'f': b, 'l': m}}] AS d FROM mg JOIN r ON r.doc_id = mg.doc_id AND r.path = mg.path AND r.run = mg.run AND mg.k = r.m + 1)),
tx AS (SELECT doc_id, path || [i0, c] AS sq, regexp_replace({joined}, '^\s+|\s+$', '', 'g') AS chunk FROM ch)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sq) - 1)::INT AS chunk_index, length(chunk)::INT AS n, substring(md5(chunk), 1, 8) AS chunk_hash FROM tx WHERE chunk <> ''"""


@query(_recursive_sql(1500, 300))
def chunk_recursive(spark, sf):
    """1500 characters with 300 repeated, and the chunk's short hash."""
    c = C.recursive(table(spark, sf, "documents"), "text", 1500, 300, ["doc_id"])
    return c.select("doc_id", "chunk_index", F.length("chunk").alias("n"), T.short_hash(F.col("chunk")).alias("chunk_hash"))


def _header_sql(text: str, size: int, overlap: int) -> str:
    """The packing of sections unit by unit: what is held, and the lengths of the chunks that have ended."""
    tail = f"CASE WHEN held // 4 >= {overlap} AND {overlap} * held // greatest(held // 4, 1) < held THEN {overlap} * held // greatest(held // 4, 1) ELSE 0 END"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, {text} AS t FROM documents),
s AS (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '(^|\n)(#{{1,6}}\s+\S)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda y: trim(y, chr(10))), lambda y: regexp_matches(y, '\S')) AS x FROM d)),
u AS (SELECT doc_id, i, unnest(p) AS u, generate_subscripts(p, 1) AS j, big FROM (SELECT doc_id, i, length(s) // 4 > {size} AS big, CASE WHEN length(s) // 4 > {size} THEN string_split(s, chr(10) || chr(10)) ELSE [s] END AS p FROM s)),
k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k, length(u) AS chars, CASE WHEN NOT big THEN 0 WHEN j = 1 THEN 1 ELSE 2 END AS place FROM u),
r AS (SELECT DISTINCT doc_id, 1 AS k, 0::BIGINT AS held, []::BIGINT[] AS plan FROM k
UNION ALL SELECT doc_id, k + 1, kept + chars + CASE WHEN kept > 0 THEN 2 ELSE 0 END, plan FROM (
  SELECT doc_id, k, chars, CASE WHEN NOT ends THEN held WHEN alone THEN 0 ELSE carried END AS kept, CASE WHEN alone THEN plan || [held, carried] WHEN ends THEN plan || [held] ELSE plan END AS plan FROM (
    SELECT *, ends AND place = 1 AND carried > 0 AND carried // 4 + chars // 4 > {size} AS alone FROM (
      SELECT r.doc_id, r.k, chars, place, held, plan, held > 0 AND (held // 4 + chars // 4 > {size} OR place = 1) AS ends, CASE WHEN place = 2 THEN 0 ELSE {tail} END AS carried FROM r JOIN k ON k.doc_id = r.doc_id AND k.k = r.k)))),
z AS (SELECT doc_id, CASE WHEN held > 0 THEN plan || [held] ELSE plan END AS plan FROM r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = r.doc_id AND k.k = r.k))
SELECT doc_id, unnest(range(0, len(plan)))::INT AS chunk_index, unnest(plan)::INT AS n FROM z"""


@query(_header_sql("text", 500, 50))
def chunk_headers(spark, sf):
    """Sections packed to 500 estimated tokens with 50 repeated."""
    c = C.by_headers(table(spark, sf, "documents"), "text", 500, 50, ["doc_id"])
    return c.select("doc_id", "chunk_index", F.length("chunk").alias("n"))


@query(_header_sql("array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 6 = 1 AND regexp_matches(x, '\\S') THEN '## ' || x ELSE x END), chr(10) || chr(10))", 200, 20))
def chunk_markdown(spark, sf):
    """The documents as markdown, every sixth line a heading, the lines paragraphs; sections packed to 200 estimated tokens with 20 repeated."""
    line = lambda x, i: F.when((i % 6 == 0) & x.rlike(r"\S"), F.concat(F.lit("## "), x)).otherwise(x)
    md = table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n\n").alias("text"))
    c = C.by_headers(md, "text", 200, 20, ["doc_id"])
    return c.select("doc_id", "chunk_index", F.length("chunk").alias("n"))


@query(r"""
WITH p AS (SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents)),
f AS (SELECT *, i > 1 AND length(p) < 80 AND regexp_matches(p, '(?i)^\(?Eq\.?\s*[0-9]+\)?$|^\(?[0-9]+\)?$|^\[?[0-9]+\]?$|^Fig\.?\s*[0-9]+$') AS o FROM p),
g AS (SELECT *, sum(CASE WHEN o THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM f)
SELECT doc_id, count(DISTINCT g) AS n_pieces, max(n)::BIGINT AS longest FROM (SELECT doc_id, g, length(string_agg(p, chr(10) ORDER BY i)) AS n FROM g GROUP BY doc_id, g) GROUP BY doc_id""")
def orphans_attached(spark, sf):
    p = table(spark, sf, "documents").select("doc_id", C.with_orphans(T.paragraphs(F.col("text"), "\n")).alias("p")).where(F.size("p") > 0)
    return p.select("doc_id", F.size("p").cast("long").alias("n_pieces"), F.array_max(F.transform("p", F.length)).cast("long").alias("longest"))


@query("SELECT conv_id, string_agg('[' || pos || '] ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY pos) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations) WHERE pos <= 5 GROUP BY conv_id")
def context_blocks(spark, sf):
    """The first five messages of each conversation, chosen before they are gathered."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("pos", F.row_number().over(w)).where("pos <= 5")
    items = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("role").alias("title"), "text"))).alias("items"))
    return items.select("conv_id", T.context(F.col("items")).alias("context"))


@query("SELECT conv_id, turn, CASE WHEN p IS NOT NULL AND starts_with(text, p) THEN substring(text, length(p) + 1) ELSE text END AS gained FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)")
def text_deltas(spark, sf):
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, sf, "conversations").withColumn("before", before)
    return c.select("conv_id", "turn", F.coalesce(T.delta(F.col("text"), F.col("before")), F.col("text")).alias("gained"))


@query("SELECT event_id, strftime(ts, '%Y%m%d%H%M%S%g') || '_' || substring(sha256(event_id::VARCHAR), 1, 8) AS sid FROM events")
def sortable_ids(spark, sf):
    return table(spark, sf, "events").select("event_id", T.sortable_id(F.col("ts"), F.col("event_id").cast("string")).alias("sid"))


@query("SELECT conv_id, substring(CASE WHEN length(t) < 3 THEN substring(q, 1, 50) ELSE t END, 1, 100) AS title FROM (SELECT conv_id, text AS q, trim(string_split(regexp_replace(trim(text), '^[\"'']+|[\"'']+$', '', 'g'), chr(10))[1]) AS t FROM conversations WHERE turn = 0)")
def chat_titles(spark, sf):
    c = table(spark, sf, "conversations").where("turn = 0")
    return c.select("conv_id", T.tidy_title(F.col("text"), F.col("text")).alias("title"))
