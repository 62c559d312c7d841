"""DuckDB SQL of the queries that SQL can express."""

import re

from .licenses import LICENCE_FILE, NOTICES, SPDX, TEMPLATES, TEXTS, TREE
from .quality import STOP_WORDS

_STOPS = "|".join(dict.fromkeys(STOP_WORDS))
_SPEAKS = r"(?i)licen[sc]e|copyright|\bspdx\b|public domain|all rights reserved|permission is hereby granted"

_HEADER = f"array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_SPEAKS}')), chr(10))"
_WORDS = r"list_filter(string_split_regex({x}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _notices(n: str) -> str:
    return f"CASE {n} % {len(TREE)} " + " ".join(f"WHEN {i} THEN {_quoted(NOTICES[k])}" for i, k in enumerate(TREE)) + " END"


def _licences(files: str, out: str) -> str:
    """files(doc_id, path, text, given) scored against every template, whole and by its header lines; tags first; then the nearest directory with a licence file."""
    bodies = [(k, b) for table in (TEMPLATES, NOTICES, TEXTS) for k, b in table.items()]
    forms = [(k, i, b) for i, (k, b) in enumerate(bodies)]
    forms += [(k, -i - 1, "\n".join(x for x in b.split("\n") if re.search(_SPEAKS, x))) for k, i, b in forms]
    known = sorted({k for k, _ in bodies})
    names = ", ".join(f"('{(k + e).lower()}', '{k}')" for k in known for e in ("", "-only", "-or-later"))
    values = ", ".join(f"('{k}', {i}, {_quoted(b)})" for k, i, b in forms)
    terms = r"'[a-z0-9]+(?:\.[0-9]+)*'"
    return rf"""
WITH g AS (SELECT *, coalesce(regexp_matches(path, '{LICENCE_FILE}'), false) AS named FROM ({files})),
f AS (SELECT row_number() OVER () AS uid, doc_id, path, given OR named AS is_file, CASE WHEN named THEN coalesce(text, '') ELSE {_HEADER} END AS header, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') END AS dir FROM g),
h AS (SELECT header, count(*) AS n FROM f WHERE header <> '' GROUP BY header),
tf AS (SELECT header, n, term, count(*)::DOUBLE AS tf FROM (SELECT header, n, unnest(regexp_extract_all(lower(header), {terms})) AS term FROM h) GROUP BY ALL),
df AS (SELECT term, sum(n) AS df FROM tf GROUP BY term),
idf AS (SELECT term, ln(((SELECT sum(n) FROM h) + 1.0) / (df + 1.0)) + 1.0 AS idf FROM df),
t AS (SELECT licence, form, term, count(*)::DOUBLE AS tf FROM (SELECT licence, form, unnest(regexp_extract_all(lower(body), {terms})) AS term FROM (VALUES {values}) v(licence, form, body)) GROUP BY ALL),
tw AS (SELECT licence, form, t.term, tf * coalesce(idf, ln(coalesce((SELECT sum(n) FROM h), 0) + 1.0) + 1.0) AS w FROM t LEFT JOIN idf USING (term)),
tn AS (SELECT form, sqrt(sum(w * w)) AS tn FROM tw GROUP BY form),
hw AS (SELECT header, tf.term, tf * idf AS w FROM tf JOIN idf USING (term)),
hn AS (SELECT header, sqrt(sum(w * w)) AS hn FROM hw GROUP BY header),
tg AS (SELECT header, licence, 1.0::DOUBLE AS score FROM h JOIN (VALUES {names}) v(tag, licence) ON tag = lower(regexp_extract(header, '{SPDX}', 1))),
c AS (SELECT header, licence, round(sum(hw.w * tw.w) / any_value(tn) / any_value(hn), 6) AS score FROM hw JOIN tw USING (term) JOIN tn USING (form) JOIN hn USING (header) WHERE header NOT IN (SELECT header FROM tg) GROUP BY header, licence, form UNION ALL SELECT * FROM tg),
b AS (SELECT header, licence, score FROM c WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY header ORDER BY score DESC, licence) = 1),
o AS (SELECT f.*, b.licence AS own, b.score FROM f LEFT JOIN b USING (header)),
d AS (SELECT dir AS up, own AS dl FROM o WHERE is_file AND own IS NOT NULL AND dir IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY path) = 1),
a AS (SELECT dir, depth, array_to_string(string_split(dir, '/')[1:depth], '/') AS up FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS depth FROM (SELECT DISTINCT dir FROM o WHERE dir IS NOT NULL))),
n AS (SELECT dir, arg_max(up, depth) AS up, arg_max(dl, depth) AS dl FROM a JOIN d USING (up) GROUP BY dir),
y AS (SELECT o.*, dl, CASE WHEN own IS NOT NULL THEN 'header' WHEN dl IS NOT NULL THEN 'inherited' ELSE 'none' END AS how, CASE WHEN own IS NULL THEN up END AS inherited_from FROM o LEFT JOIN n USING (dir))
SELECT {out} FROM y"""


def _repair() -> str:
    """The cheapest, ASCII-least edits of each conversation by the least (cost, letters, messages) of every suffix and state (b0 nothing yet, bs, bu, ba)."""
    way = lambda to, letter, cost, said=None: f"CASE WHEN {to} IS NOT NULL THEN {{'c': {to}.c + {cost}, 'a': '{letter}' || {to}.a, 's': {f'list_prepend({said}, {to}.s)' if said else f'{to}.s'}}} END"
    keep = lambda initial, to: f"CASE WHEN stays AND initial = '{initial}' THEN {way(to, 'K', 'more', 'role || chr(58) || text')} END"
    name = lambda as_, to: f"CASE WHEN stays THEN {way(to, 'R', '3 + more', f"'{as_}:' || text")} END"
    add = lambda as_, to: way(to, "I", 3, f"'{as_}:'")
    first = {
        "b0": f"least({way('b0', 'D', 4)}, {keep('s', 'bs')}, {keep('u', 'bu')}, {name('user', 'bu')})",
        "bs": f"least({way('bs', 'D', 4)}, {keep('u', 'bu')}, {name('user', 'bu')})",
        "bu": f"least({way('bu', 'D', 4)}, {keep('a', 'ba')}, {name('assistant', 'ba')})",
        "ba": f"least({way('ba', 'D', 4)}, {keep('u', 'bu')}, {name('user', 'bu')})",
    }
    pair = f"least(bu, {add('assistant', 'ba')}) AS bu, least(ba, {add('user', 'bu')}) AS ba"
    closed = f"least(b0, {add('user', 'bu')}) AS b0, least(bs, {add('user', 'bu')}) AS bs, bu, ba"
    end, none = "{'c': 0, 'a': '', 's': []::VARCHAR[]}", "NULL::STRUCT(c INTEGER, a VARCHAR, s VARCHAR[])"
    spaces = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
WITH RECURSIVE tb AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
ky AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS k FROM conversations),
hs AS (SELECT conv_id, turn, role, text, xor(list_reduce(k, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS h FROM ky, tb),
dm AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS again FROM hs WHERE h <> 0),
nr AS (SELECT conv_id, turn, role, text, rtrim(text, {spaces}) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM dm),
fa AS (SELECT *, left(role, 1) AS initial, CASE WHEN t = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM nr),
o AS (SELECT *, fault IN ('', 'truncated') AS stays, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM fa),
z AS (SELECT conv_id, n AS i, {none} AS bs, {none} AS bu, {end} AS b0, {end} AS ba FROM o GROUP BY conv_id, n),
st AS (SELECT conv_id, i, {closed} FROM (SELECT conv_id, i, b0, bs, {pair} FROM z)
  UNION ALL SELECT conv_id, i, {closed} FROM (SELECT conv_id, i, b0, bs, {pair} FROM (SELECT o.conv_id, st.i - 1 AS i, {', '.join(f'{v} AS {k}' for k, v in first.items())} FROM st JOIN o ON o.conv_id IS NOT DISTINCT FROM st.conv_id AND o.i = st.i))),
su AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM o GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b0.c, 0)::BIGINT AS cost, coalesce(b0.a, '') AS audit, sha256(coalesce(array_to_string(b0.s, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN su ON su.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM c.conv_id AND st.i = 0"""


ORACLES = {
    "op11_conversation_repair": _repair(),
    "op2_license_scan": _licences(
        "SELECT doc_id, concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), coalesce(lpad(doc_id::VARCHAR, 20, '0'), '-')) AS path, text, 2 * len(w) >= len(v) AND len(w) > 0 AS given FROM (SELECT *, "
        + _WORDS.format(x=_HEADER) + " AS w, " + _WORDS.format(x="coalesce(text, '')") + " AS v FROM documents)",
        "doc_id, own AS own_licence, score AS own_score, coalesce(own, dl) AS licence, how, inherited_from",
    ),
    "licence_tree": _licences(
        "SELECT NULL AS doc_id, concat_ws('/', source, lang, doc_id % 5, doc_id) AS path, text, false AS given FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL "
        f"UNION ALL SELECT NULL, source || '/LICENSE', {_notices('n')}, false FROM (SELECT source, count(*) AS n FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL GROUP BY source) WHERE n % 2 = 0 "
        f"UNION ALL SELECT NULL, source || '/' || lang || '/COPYING', {_notices('n // 3')}, false FROM (SELECT source, lang, count(*) AS n FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL GROUP BY source, lang) WHERE n % 3 = 0",
        "path, own AS own_licence, coalesce(own, dl) AS licence, how, inherited_from",
    ),
    "op9_chat_quotes": r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS uid, conv_id, turn, role, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS raw FROM conversations),
l AS (SELECT uid, conv_id, turn, role, unnest(raw) AS x, generate_subscripts(raw, 1) AS i FROM m),
p AS (SELECT uid, conv_id, turn, role, i, length(regexp_replace(regexp_extract(x, '^(?:[ \t]?>)+'), '[^>]', '', 'g')) AS level, trim(regexp_replace(x, '^(?:[ \t]?>)+', '')) AS body FROM l),
a AS (SELECT *, lead(level) OVER w AS level1, lead(body) OVER w AS body1, lead(level, 2) OVER w AS level2 FROM p WINDOW w AS (PARTITION BY uid ORDER BY i)),
k AS (SELECT * FROM a WHERE NOT (level = 0 AND regexp_matches(body, '^(?:On .{1,200} wrote|Am .{1,200} schrieb .{1,100}|Le .{1,200} a écrit ?|El .{1,200} escribió)\s*:\s*$') AND coalesce(level1 > 0 OR (body1 = '' AND level2 > 0), false))),
g AS (SELECT *, sum(CASE WHEN lag_level IS NULL OR lag_level <> level OR lag_body = '' THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY i) AS grp
      FROM (SELECT *, lag(level) OVER (PARTITION BY uid ORDER BY i) AS lag_level, lag(body) OVER (PARTITION BY uid ORDER BY i) AS lag_body FROM k)),
q AS (SELECT uid, any_value(conv_id) AS conv_id, any_value(turn) AS turn, any_value(level) AS level, trim(regexp_replace(lower(string_agg(body, ' ' ORDER BY i)), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM g GROUP BY uid, grp),
f AS (SELECT conv_id, norm, min(turn) AS said FROM q WHERE level = 0 AND norm <> '' GROUP BY ALL),
j AS (SELECT q.uid, count(*) AS n_quotes, count(*) FILTER (WHERE said < turn) AS n_linked, max_by(said, (-level, said)) FILTER (WHERE said < turn) AS linked
      FROM q LEFT JOIN f ON q.conv_id = f.conv_id AND q.norm = f.norm WHERE level > 0 AND q.norm <> '' GROUP BY q.uid),
b AS (SELECT uid, regexp_replace(regexp_replace(string_agg(body, chr(10) ORDER BY i), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g') AS body FROM k WHERE level = 0 GROUP BY uid),
t AS (SELECT DISTINCT conv_id, turn + 1 AS turn FROM m),
y AS (SELECT m.uid, m.conv_id, m.turn, role, coalesce(linked, CASE WHEN t.turn IS NOT NULL THEN m.turn - 1 END) AS reply_to, coalesce(n_quotes, 0)::BIGINT AS n_quotes, coalesce(n_linked, 0)::BIGINT AS n_linked,
  length(coalesce(b.body, ''))::BIGINT AS body_chars, md5(coalesce(b.body, '')) AS body_md5
  FROM m LEFT JOIN j USING (uid) LEFT JOIN b USING (uid) LEFT JOIN t ON m.conv_id = t.conv_id AND m.turn = t.turn),
n AS (SELECT conv_id, turn, max(reply_to) AS up FROM y WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
r AS (SELECT conv_id, turn, turn AS thread, 0::BIGINT AS depth FROM n WHERE up IS NULL UNION ALL SELECT n.conv_id, n.turn, r.thread, r.depth + 1 FROM n JOIN r ON n.conv_id = r.conv_id AND n.up = r.turn)
SELECT y.conv_id, y.turn, role, reply_to, coalesce(r.thread, y.turn) AS thread, coalesce(r.depth, 0)::BIGINT AS depth, n_quotes, n_linked, body_chars, body_md5 FROM y LEFT JOIN r ON y.conv_id = r.conv_id AND y.turn = r.turn""",
    "op4_quality_rules": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM w),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
p AS (SELECT DISTINCT doc_id, i + k AS at FROM h, (VALUES (0), (1), (2)) o(k) WHERE n > 1),
r AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(t, '[^!]+', '', 'g')) AS n_shouts, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
  len(l) AS n_lines, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis_lines,
  len(list_filter(w, lambda x: regexp_matches(lower(x), '^["''(]?({_STOPS})[.,;:!?)"'']*$'))) AS n_stop,
  len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(word_chars / nullif(n_words, 0) BETWEEN 2 AND 16, true) AND coalesce(n_symbols / nullif(n_words, 0) <= 0.3, true)
  AND coalesce(n_shouts / nullif(n_words, 0) <= 0.3, true) AND coalesce(n_upper / nullif(word_chars, 0) <= 0.5, true)
  AND coalesce(n_stop / nullif(n_words, 0) >= 0.02, true) AND coalesce(n_letter_words / nullif(n_words, 0) >= 0.6, true)
  AND coalesce(n_dup_lines / nullif(n_lines, 0) <= 0.5, true) AND coalesce(n_ellipsis_lines / nullif(n_lines, 0) <= 0.5, true) AS kept
FROM b""",
    "op12_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM t WINDOW w AS (PARTITION BY t)""",
    "op13_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
q AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT id, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM q),
m AS (SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM t WINDOW o AS (PARTITION BY id ORDER BY i)),
g AS (SELECT lang, 1 AS k, w AS phrase FROM m UNION ALL SELECT lang, 2, w || ' ' || w2 FROM m WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM m WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM m WHERE w4 IS NOT NULL),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
x AS (SELECT c.lang, c.phrase, c.a, s, fl.a AS l, fr.a AS r, 2000000::HUGEINT * c.a // (fl.a + fr.a) AS score FROM c JOIN (VALUES (1), (2), (3)) v(s) ON s < c.k
  JOIN f fl ON fl.lang = c.lang AND fl.phrase = array_to_string(w[1:s], ' ') JOIN f fr ON fr.lang = c.lang AND fr.phrase = array_to_string(w[s + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, s) = 1),
i AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM c JOIN (VALUES (2), (3)) v(m) ON m < k) GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""",
}
_MAIL = """qc AS (SELECT m.conv_id, m.turn, m.role, coalesce('On Monday someone wrote:' || chr(10) || '> ' || replace(a.text, chr(10), chr(10) || '> ') || chr(10) || chr(10), '')
  || coalesce('> ' || replace(b.text, chr(10), chr(10) || '> ') || chr(10) || chr(10), '') || coalesce(m.text, '') AS text FROM conversations m
  LEFT JOIN conversations a ON a.conv_id = m.conv_id AND a.turn = m.turn - 1 AND m.role = 'assistant' LEFT JOIN conversations b ON b.conv_id = m.conv_id AND b.turn = m.turn - 3 AND m.role = 'user' AND m.turn % 3 = 0),
m AS"""
ORACLES["chat_quotes_linked"] = ORACLES["op9_chat_quotes"].replace("FROM conversations)", "FROM qc)").replace("m AS", _MAIL, 1)
