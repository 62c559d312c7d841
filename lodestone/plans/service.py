"""Queries of the service's records: claims, matched records, titles, owners' traces, sinks' shapes, sketches, hints, the model-free stand-in.

``conversations`` are the chats; a chat's owner is u1, u2 or u3 by its id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chats, evalset, mock, rerank, sketches, traces
from ..sources import corpus
from .relational import table

QUERIES, ORACLES = {}, {}


def query(sql):
    def add(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return add


@query(r"""SELECT conv_id, turn, i - 1 AS claim_idx, c[i] AS claim FROM (SELECT conv_id, turn, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT conv_id, turn, list_filter(f, lambda x, i: list_position(list_transform(f, lambda y: lower(y)), lower(x)) = i) AS c FROM (
SELECT conv_id, turn, list_filter(list_transform(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: CASE WHEN regexp_matches(x, '^[0-9]+[.)]\s*.+$') THEN CASE WHEN length(trim(regexp_extract(x, '^[0-9]+[.)]\s*(.+)$', 1))) > 5 THEN trim(regexp_extract(x, '^[0-9]+[.)]\s*(.+)$', 1)) END
  WHEN length(x) > 20 AND NOT regexp_matches(x, '^[0-9]') THEN x END), lambda x: x IS NOT NULL) AS f FROM conversations)))""")
def listed_claims(spark, sf):
    """Messages read as a model's list of claims."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(T.listed_claims(F.col("text"))).alias("claim_idx", "claim"))
    return c.select("conv_id", "turn", F.col("claim_idx").cast("long").alias("claim_idx"), "claim")


def _records(spark, sf):
    """Events as records (user, kind, value) with a place, and the same records to be found again."""
    e = table(spark, sf, "events")
    all_ = e.select("user_id", "event_type", F.round("value", 0).alias("value"), F.col("event_id").alias("orig_rank"), "ts")
    ranked = e.select("user_id", "event_type", F.round("value", 0).alias("value"))
    return ranked, all_


_RANKED = "ranked AS (SELECT user_id, event_type, round(value, 0) AS value FROM events)"


@query(f"WITH {_RANKED} SELECT user_id, event_type, value, (SELECT min(event_id) FROM events e WHERE e.user_id = r.user_id AND e.event_type = r.event_type) AS orig_rank FROM ranked r")
def records_by_key(spark, sf):
    ranked, all_ = _records(spark, sf)
    return rerank.matched(ranked, all_, ["user_id", "event_type"], ["ts"]).drop("ts")


@query(f"WITH {_RANKED} SELECT user_id, event_type, value, (SELECT min(event_id) FROM events e WHERE e.user_id = r.user_id AND e.event_type = r.event_type AND round(e.value, 0) = r.value) AS orig_rank FROM ranked r")
def records_whole(spark, sf):
    ranked, all_ = _records(spark, sf)
    return rerank.matched(ranked, all_, ["user_id", "event_type", "value"], ["ts"]).drop("ts")


def _chats(spark, sf):
    c = table(spark, sf, "conversations").where("turn = 0")
    owner = F.concat(F.lit("u"), (F.col("conv_id") % 3 + 1).cast("string"))
    title = F.when(F.col("conv_id") % 2 == 0, F.lit("kept"))
    return c.select(F.col("conv_id").alias("chat"), owner.alias("owner"), title.alias("title"), F.concat(F.lit("u"), (F.col("conv_id") % 4 + 1).cast("string")).alias("user"), F.substring("text", 1, 20).alias("new"))


_OWNED = "c AS (SELECT conv_id AS chat, 'u' || (conv_id % 3 + 1) AS owner, CASE WHEN conv_id % 2 = 0 THEN 'kept' END AS title, 'u' || (conv_id % 4 + 1) AS usr, substring(text, 1, 20) AS new FROM conversations WHERE turn = 0)"


@query(f"WITH {_OWNED} SELECT chat, owner, CASE WHEN title IS NULL AND owner = usr THEN new ELSE title END AS title FROM c")
def titles_set(spark, sf):
    """Each chat is offered a title by some user; it takes it from its owner, if it has none."""
    c = _chats(spark, sf)
    return chats.retitled(c.select("chat", "owner", "title"), c.select("chat", "user", F.col("new").alias("title")))


@query(f"WITH {_OWNED} SELECT chat, usr AS \"user\", CASE WHEN owner = usr THEN 'owner' ELSE 'other' END AS access, CASE WHEN owner = usr THEN t.turn END AS turn FROM c LEFT JOIN conversations t ON t.conv_id = c.chat AND owner = usr")
def chat_traces(spark, sf):
    """A chat's trace (its turns) is shown to its owner only."""
    c = _chats(spark, sf)
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("chat"), "turn")
    return chats.traces_of(c.select("chat", "user"), c.select("chat", "owner"), t).select("chat", "user", "access", "turn")


@query("SELECT user_id, event_id, pos FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS pos FROM events) WHERE pos <= 50")
def traces_by_conversation(spark, sf):
    """Newest first, fifty at most."""
    return chats.recent(table(spark, sf, "events"), "user_id", "ts", "event_id", 50).select("user_id", "event_id", "pos")


@query("SELECT event_id, (props->>'k')::INT AS k FROM events WHERE event_id = 11")
def trace_by_key(spark, sf):
    return corpus.trace(table(spark, sf, "events"), "event_id", 11, "props", "k int").select("event_id", "props.k")


@query("SELECT source, count(*) AS n, true AS close FROM documents GROUP BY source")
def approximate_distinct(spark, sf):
    """HyperLogLog sketches by language, merged by source: within 3 % of the exact numbers."""
    d = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.hll_sketch_agg("doc_id", F.lit(14)).alias("sketch"), F.approx_count_distinct("doc_id", 0.01).alias("a"))
    merged = d.groupBy("source").agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("est"), F.sum("a").alias("a"))
    near = lambda c: F.abs(F.col(c) - F.col("n")) <= F.ceil(F.col("n") * 0.03)
    return merged.select("source", "n", (near("est") & near("a")).alias("close"))


@query("SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def hinted_join(spark, sf):
    """A nation table has a bound by nature, so its broadcast may be asked for; the other join hints are merge, shuffle_hash and shuffle_replicate_nl."""
    j = table(spark, sf, "customer").join(table(spark, sf, "nation").hint("broadcast"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT doc_id, array_to_string(list_filter(p, lambda x: length(x) >= 40), chr(10) || chr(10)) AS text, len(p) AS total, len(list_filter(p, lambda x: length(x) >= 40)) AS kept, len(p) - len(list_filter(p, lambda x: length(x) >= 40)) AS removed FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)")
def filtered_texts(spark, sf):
    """What a filter of short lines leaves of each document, and its counts."""
    p = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "paragraph")).withColumn("kept", F.length("paragraph") >= 40)
    return corpus.filtered(p).select("doc_id", "text", *[F.col(c).cast("long").alias(c) for c in ("total", "kept", "removed")])


@query("SELECT event_id, user_id::BIGINT AS user_id, value, strftime(ts, '%Y-%m-%d') AS day, '{\"a\":' || event_id || '}' AS nested FROM events")
def plain_metadata(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "value", F.to_date("ts").alias("day"), F.struct(F.col("event_id").alias("a")).alias("nested"))
    return corpus.plain_metadata(e, ["user_id", "value", "day", "nested"])


@query("SELECT event_id, event_type FROM events")
def listing_without_payload(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", F.col("props").alias("props_data"), F.col("value").alias("value_data"))
    return corpus.without_payload(e)


_TEMPLATES = {"factual": "What does document {id} say about {head}?", "summary": "Summarise document {id}.", "comparison": "How does document {id} differ from others?"}
_COUNTS = evalset.allocation(40, {"factual": 0.5, "summary": 0.3, "comparison": 0.2})


def _questions_sql():
    say = {"factual": "'What does document ' || doc_id || ' say about ' || substring(text, 1, 20) || '?'", "summary": "'Summarise document ' || doc_id || '.'", "comparison": "'How does document ' || doc_id || ' differ from others?'"}
    return " UNION ALL ".join(f"SELECT doc_id, '{k}' AS question_type, {say[k]} AS question FROM (SELECT doc_id, text FROM documents ORDER BY md5(doc_id || ':q:{k}') LIMIT {n})" for k, n in _COUNTS.items())


@query(_questions_sql())
def eval_questions(spark, sf):
    """Forty questions in three kinds, their documents drawn by hash; the number of questions is the feature."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return evalset.questions(d, "doc_id", _TEMPLATES, _COUNTS, "q", id=F.col("doc_id"), head=F.substring("text", 1, 20))


@query("SELECT item_id AS query_id, 'No model was asked. The question was: ' || trim(text) AS answer, 3 AS n_sources, 'generation' AS slowest FROM benchmark WHERE length(trim(text)) > 0")
def mock_answers(spark, sf):
    """The service without models: answers, sources and a trace for each query."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    slow = traces.bottleneck(mock.stages(q)).select(F.col("trace_id").alias("query_id"), F.col("slowest_stage").alias("slowest"))
    return mock.answers(q).join(slow, "query_id").select("query_id", "answer", F.size("sources").alias("n_sources"), "slowest")


@query("SELECT item_id AS conversation_id, md5('No model was asked. The question was: ' || trim(text)) AS answer_md5, true AS done FROM benchmark WHERE length(trim(text)) > 0")
def mock_events(spark, sf):
    """The events of the stand-in fold to its answers."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return chats.fold_events(mock.events(q)).select("conversation_id", F.md5(F.col("answer").cast("binary")).alias("answer_md5"), "done")


_AT = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def _by_day(spark, sf):
    e = table(spark, sf, "events").select("event_type", "ts", "value")
    hours = corpus.stored(sketches.hourly(e, "value", "ts", ["event_type"]))
    return e.withColumn("day", F.date_trunc("day", "ts")), sketches.quantiles(sketches.merged(hours, ["event_type"]), _AT)


def latency_by_day(spark, sf):
    """event_type, day, n and three quantiles, out of the stored sketches of hours; n values were never sorted."""
    return _by_day(spark, sf)[1]


QUERIES["latency_by_day"] = latency_by_day


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, true AS p50_holds, true AS p90_holds, true AS p99_holds FROM events GROUP BY ALL")
def latency_errors_hold(spark, sf):
    """Each quantile of the merged sketches against all values: its rank is off by a hundredth at most, twice what the size promises."""
    e, found = _by_day(spark, sf)
    held = sketches.rank_error(e, "value", found, ["event_type", "day"], _AT)
    return held.select("event_type", F.col("day").cast("timestamp_ntz").alias("day"), "n", *[(F.col(f"{x}_error") <= 0.01).alias(f"{x}_holds") for x in _AT])
