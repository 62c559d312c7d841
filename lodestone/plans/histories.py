"""Queries over traces, chats and evaluation sets.

``events`` stands for stage rows: a trace is a run of eight event ids, the
event type its stage, the value its duration. ``conversations`` are the chats.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import chats, evalset, traces
from .relational import table

QUERIES, ORACLES = {}, {}
TYPES = ("signup", "view", "click", "purchase", "error")


def query(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


_S = "s AS (SELECT event_id // 8 AS trace_id, event_type AS stage, sum(value) AS duration_ms, count(*) AS n FROM events GROUP BY ALL)"


def _stages(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.floor(F.col("event_id") / 8).alias("trace_id"), F.col("event_type").alias("stage")).agg(F.sum("value").alias("duration_ms"), F.count("*").alias("n"))


@query(f"WITH {_S} SELECT trace_id, " + ", ".join(f"round(max(duration_ms) FILTER (WHERE stage = '{t}'), 4) AS {t}" for t in TYPES) + " FROM s GROUP BY trace_id")
def trace_wide(spark, sf):
    w = traces.wide(_stages(spark, sf), TYPES)
    return w.select("trace_id", *[F.round(t, 4).alias(t) for t in TYPES])


@query(f"WITH {_S}, r AS (SELECT trace_id, stage, round(duration_ms, 4) AS duration_ms FROM s) SELECT trace_id, round(sum(duration_ms), 6) AS total_ms, arg_max(stage, (duration_ms, -ascii(stage) * 1000 - ascii(substring(stage, 2, 1)))) AS slowest_stage, max(duration_ms) AS slowest_ms FROM r GROUP BY trace_id")
def trace_bottleneck(spark, sf):
    return traces.bottleneck(_stages(spark, sf).withColumn("duration_ms", F.round("duration_ms", 4)))


@query(f"WITH {_S}, a AS (SELECT trace_id, stage, n, list_position(['view', 'click', 'purchase'], stage) AS place FROM s WHERE stage IN ('view', 'click', 'purchase')) SELECT trace_id, stage, n, round(n / lag(n) OVER (PARTITION BY trace_id ORDER BY place), 6) AS efficiency FROM a")
def trace_funnel(spark, sf):
    return traces.funnel(_stages(spark, sf), ("view", "click", "purchase"))


_ST = "t AS (SELECT event_id // 8 AS trace_id, CASE WHEN event_type = 'error' AND value > 20 THEN 'error' WHEN event_type = 'error' THEN 'running' WHEN event_type = 'signup' THEN 'skipped' ELSE 'success' END AS status FROM events)"


@query(f"WITH {_ST} SELECT trace_id, CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_and(status IN ('success', 'skipped')) THEN 'success' ELSE 'partial' END AS status FROM t GROUP BY trace_id")
def trace_status(spark, sf):
    e = table(spark, sf, "events")
    is_error = F.col("event_type") == "error"
    status = F.when(is_error & (F.col("value") > 20), "error").when(is_error, "running").when(F.col("event_type") == "signup", "skipped").otherwise("success")
    return traces.final_status(e.select(F.floor(F.col("event_id") / 8).alias("trace_id"), status.alias("status")))


@query(f"WITH {_S} SELECT trace_id, coalesce(list_filter(['signup', 'view', 'click', 'purchase'], lambda x: NOT list_contains(have, x))[1], 'unknown') AS failed_stage FROM (SELECT trace_id, list(DISTINCT stage) AS have FROM s GROUP BY trace_id)")
def trace_first_missing(spark, sf):
    return traces.first_missing(_stages(spark, sf), TYPES[:4])


@query(f"WITH {_S}, a AS (SELECT stage, round(duration_ms, 4) AS d FROM s WHERE trace_id = 0), b AS (SELECT stage, round(duration_ms, 4) AS d FROM s WHERE trace_id = 1) SELECT coalesce(a.stage, b.stage) AS stage, coalesce(a.d, 0) AS a_ms, coalesce(b.d, 0) AS b_ms, round(coalesce(b.d, 0) - coalesce(a.d, 0), 6) AS diff_ms FROM a FULL OUTER JOIN b ON a.stage = b.stage")
def trace_compare(spark, sf):
    s = _stages(spark, sf).withColumn("duration_ms", F.round("duration_ms", 4))
    return traces.compare(s.where("trace_id = 0"), s.where("trace_id = 1"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def trace_latest(spark, sf):
    return traces.latest(table(spark, sf, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT e.event_id, e.user_id, e.ts FROM events e WHERE e.event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events d WHERE d.user_id = e.user_id AND d.event_type = 'purchase' AND d.ts > e.ts)")
def abandoned(spark, sf):
    """Starts without an end of the same user after them: the last end of each user decides, so no pairs are made."""
    e = table(spark, sf, "events")
    last = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("end_ts"))
    s = e.where("event_type = 'signup'").join(last, "user_id", "left")
    return s.where("end_ts IS NULL OR end_ts <= ts").select("event_id", "user_id", "ts")


@query("SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS n_success, count(*) FILTER (WHERE event_type = 'error') AS n_error, round(avg(value) FILTER (WHERE event_type <> 'error'), 6) AS avg_total, min(value) FILTER (WHERE event_type <> 'error') AS min_total, max(value) FILTER (WHERE event_type <> 'error') AS max_total, arg_min(event_id, (ts, event_id)) AS first_entry, arg_max(event_id, (ts, event_id)) AS last_entry FROM events GROUP BY user_id")
def session_summary(spark, sf):
    return traces.sessions(table(spark, sf, "events"), "user_id", "value", F.col("event_type") != "error", "ts", "event_id")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def retention(spark, sf):
    e = table(spark, sf, "events")
    return traces.retained(e, "ts", e.agg(F.max("ts")).scalar(), 10).select("event_id")


@query("SELECT event_id, user_id, sum(CASE WHEN event_type = 'view' THEN 1 WHEN event_type = 'click' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS depth FROM events")
def queue_depth(spark, sf):
    change = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", -1).otherwise(0)
    return traces.queue_depth(table(spark, sf, "events"), "user_id", "ts", "event_id", change).select("event_id", "user_id", "depth")


@query("SELECT user_id, pos, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS pos FROM events) WHERE pos <= 5")
def recent_chats(spark, sf):
    return chats.recent(table(spark, sf, "events"), "user_id", "ts", "event_id", 5).select("user_id", "pos", "event_id")


@query("SELECT conv_id, turn, role, pos FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS pos FROM conversations) WHERE pos <= 4")
def chat_messages(spark, sf):
    return chats.messages(table(spark, sf, "conversations"), "conv_id", "turn", 4).select("conv_id", "turn", "role", "pos")


@query("SELECT a.user_id AS \"user\", a.trace_id AS chat, CASE WHEN o.owner IS NULL THEN 'missing' WHEN o.owner = a.user_id THEN 'owner' ELSE 'other' END AS access FROM (SELECT DISTINCT user_id, event_id // 8 AS trace_id FROM events) a LEFT JOIN (SELECT event_id // 8 AS trace_id, arg_min(user_id, event_id) AS owner FROM events WHERE event_type = 'signup' GROUP BY ALL) o USING (trace_id)")
def chat_access(spark, sf):
    e = table(spark, sf, "events").withColumn("chat", F.floor(F.col("event_id") / 8))
    owners = e.where("event_type = 'signup'").groupBy("chat").agg(F.min_by("user_id", "event_id").alias("owner"))
    return chats.access(e.select("chat", F.col("user_id").alias("user")).distinct(), owners)


@query("SELECT conv_id, count(*) AS n, min(turn) AS first_at, max(turn) AS last_at, CASE WHEN length(arg_min(text, turn)) > 50 THEN substring(arg_min(text, turn), 1, 50) || '...' ELSE arg_min(text, turn) END AS name FROM conversations GROUP BY conv_id")
def thread_index(spark, sf):
    return chats.threads(table(spark, sf, "conversations"), "conv_id", "turn", "text")


@query("SELECT conv_id, n, rank, has_next FROM (SELECT *, row_number() OVER (ORDER BY n DESC, conv_id)::INT AS rank, 15 < count(*) OVER () AS has_next FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)) WHERE rank > 5 AND rank <= 15")
def chat_page(spark, sf):
    """The second page: ten threads after the fifth, by the keys of the fifth as a client holds them."""
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    order = [(-F.col("n")).alias("less"), F.col("conv_id")]
    fifth = t.orderBy(*order).limit(5).agg(F.max(F.struct(*order))).scalar()
    return chats.page(t, order, 10, fifth, before=5).select("conv_id", "n", "rank", "has_next")


@query("SELECT conv_id, turn, s.step::INT AS step, CASE s.step WHEN 0 THEN 'user_message' ELSE 'assistant_message' END AS type, md5(CASE s.step WHEN 0 THEN text ELSE answer END) AS output_md5 FROM (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations), (VALUES (0), (1)) s(step) WHERE role = 'user'")
def chat_steps(spark, sf):
    c = table(spark, sf, "conversations").withColumn("answer", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("role = 'user'")
    return chats.steps(c, ["conv_id", "turn"], "text", "answer").select("conv_id", "turn", "step", "type", F.md5(F.col("output").cast("binary")).alias("output_md5"))


@query("SELECT step_id, arg_max(entry_id, length(entry_id)) AS entry_id FROM (SELECT event_id::VARCHAR AS step_id FROM events) s JOIN (SELECT DISTINCT user_id::VARCHAR AS entry_id FROM events) e ON starts_with(step_id, entry_id) GROUP BY step_id")
def feedback_prefix(spark, sf):
    e = table(spark, sf, "events")
    f = chats.feedback(e.select(F.col("event_id").cast("string").alias("step_id"), F.lit(1).alias("value")), e.select(F.col("user_id").cast("string").alias("entry_id")).distinct())
    return f.select("step_id", "entry_id")


@query("SELECT user_id AS conversation_id, md5(coalesce(string_agg(event_id, '' ORDER BY event_id) FILTER (WHERE event_type = 'click'), '')) AS answer_md5, arg_max(event_id::VARCHAR, event_id) FILTER (WHERE event_type = 'view') AS context, bool_or(event_type = 'purchase') AS done FROM events GROUP BY user_id")
def event_fold(spark, sf):
    kind = F.when(F.col("event_type") == "click", "token").when(F.col("event_type") == "view", "context").when(F.col("event_type") == "purchase", "done").otherwise("status")
    e = table(spark, sf, "events").select(F.col("user_id").alias("conversation_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.col("event_id").cast("string").alias("payload"))
    return chats.fold_events(e).select("conversation_id", F.md5(F.col("answer").cast("binary")).alias("answer_md5"), "context", "done")


@query("SELECT doc_id, md5(doc_id || ':eval') AS draw FROM documents ORDER BY draw LIMIT 50")
def eval_sample(spark, sf):
    return evalset.sample(table(spark, sf, "documents"), "doc_id", 50, "eval").select("doc_id", "draw")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def eval_distribution(spark, sf):
    return evalset.distributions(table(spark, sf, "documents"), ["lang", "source"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def eval_unprocessed(spark, sf):
    return evalset.unprocessed(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id")


@query("SELECT 'v1' AS version, unnest(['single', 'multi', 'reasoning']) AS kind, unnest([175, 105, 70]) AS n UNION ALL SELECT 'v2', unnest(['factual', 'synthesis', 'comparison', 'edge']), unnest([240, 80, 40, 40])")
def eval_allocation(spark, sf):
    one = evalset.allocation(350, {"single": 0.5, "multi": 0.3, "reasoning": 0.2})
    two = evalset.allocation(400, {"factual": 0.6, "synthesis": 0.2, "comparison": 0.1, "edge": 0.1})
    return spark.createDataFrame([("v1", k, n) for k, n in one.items()] + [("v2", k, n) for k, n in two.items()], "version string, kind string, n int")


@query("SELECT doc_id, bool_or(d = 'KEEP') AS kept FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 'KEEP' ELSE 'OUT' END AS d FROM labels UNION ALL SELECT doc_id, CASE WHEN toxic = 0 THEN 'KEEP' ELSE 'OUT' END FROM labels) GROUP BY doc_id")
def kept_if_any(spark, sf):
    lab = table(spark, sf, "labels")
    pick = lambda c: F.when(c, "KEEP").otherwise("OUT")
    parts = lab.select("doc_id", pick(F.col("quality") == 1).alias("decision")).unionByName(lab.select("doc_id", pick(F.col("toxic") == 0).alias("decision")))
    return evalset.kept_if_any(parts, ["doc_id"])


@query("SELECT DISTINCT source, lang FROM documents")
def distinct_sources(spark, sf):
    return table(spark, sf, "documents").select("source", "lang").distinct()


@query("SELECT event_id, status FROM (SELECT event_id, event_type AS status FROM events WHERE event_type IN ('error', 'purchase'))")
def status_filter(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type").isin("error", "purchase")).select("event_id", F.col("event_type").alias("status"))


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the')")
def name_search(spark, sf):
    return table(spark, sf, "conversations").where(F.contains(F.lower("text"), F.lit("the"))).select("conv_id", "turn")


@query("SELECT user_id, event_id, value FROM events UNION ALL SELECT user_id, event_id, value FROM events WHERE false")
def upsert_latest(spark, sf):
    """Every event written twice, the second time with a new version: the second stays."""
    e = table(spark, sf, "events").select("user_id", "event_id", "value", F.lit(1).alias("version"))
    return chats.upsert(e.withColumn("version", F.lit(0)).withColumn("value", F.lit(-1.0)), e, "event_id", "version").select("user_id", "event_id", "value")
