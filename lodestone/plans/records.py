"""Queries that shape events, conversations and documents into records of the service."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as R
from .relational import table

QUERIES, ORACLES = {}, {}


def query(sql):
    def add(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return add


@query("SELECT event_id, 'data: {\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' || chr(10) || chr(10) AS line FROM events")
def sse_lines(spark, sf):
    return table(spark, sf, "events").select("event_id", R.sse_line("event_id", "event_type").alias("line"))


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 3")
def last_of_each_type(spark, sf):
    return R.keep_last(table(spark, sf, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 3).select("event_type", "event_id")


@query("SELECT o, count(*) AS n FROM (SELECT CASE WHEN (event_id % 4) * 90 = 0 THEN 'kept' WHEN value >= 5 THEN 'rotated' ELSE 'rejected' END AS o FROM events) GROUP BY o")
def rotation_outcomes(spark, sf):
    """Events as pages: a quarter turn for each step of the id, the value as the confidence."""
    o = R.rotation((F.col("event_id") % 4) * 90, F.col("value"))
    return table(spark, sf, "events").groupBy(o.alias("o")).agg(F.count("*").alias("n"))


@query("SELECT user_id, string_agg(event_id, ',' ORDER BY value DESC, event_id) AS top FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 20 GROUP BY user_id")
def top_of_maps(spark, sf):
    m = table(spark, sf, "events").groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_id", "value"))).alias("m"))
    return m.select("user_id", F.array_join(F.transform(R.top_of_map(F.col("m")), lambda e: e["key"].cast("string")), ",").alias("top"))


@query("SELECT event_id, round((epoch_us(ts) - epoch_us(p)) / 1000, 3) AS gap_ms FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NOT NULL")
def event_gaps(spark, sf):
    from pyspark.sql import Window as W

    e = table(spark, sf, "events").withColumn("p", F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.where("p is not null").select("event_id", F.round(R.millis(F.col("p"), F.col("ts")), 3).alias("gap_ms"))


@query("SELECT item_id, 'What is passage ' || item_id || ' about? ' || substring(text, 1, 20) AS question FROM benchmark")
def template_questions(spark, sf):
    q = R.filled("What is passage {id} about? {head}", id=F.col("item_id"), head=F.substring("text", 1, 20))
    return table(spark, sf, "benchmark").select("item_id", q.alias("question"))


@query("SELECT event_type AS stage, round(avg(length(props)), 4) AS avg_length, min(value) AS min_score, max(value) AS max_score, round(sum(length(props)) / nullif(sum(value), 0), 4) AS chars_per_s FROM events GROUP BY event_type")
def stage_metrics(spark, sf):
    return R.stage_metrics(table(spark, sf, "events"), "event_type", "props", "value", "value").withColumnRenamed("event_type", "stage")


@query("SELECT count(*) AS n, round(avg(t), 4) AS avg_total_ms, round(avg(q), 4) AS avg_queue_ms, round(sum(t) / max(t), 4) AS speed_up FROM (SELECT round(value * 4 * 1000, 4) AS t, round(value * 0.5 * 1000, 4) AS q FROM events)")
def concurrency(spark, sf):
    """Events as requests whose times are multiples of their value."""
    v = F.col("value")
    r = table(spark, sf, "events").select(F.col("event_id").alias("request_id"), (v * 0).alias("arrived"), (v * 0.5).alias("admitted"), (v * 1).alias("retrieved"), (v * 2).alias("first_token"), (v * 4).alias("finished"))
    return R.speed_up(R.request_metrics(r))


@query("SELECT source, count(*) FILTER (WHERE s = 'success') AS n_success, count(*) FILTER (WHERE s = 'skipped') AS n_skipped, count(*) FILTER (WHERE s = 'failed') AS n_failed FROM (SELECT source, CASE WHEN length(text) = 0 THEN 'failed' WHEN length(text) < 200 THEN 'skipped' ELSE 'success' END AS s FROM documents) GROUP BY ROLLUP (source)")
def job_counters(spark, sf):
    s = F.when(F.length("text") == 0, "failed").when(F.length("text") < 200, "skipped").otherwise("success")
    d = table(spark, sf, "documents").select("source", s.alias("s"))
    return d.rollup("source").agg(*[F.count_if(F.col("s") == x).alias(f"n_{x}") for x in ("success", "skipped", "failed")])


@query("SELECT conv_id, string_agg(role || ':' || length(text), ' ' ORDER BY turn) AS shape FROM conversations GROUP BY conv_id")
def zipped_roles(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("m"))
    z = R.zipped(F.col("m.role"), F.col("m.n"))
    return c.select("conv_id", F.array_join(F.transform(z, lambda s: F.concat_ws(":", s["name"], s["score"].cast("string"))), " ").alias("shape"))
