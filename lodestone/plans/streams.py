"""Streaming queries: each runs the stream over the table until it is drained, and equals its batch twin.

Windows are appended once the watermark, ten minutes behind the last event, has passed them; the twins hold the same windows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as S
from ..streaming import requests as R
from .relational import table

QUERIES, ORACLES = {}, {}


def _stream(spark, sf_dir):
    """The event table as a stream, with plain timestamps."""
    batch = table(spark, sf_dir, "events")
    e = spark.readStream.schema(batch.schema).parquet(sf_dir, pathGlobFilter="events.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _ntz(name):
    return F.col(name).cast("timestamp_ntz").alias(name)


def stream_hourly(spark, sf_dir):
    return S.drain(S.windows(_stream(spark, sf_dir), "1 hour")).select(_ntz("start"), "event_type", "n", "total")


def stream_sliding(spark, sf_dir):
    return S.drain(S.windows(_stream(spark, sf_dir), "6 hours", "3 hours")).select(_ntz("start"), "event_type", "n", "total")


def stream_sessions(spark, sf_dir):
    return S.drain(S.sessions(_stream(spark, sf_dir))).select("user_id", _ntz("start"), _ntz("end"), "n")


def stream_fold(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "token").when(F.col("event_type") == "purchase", "done").otherwise("status")
    e = _stream(spark, sf_dir).select(F.col("user_id").alias("conversation_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.col("event_id").cast("string").alias("payload"))
    d = S.drain_latest(S.token_state(e), "conversation_id")
    return d.select("conversation_id", F.md5(F.col("answer").cast("binary")).alias("answer_md5"), "done")


def stream_distinct(spark, sf_dir):
    """Each event doubled and then cut to one within the watermark."""
    e = _stream(spark, sf_dir).select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("again"))
    return S.drain(S.distinct_events(e).select("event_id", _ntz("ts")))


def stream_join(spark, sf_dir):
    """Two streams: a user's clicks and the purchases that follow each within six hours."""
    clicks = _stream(spark, sf_dir).where("event_type = 'click'").select(F.col("user_id").alias("id"), "ts", F.col("event_id").alias("click_id"))
    bought = _stream(spark, sf_dir).where("event_type = 'purchase'").select(F.col("user_id").alias("done_id"), F.col("ts").alias("done_ts"), F.col("event_id").alias("purchase_id"))
    j = S.drain(S.started_and_done(clicks, bought, "6 hours"))
    return j.where("purchase_id is not null").select(F.col("id").alias("user_id"), "click_id", "purchase_id")


def stream_abandoned(spark, sf_dir):
    """Clicks that no purchase of the same user followed within an hour, once the watermark says that none can come."""
    clicks = _stream(spark, sf_dir).where("event_type = 'click'").select(F.col("user_id").alias("id"), "ts", F.col("event_id").alias("click_id"))
    bought = _stream(spark, sf_dir).where("event_type = 'purchase'").select(F.col("user_id").alias("done_id"), F.col("ts").alias("done_ts"))
    j = S.drain(S.started_and_done(clicks, bought))
    return j.where("done_id is null").groupBy(F.col("id").alias("user_id")).agg((F.count("*") > 0).alias("abandons"))


def stream_requests(spark, sf_dir):
    """Eight events are a request: its clicks are tokens, a purchase ends it, and after twenty minutes without one a timer does."""
    kind = F.when(F.col("event_type") == "click", "token").when(F.col("event_type") == "purchase", "done").otherwise("status")
    rows = _stream(spark, sf_dir).select(F.floor(F.col("event_id") / 8).alias("request_id"), F.col("event_id").alias("seq"), "ts", kind.alias("type"), F.concat(F.col("event_id").cast("string"), F.lit(" ")).alias("payload"))
    with R.rocksdb(spark):
        d = S.drain(R.outcomes(rows, "20 minutes"))
    return d.select("request_id", "status", _ntz("started"), _ntz("ended"), "n_tokens", "answer")


QUERIES |= {f.__name__: f for f in (stream_hourly, stream_sliding, stream_sessions, stream_fold, stream_distinct, stream_join, stream_abandoned, stream_requests)}
_MARK = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)"
ORACLES |= {
    "stream_requests": f"""WITH e AS (SELECT event_id // 8 AS request_id, event_id, ts, event_type, min(ts) OVER (PARTITION BY event_id // 8) AS started FROM events),
d AS (SELECT request_id, any_value(started) AS started, coalesce(min(ts) FILTER (WHERE event_type = 'purchase' AND ts <= started + INTERVAL 20 MINUTE), any_value(started) + INTERVAL 20 MINUTE) AS ended,
  CASE WHEN count(*) FILTER (WHERE event_type = 'purchase' AND ts <= started + INTERVAL 20 MINUTE) > 0 THEN 'complete' ELSE 'abandoned' END AS status FROM e GROUP BY request_id)
SELECT request_id, any_value(status) AS status, any_value(d.started) AS started, any_value(ended) AS ended, count(*) FILTER (WHERE event_type = 'click' AND ts <= ended) AS n_tokens,
  coalesce(string_agg(event_id || ' ', '' ORDER BY ts, event_id) FILTER (WHERE event_type = 'click' AND ts <= ended), '') AS answer FROM d JOIN e USING (request_id) WHERE ended < {_MARK} GROUP BY request_id""",
    "stream_abandoned": """SELECT c.user_id, true AS abandons FROM events c WHERE c.event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = c.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 1 HOUR)
AND c.ts + INTERVAL 1 HOUR < (SELECT least(max(ts) FILTER (WHERE event_type = 'click'), max(ts) FILTER (WHERE event_type = 'purchase')) - INTERVAL 10 MINUTE FROM events) GROUP BY c.user_id""",
    "stream_hourly": f"SELECT \"start\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT date_trunc('hour', ts) AS \"start\", event_type, value FROM events) WHERE \"start\" + INTERVAL 1 HOUR <= {_MARK} GROUP BY ALL",
    "stream_sliding": f"SELECT s AS \"start\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, time_bucket(INTERVAL 3 HOUR, ts) - to_hours(k * 3) AS s FROM events, (VALUES (0), (1)) t(k)) GROUP BY ALL HAVING s + INTERVAL 6 HOUR <= {_MARK}",
    "stream_sessions": f"""SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM (SELECT user_id, ts, sum(new_s::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s
FROM (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE, true) AS new_s FROM events)) GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= {_MARK}""",
    "stream_fold": "SELECT user_id AS conversation_id, md5(coalesce(string_agg(event_id, '' ORDER BY event_id) FILTER (WHERE event_type = 'click'), '')) AS answer_md5, max((event_type = 'purchase')::INT) AS done FROM events GROUP BY user_id",
    "stream_distinct": "SELECT event_id, ts FROM events",
    "stream_join": "SELECT c.user_id, c.event_id AS click_id, p.event_id AS purchase_id FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 6 HOUR WHERE c.event_type = 'click' AND p.event_type = 'purchase'",
}
