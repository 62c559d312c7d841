"""Requests as a stateful stream: tokens folded in order, an end or a timeout, by event-time timers.

A request opens with its first row. It is complete with its first row of type
``done`` and abandoned when none comes within the timeout. Rows may come in any
order as late as the watermark allows, so an outcome is given only when the
watermark has passed it: a timer stands at the end of the request as known so
far and is moved when an earlier row or end comes. What comes after a request's
end is left out; the request is remembered until a second timer forgets it.

Requests share a key of the state by hash (``GROUPS``), so that frames of many
are folded at once and not each by calls of its own; a key's timer stands at the
first end of any. State of a key: the rows of its requests until their outcomes,
then their ids. Rows without a key, time or number are dropped; a row that
repeats another counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Keys of the state, whatever the number of requests.
GROUPS = 1 << 10
OUT = "request_id {kind}, status string, started timestamp, ended timestamp, n_tokens long, answer string"


def fold(rows: list[tuple[int, int, str, str]], timeout: int) -> tuple[str, int, int, list[str]]:
    """rows (micros, seq, type, payload) of one request -> (status, started, ended, tokens)."""
    rows = sorted(set(rows), key=lambda r: (r[0], r[1]))
    started = rows[0][0]
    tokens = []
    for at, _, kind, payload in rows:
        if at > started + timeout:
            break
        if kind == "done":
            return "complete", started, at, tokens
        if kind == "token":
            tokens.append(payload or "")
    return "abandoned", started, started + timeout, tokens


def folded(rows: pd.DataFrame, timeout: int) -> pd.DataFrame:
    """rows(request_id, at, seq, type, payload) of many requests -> (request_id, status, started, ended, n_tokens, answer), as ``fold`` has them; times in microseconds."""
    rows = rows.drop_duplicates().sort_values(["at", "seq"], kind="stable", ignore_index=True)
    code, ids = pd.factorize(rows.request_id)
    at, kind, n = rows["at"].to_numpy(), rows["type"].to_numpy(), len(ids)
    started = at[np.unique(code, return_index=True)[1]] if n else at
    within = at <= started[code] + timeout
    done = np.flatnonzero(within & (kind == "done"))
    which, nth = np.unique(code[done], return_index=True)
    stop = np.full(n, len(rows))
    stop[which] = done[nth]
    ended = started + timeout
    ended[which] = at[done[nth]]
    token = within & (kind == "token") & (np.arange(len(rows)) < stop[code])
    answers = [[] for _ in range(n)]
    for c, payload in zip(code[token], rows.payload.to_numpy()[token]):
        answers[c].append(payload or "")
    status = np.where(stop < len(rows), "complete", "abandoned")
    return pd.DataFrame({"request_id": ids, "status": status, "started": started, "ended": ended, "n_tokens": [len(x) for x in answers], "answer": ["".join(x) for x in answers]})


def _packed(frame: pd.DataFrame) -> tuple[bytes]:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return (out.getvalue().to_pybytes(),)


def _unpacked(state) -> pd.DataFrame | None:
    frames = [pa.ipc.open_stream(x[0]).read_pandas() for x in state.get()]
    return pd.concat(frames, ignore_index=True) if frames else None


class Requests(StatefulProcessor):
    """Many requests a key; times in microseconds, timers in milliseconds."""

    def __init__(self, timeout: int, remember: int) -> None:
        self.timeout, self.remember = timeout, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "frame binary")
        self.over = handle.getListState("over", "frame binary")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int, before: int | None) -> None:
        if at != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (before,) = self.timer.get() or (None,)
        soon = [before] if before is not None else []
        for frame in rows:
            # No request ends before its first row of type done, nor before the timeout of its first row.
            ends = [frame["at"].min() + self.timeout, *frame["at"][frame["type"] == "done"].nsmallest(1)]
            soon.append(-(-int(min(ends)) // 1000))
            self.rows.appendValue(_packed(frame[["request_id", "at", "seq", "type", "payload"]]))
        if soon:
            self._wake(min(soon), before)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows, over = _unpacked(self.rows), _unpacked(self.over)
        waits, made = [], None
        if rows is not None and over is not None:
            rows = rows[~rows.request_id.isin(over.request_id)]
        if rows is not None:
            found = folded(rows, self.timeout)
            due = -(-found.ended // 1000)
            made = found[due <= now]
            rows = rows[~rows.request_id.isin(made.request_id)]
            self.rows.clear()
            if len(rows):
                self.rows.appendValue(_packed(rows))
                waits.append(int(due[due > now].min()))
        held = over[over.until > now] if over is not None else None
        if made is not None and len(made):
            new = pd.DataFrame({"request_id": made.request_id, "until": -(-made.ended // 1000) + self.remember // 1000})
            held = new if held is None else pd.concat([held, new], ignore_index=True)
        self.over.clear()
        if held is not None and len(held):
            self.over.appendValue(_packed(held))
            # Those that could be forgotten already go with the next watermark.
            waits.append(max(int(held.until.min()), now + 1))
        self.timer.clear()
        if waits:
            self._wake(min(waits), None)
        if made is not None and len(made):
            yield made.assign(started=pd.to_datetime(made.started, unit="us", utc=True), ended=pd.to_datetime(made.ended, unit="us", utc=True))


def _whole(events: DataFrame) -> DataFrame:
    return events.select("request_id", "ts", F.unix_micros("ts").alias("at"), F.col("seq").cast("long").alias("seq"), F.col("type").cast("string").alias("type"), F.col("payload").cast("string").alias("payload")).where("request_id is not null and ts is not null and seq is not null")


def outcomes(events: DataFrame, timeout: str, late: str = "10 minutes", remember: str = "1 day", groups: int = GROUPS) -> DataFrame:
    """events(request_id, seq, ts, type, payload) as a stream -> (request_id, status, started, ended, n_tokens, answer), one row for each request that the watermark has passed."""
    kind = dict(events.dtypes)["request_id"]
    rows = _whole(events).withWatermark("ts", late)
    work = Requests(micros(events, timeout), micros(events, remember))
    held = rows.withColumn("held_by", F.pmod(F.xxhash64("request_id"), F.lit(groups)))
    return held.groupBy("held_by").transformWithStateInPandas(work, OUT.format(kind=kind), "append", "eventTime")


def micros(df: DataFrame, interval: str) -> int:
    """Microseconds of an interval, as Spark reads it."""
    n = df.sparkSession.range(1).select(F.unix_micros(F.expr(f"timestamp'1970-01-01 00:00:00Z' + interval {interval}")).alias("n"))
    return n.first().n


def outcomes_of_all(events: DataFrame, timeout: str) -> DataFrame:
    """The batch twin: the outcomes of all requests of a table, as if the watermark had passed them all."""
    rows = _whole(events).drop("ts").distinct()
    limit = micros(events, timeout)
    own = W.partitionBy("request_id")
    timed = rows.withColumn("first", F.min("at").over(own)).where(F.col("at") <= F.col("first") + limit)
    before = own.orderBy("at", "seq").rowsBetween(W.unboundedPreceding, -1)
    open_ = timed.withColumn("over", F.coalesce(F.bool_or(F.col("type") == "done").over(before), F.lit(False))).where("not over")
    tokens = F.array_sort(F.collect_list(F.when(F.col("type") == "token", F.struct("at", "seq", F.coalesce("payload", F.lit("")).alias("payload")))))
    done = F.min(F.when(F.col("type") == "done", F.col("at")))
    g = open_.groupBy("request_id").agg(F.min("first").alias("first"), done.alias("done"), tokens.alias("tokens"))
    status = F.when(F.col("done").isNotNull(), "complete").otherwise("abandoned")
    ended = F.timestamp_micros(F.coalesce("done", F.col("first") + limit))
    return g.select("request_id", status.alias("status"), F.timestamp_micros("first").alias("started"), ended.alias("ended"), F.size("tokens").cast("long").alias("n_tokens"), F.array_join(F.transform("tokens", lambda t: t["payload"]), "").alias("answer"))


@contextmanager
def rocksdb(spark: SparkSession):
    """State in RocksDB, which timers need, for queries that start inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
