"""Chat history: recent chats, pages, owners, threads, feedback, titles, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def recent(chats: DataFrame, user: str, ts: str, tie: str, limit: int) -> DataFrame:
    """Each user's newest rows."""
    order = W.partitionBy(user).orderBy(F.desc(ts), F.desc(tie))
    return chats.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)


def messages(turns: DataFrame, chat: str, at: str, limit: int) -> DataFrame:
    """Each chat's first messages in time order (never in the order of message ids)."""
    order = W.partitionBy(chat).orderBy(at)
    return turns.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)


def access(asked: DataFrame, owners: DataFrame) -> DataFrame:
    """asked(chat, user), owners(chat, owner): owner, other or missing."""
    j = asked.join(owners, "chat", "left")
    return j.select("chat", "user", F.when(F.col("owner").isNull(), "missing").when(F.col("owner") == F.col("user"), "owner").otherwise("other").alias("access"))


def threads(entries: DataFrame, thread: str, at: str, text: str, name: int = 50) -> DataFrame:
    """(thread, n, first_at, last_at, name): the name is the start of the first entry's text."""
    return entries.groupBy(thread).agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), T.truncated(F.min_by(text, at), name).alias("name"))


def page(rows: DataFrame, order: list[Column], size: int, cursor: Column | None = None, before: int = 0) -> DataFrame:
    """(.., rank, has_next): the ``size`` rows after the cursor's, ``order`` being ascending keys that tell all rows apart.

    ``cursor`` is a struct of the last seen row's keys (null: from the first
    row), so a page is a filter and a top-n; the window numbers its rows only.
    ``before`` is how many rows the earlier pages held.
    """
    key = F.struct(*order)
    later = rows if cursor is None else rows.where(cursor.isNull() | (key > cursor))
    top = later.orderBy(*order).limit(size + 1)
    every = W.partitionBy(F.lit(0))
    numbered = top.withColumn("rank", F.row_number().over(every.orderBy(*order))).withColumn("has_next", F.count("*").over(every) > size)
    return numbered.where(F.col("rank") <= size).withColumn("rank", F.col("rank") + before)


def steps(entries: DataFrame, keys: list[str], query: str, answer: str) -> DataFrame:
    """Two steps for each entry: what the user said and what was answered."""
    both = F.array(F.struct(F.lit("user_message").alias("type"), F.col(query).alias("output")), F.struct(F.lit("assistant_message").alias("type"), F.col(answer).alias("output")))
    return entries.select(*keys, F.posexplode(both).alias("step", "s")).select(*keys, "step", "s.*")


def feedback(steps_: DataFrame, entries: DataFrame) -> DataFrame:
    """steps_(step_id, value), entries(entry_id): the entry whose id is the longest non-empty prefix of the step's.

    Prefixes of the step ids are generated and met by equality, so this is no
    nested-loop join.
    """
    ids = entries.where(F.length("entry_id") > 0).select("entry_id", F.length("entry_id").alias("n"))
    lo, hi = ids.agg(F.min("n")).scalar(), ids.agg(F.max("n")).scalar()
    cut = steps_.withColumns({"_lo": lo, "_hi": F.least(F.length("step_id"), hi)}).where("_hi >= _lo")
    tried = cut.select("step_id", "value", F.explode(F.sequence("_lo", "_hi")).alias("n"))
    met = tried.withColumn("entry_id", F.expr("substring(step_id, 1, n)")).join(ids, ["entry_id", "n"])
    return met.groupBy("step_id", "value").agg(F.max_by("entry_id", "n").alias("entry_id"))


def fold_events(events: DataFrame) -> DataFrame:
    """events(conversation_id, seq, type, payload): the answer's text out of its tokens in order, the last context, and whether it is done."""
    toks = F.array_sort(F.collect_list(F.when(F.col("type") == "token", F.struct("seq", "payload"))))
    return events.groupBy("conversation_id").agg(
        F.array_join(F.transform(toks, lambda s: s["payload"]), "").alias("answer"),
        F.max_by("payload", F.when(F.col("type") == "context", F.col("seq"))).alias("context"),
        F.bool_or(F.col("type") == "done").alias("done"),
    )


def retitled(chats: DataFrame, titles: DataFrame) -> DataFrame:
    """chats(chat, owner, title), titles(chat, user, title): a title is set only by its chat's owner, and only while there is none. Copy-on-write."""
    new = titles.groupBy("chat", "user").agg(F.min("title").alias("new"))
    j = chats.join(new, (chats["chat"] == new["chat"]) & (chats["owner"] == new["user"]), "left")
    return j.select(*[F.coalesce(chats["title"], "new").alias("title") if c == "title" else chats[c] for c in chats.columns])


def traces_of(asked: DataFrame, owners: DataFrame, traces: DataFrame) -> DataFrame:
    """asked(chat, user), owners(chat, owner), traces(chat, trace_id, ..): the access of each and, for owners only, their chats' traces."""
    seen = access(asked, owners)
    return seen.join(traces.withColumn("access", F.lit("owner")), ["chat", "access"], "left")


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Copy-on-write: the row with the highest version of each key stays."""
    order = W.partitionBy(key).orderBy(F.desc(version))
    return old.unionByName(new).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
