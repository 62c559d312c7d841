"""Structured Streaming forms: token folds, abandoned work, windows over an event stream."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as an append-only stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def token_state(events: DataFrame) -> DataFrame:
    """events(conversation_id, seq, type, payload): what each conversation has said so far; state grows with one conversation's tokens."""
    toks = F.array_sort(F.collect_list(F.when(F.col("type") == "token", F.struct("seq", "payload"))))
    return events.groupBy("conversation_id").agg(F.array_join(F.transform(toks, lambda s: s["payload"]), "").alias("answer"), F.max((F.col("type") == "done").cast("int")).alias("done"))


def windows(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows; rows later than the watermark are dropped by the stream."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(s.alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def started_and_done(starts: DataFrame, done: DataFrame, within: str = "1 hour") -> DataFrame:
    """starts(id, ts), done(done_id, done_ts): each start with its end within the time, or without (abandoned); an outer join of two streams with watermarks."""
    a, b = starts.withWatermark("ts", "10 minutes"), done.withWatermark("done_ts", "10 minutes")
    return a.join(b, F.expr(f"id = done_id AND done_ts >= ts AND done_ts <= ts + INTERVAL {within}"), "left_outer")


def work_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share: below spark.checkpoint.dir, or, in local mode only, a temporary one of this process."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    root = held.get() if held.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lodestone-streams-")
        atexit.register(shutil.rmtree, root, True)
    return f"{root}/{uuid.uuid4().hex}"


def drain(frame: DataFrame) -> DataFrame:
    """Run a stream over what is there now, appending what is final to Parquet, and return that table: windows that the watermark has not passed stay open."""
    path = work_dir(frame.sparkSession)
    q = frame.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return frame.sparkSession.read.schema(frame.schema).parquet(f"{path}/out")


def drain_latest(frame: DataFrame, key: str) -> DataFrame:
    """The same for state without a watermark: every batch writes the rows it changed into a folder of its own, so a repeated batch replaces itself, and the last row of each key counts."""
    path = work_dir(frame.sparkSession)
    spark = frame.sparkSession

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")

    q = frame.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.lastProgress is None:
        return spark.createDataFrame([], frame.schema)
    rows = spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out")
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("batch")))).where("_r = 1").select(*frame.columns)
