"""Pipeline traces: stage rows to wide traces, bottlenecks, funnels, comparisons, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The canonical order of the stages (fixed values).
STAGES = ("bm25", "paper_search", "fusion", "chunk_search", "rerank", "generation", "hallucination_check")


def wide(stages: DataFrame, names: tuple[str, ...] = STAGES) -> DataFrame:
    """stages(trace_id, stage, duration_ms) -> one row a trace with a column for each stage."""
    return stages.groupBy("trace_id").pivot("stage", list(names)).agg(F.first("duration_ms"))


def latest(rows: DataFrame, key: str, written: str, tie: str) -> DataFrame:
    """The last written row of each key (a finished trace replaces the running one)."""
    order = W.partitionBy(key).orderBy(F.desc(written), F.desc(tie))
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def bottleneck(stages: DataFrame) -> DataFrame:
    """(trace_id, total_ms, slowest_stage, slowest_ms); the smaller name of equals."""
    top = F.max(F.struct(F.col("duration_ms").alias("ms"))).alias("m")
    low = stages.groupBy("trace_id").agg(F.sum("duration_ms").alias("total_ms"), top)
    tied = stages.join(low, "trace_id").where(F.col("duration_ms") == F.col("m.ms")).groupBy("trace_id").agg(F.min("stage").alias("slowest_stage"))
    return low.join(tied, "trace_id").select("trace_id", F.round("total_ms", 6).alias("total_ms"), "slowest_stage", F.col("m.ms").alias("slowest_ms"))


def funnel(counts: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """counts(trace_id, stage, n) -> each named stage's count over that of the named stage before it."""
    at = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("stage"))
    order = W.partitionBy("trace_id").orderBy("at")
    held = counts.withColumn("at", at).where("at > 0")
    before = F.lag("n").over(order)
    return held.select("trace_id", "stage", "n", F.round(F.col("n") / F.when(before > 0, before), 6).alias("efficiency"))


def final_status(stages: DataFrame) -> DataFrame:
    """error if a stage failed, success if all succeeded or were skipped, else partial."""
    fine = F.bool_and(F.col("status").isin("success", "skipped"))
    return stages.groupBy("trace_id").agg(F.when(F.bool_or(F.col("status") == "error"), "error").when(fine, "success").otherwise("partial").alias("status"))


def first_missing(done: DataFrame, names: tuple[str, ...] = STAGES) -> DataFrame:
    """done(trace_id, stage): the first canonical stage a trace lacks, ``unknown`` if none."""
    order = F.array(*[F.lit(n) for n in names])
    have = done.groupBy("trace_id").agg(F.collect_set("stage").alias("have"))
    return have.select("trace_id", F.coalesce(F.get(F.array_except(order, "have"), F.lit(0)), F.lit("unknown")).alias("failed_stage"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(stage, a_ms, b_ms, diff_ms) of two traces; a stage one lacks counts as 0."""
    j = a.select("stage", F.col("duration_ms").alias("a_ms")).join(b.select("stage", F.col("duration_ms").alias("b_ms")), "stage", "full_outer")
    x, y = F.coalesce("a_ms", F.lit(0.0)), F.coalesce("b_ms", F.lit(0.0))
    return j.select("stage", x.alias("a_ms"), y.alias("b_ms"), F.round(y - x, 6).alias("diff_ms"))


def sessions(entries: DataFrame, key: str, total: str, ok: Column, ts: str, tie: str) -> DataFrame:
    """Per session: entries, successes, errors, average, least and most total time of the successes, first and last entry."""
    good = F.when(ok, F.col(total))
    return entries.groupBy(key).agg(
        F.count("*").alias("n"),
        F.count_if(ok).alias("n_success"),
        F.count_if(~ok).alias("n_error"),
        F.round(F.avg(good), 6).alias("avg_total"),
        F.min(good).alias("min_total"),
        F.max(good).alias("max_total"),
        F.min_by(tie, F.struct(ts, tie)).alias("first_entry"),
        F.max_by(tie, F.struct(ts, tie)).alias("last_entry"),
    )


def retained(rows: DataFrame, ts: str, now: Column, days: int = 30) -> DataFrame:
    """Rows not older than the given days, by true timestamps."""
    return rows.where(F.col(ts) >= now - F.make_interval(days=F.lit(days)))


def queue_depth(events: DataFrame, key: str, ts: str, tie: str, change: Column) -> DataFrame:
    """A running sum of +1 and -1 events: how many wait after each."""
    order = W.partitionBy(key).orderBy(ts, tie).rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn("depth", F.sum(change).over(order))
