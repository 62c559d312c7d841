"""Shapes of records: stream lines, display sources, capped traces, metrics, counters, templates, guards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SearchRequest:
    """A request as the service takes it; a bad one raises."""

    query: str
    collection: int = 1
    k: int = 10

    def __post_init__(self) -> None:
        if not 1 <= len(self.query.strip()) <= 2000:
            raise ValueError("a query has 1 to 2000 characters")
        if self.collection not in (1, 2):
            raise ValueError("the collection is 1 or 2")
        if not 1 <= self.k <= 100:
            raise ValueError("k is 1 to 100")


def sse_line(*columns: str) -> Column:
    """A server-sent event: data, the columns as JSON (nulls left out), a blank line."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(*columns)), F.lit("\n\n"))


def keep_last(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The last n rows of each key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def rotation(angle: Column, confidence: Column, least: float = 5.0) -> Column:
    """Whether a page is turned: ``kept`` if its angle is 0, ``rotated`` if the confidence is enough, else ``rejected``."""
    return F.when(angle == 0, "kept").when(confidence >= least, "rotated").otherwise("rejected")


def display_sources(sources: Column) -> Column:
    """Array of struct(title, file_path, ..) -> what a reader sees of each: title, else path, else Unknown."""
    return F.transform(sources, lambda s: F.coalesce(s["title"], s["file_path"], F.lit("Unknown")))


def capped(scores: Column, n: int, digits: int = 4) -> Column:
    """The first n values, rounded half to even as stored traces are."""
    return F.transform(F.slice(scores, 1, n), lambda x: F.bround(x, digits))


def top_of_map(scores: Column, n: int = 20) -> Column:
    """The n largest entries of a map, ties by key: array of struct(score, key)."""
    entries = F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("less"), e["key"].alias("key")))
    return F.transform(F.slice(F.array_sort(entries), 1, n), lambda e: F.struct((-e["less"]).alias("score"), e["key"].alias("key")))


def zipped(names: Column, scores: Column) -> Column:
    """Two lists by position: array of struct(rank, name, score), as long as the shorter."""
    n = F.least(F.size(names), F.size(scores))
    return F.transform(F.arrays_zip(F.slice(names, F.lit(1), n).alias("name"), F.slice(scores, F.lit(1), n).alias("score")), lambda x, i: F.struct((i + 1).alias("rank"), x["name"].alias("name"), x["score"].alias("score")))


def millis(start: Column, end: Column) -> Column:
    """Milliseconds between two timestamps, to the microsecond."""
    return F.timestamp_diff("MICROSECOND", start, end) / 1000


def filled(template: str, **values: Column) -> Column:
    """A template with {name} replaced by columns."""
    out = F.lit(template)
    for name, column in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(column.cast("string"), F.lit("")))
    return out


def stage_metrics(rows: DataFrame, by: str, text: str, score: str, seconds: str) -> DataFrame:
    """Per stage: average length, score range, characters a second (null without time)."""
    time = F.sum(seconds)
    return rows.groupBy(by).agg(F.round(F.avg(F.length(text)), 4).alias("avg_length"), F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.round(F.sum(F.length(text)) / F.when(time > 0, time), 4).alias("chars_per_s"))


def request_metrics(requests: DataFrame) -> DataFrame:
    """requests(request_id, arrived, admitted, retrieved, first_token, finished): five durations in ms."""
    ms = lambda a, b: F.round((F.col(b) - F.col(a)) * 1000, 4)
    return requests.select("request_id", ms("arrived", "admitted").alias("queue_ms"), ms("admitted", "retrieved").alias("retrieval_ms"), ms("retrieved", "first_token").alias("first_token_ms"), ms("first_token", "finished").alias("generation_ms"), ms("arrived", "finished").alias("total_ms"))


def speed_up(metrics: DataFrame) -> DataFrame:
    """Averages, and how much longer the requests would have taken one after another than the longest of them."""
    return metrics.agg(F.count("*").alias("n"), F.round(F.avg("total_ms"), 4).alias("avg_total_ms"), F.round(F.avg("queue_ms"), 4).alias("avg_queue_ms"), F.round(F.sum("total_ms") / F.max("total_ms"), 4).alias("speed_up"))
