"""A stand-in of the service without models: fixed sources and stage times, an answer out of the query's own words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stage times in ms, and made-up sources.
STAGE_MS = {"bm25": 40.0, "paper_search": 110.0, "fusion": 3.0, "chunk_search": 90.0, "rerank": 140.0, "generation": 450.0, "hallucination_check": 180.0}
SOURCES = ("A first paper", "A second paper", "A third paper")


def answer(query: Column) -> Column:
    """Says that it is no real answer; a blank query has none."""
    return F.when(F.length(F.trim(query)) > 0, F.concat(F.lit("No model was asked. The question was: "), F.trim(query)))


def answers(queries: DataFrame) -> DataFrame:
    """queries(query_id, query) -> (query_id, answer, sources), blank queries left out."""
    return queries.select("query_id", answer(F.col("query")).alias("answer"), F.array(*map(F.lit, SOURCES)).alias("sources")).where("answer is not null")


def stages(queries: DataFrame) -> DataFrame:
    """(trace_id, stage, duration_ms): the rows that a traced request leaves."""
    rows = F.array(*[F.struct(F.lit(k).alias("stage"), F.lit(v).alias("duration_ms")) for k, v in STAGE_MS.items()])
    return queries.select(F.col("query_id").alias("trace_id"), F.inline(rows))


def events(queries: DataFrame) -> DataFrame:
    """(conversation_id, seq, type, payload): a status for each stage, the answer word by word, and the end."""
    words = F.split(answer(F.col("query")), "(?<= )")
    status = F.array(*[F.struct(F.lit("status").alias("type"), F.lit(s).alias("payload")) for s in STAGE_MS])
    said = F.transform(words, lambda w: F.struct(F.lit("token").alias("type"), w.alias("payload")))
    end = F.array(F.struct(F.lit("done").alias("type"), F.lit("").alias("payload")))
    every = F.concat(status, said, end)
    return queries.where(F.length(F.trim("query")) > 0).select(F.col("query_id").alias("conversation_id"), F.posexplode(every).alias("seq", "e")).select("conversation_id", "seq", "e.*")
