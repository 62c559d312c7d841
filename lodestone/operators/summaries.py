"""Summaries of texts of any length by levels: cut, summarise each chunk, put together, and again while the result is too long.

Each level is one pass over the texts that are still too long, written once, so
nothing is computed twice however many levels there are, and the loop ends by
itself: when every text fits, or one no longer gets shorter. Chunks are rows of
their own while they are summarised, since a summariser is what costs; a text's
summaries meet again, which are as many as its chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.corpus import stored
from . import chunk as C


def word_chunks(size: int) -> Callable[[Column], Column]:
    """Chunks of so many words, one space between."""
    return lambda t: F.transform(C.fixed(words(t), size, 0), lambda c: c["text"])


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n]+"), lambda w: w != "")


def first_words(n: int) -> Callable[[Column], Column]:
    """The stand-in summary of a chunk."""
    return lambda t: F.array_join(F.slice(words(t), 1, n), " ")


def by_levels(docs: DataFrame, key: str, text: str, fits: Callable[[Column], Column], chunks: Callable[[Column], Column], summary: Callable[[Column], Column]) -> DataFrame:
    """(key, text, level): each text once it fits, and after how many levels; chunk summaries are numbered sections, blank lines between. A null text is empty. Keys must differ."""
    now = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(0).alias("level"))
    out = now.where(fits(F.col("text")))
    now = stored(now.where(~fits(F.col("text"))))
    while not now.isEmpty():
        parts = now.select(key, F.length("text").alias("before"), "level", F.posexplode(chunks(F.col("text"))).alias("i", "chunk"))
        told = parts.select(key, "before", "level", F.struct("i", summary(F.col("chunk")).alias("s")).alias("p"))
        met = told.groupBy(key, "before", "level").agg(F.array_sort(F.collect_list("p")).alias("p"))
        section = lambda p: F.concat(F.lit("Section "), (p["i"] + 1).cast("string"), F.lit(":\n"), p["s"])
        joined = met.select(key, "before", (F.col("level") + 1).alias("level"), F.array_join(F.transform("p", section), "\n\n").alias("text"))
        level = stored(joined)
        ends = fits(F.col("text")) | (F.length("text") >= F.col("before"))
        out = out.unionByName(level.where(ends).select(key, "text", "level"))
        now = level.where(~ends).select(key, "text", "level")
    return out
