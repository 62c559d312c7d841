"""Weighted rank fusion of a lexical and a dense list, for all queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fuse(lexical: DataFrame, dense: DataFrame, k: int = 30, weights: tuple[float, float] = (0.3, 0.7), accumulate: bool = True) -> DataFrame:
    """lexical and dense (query_id, rank, doc_id) -> (query_id, rank, doc_id, score, lexical_rank, dense_rank).

    A place r of n rows is worth weight * (1 - (r - 1) / n), n being the rows
    that side returned. A document that a side lists more than once adds each
    time (``accumulate``) or counts at its best place. Ties: lexical place
    (missing last), dense place, id.
    """

    def worth(side: DataFrame, weight: float, name: str) -> DataFrame:
        n = F.count("*").over(W.partitionBy("query_id"))
        w = side.select("query_id", "doc_id", "rank", (weight * (1 - (F.col("rank") - 1) / n)).alias("s"))
        total = F.sum("s") if accumulate else F.max("s")
        return w.groupBy("query_id", "doc_id").agg(total.alias(f"{name}_score"), F.min("rank").alias(f"{name}_rank"))

    both = worth(lexical, weights[0], "lexical").join(worth(dense, weights[1], "dense"), ["query_id", "doc_id"], "full_outer")
    score = F.round(F.coalesce("lexical_score", F.lit(0.0)) + F.coalesce("dense_score", F.lit(0.0)), 6)
    return _top(both.withColumn("score", score), k)


def fuse_by_position(lexical: DataFrame, dense: DataFrame, k: int, weights: tuple[float, float] = (0.3, 0.7)) -> DataFrame:
    """The first version's rule: place r (from 0) is worth weight * (2k - r) / 2k, a document's first place counts, and the weights must add to 1."""
    if abs(sum(weights) - 1) > 1e-9:
        raise ValueError("the weights must add to 1")

    def worth(side: DataFrame, weight: float, name: str) -> DataFrame:
        return side.groupBy("query_id", "doc_id").agg(F.min("rank").alias(f"{name}_rank")).withColumn(f"{name}_score", weight * (2 * k - (F.col(f"{name}_rank") - 1)) / (2 * k))

    both = worth(lexical, weights[0], "lexical").join(worth(dense, weights[1], "dense"), ["query_id", "doc_id"], "full_outer")
    score = F.round(F.coalesce("lexical_score", F.lit(0.0)) + F.coalesce("dense_score", F.lit(0.0)), 6)
    return _top(both.withColumn("score", score), k)


def _top(both: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("lexical_rank"), F.asc_nulls_last("dense_rank"), "doc_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score", "lexical_rank", "dense_rank")


def overlap(lexical: DataFrame, dense: DataFrame, selected: DataFrame) -> DataFrame:
    """Per query: candidates found by one side only or by both, how many of each were selected, and the share of selected ones the dense side alone would have missed."""
    a = lexical.select("query_id", "doc_id").distinct().withColumn("l", F.lit(True))
    b = dense.select("query_id", "doc_id").distinct().withColumn("d", F.lit(True))
    s = selected.select("query_id", "doc_id").distinct().withColumn("s", F.lit(True))
    j = a.join(b, ["query_id", "doc_id"], "full_outer").join(s, ["query_id", "doc_id"], "left")
    l, d, s = (F.coalesce(c, F.lit(False)) for c in ("l", "d", "s"))
    return j.groupBy("query_id").agg(
        F.count_if(l & ~d).alias("lexical_only"),
        F.count_if(~l & d).alias("dense_only"),
        F.count_if(l & d).alias("both"),
        F.count_if(l & ~d & s).alias("selected_lexical_only"),
        F.count_if(~l & d & s).alias("selected_dense_only"),
        F.count_if(l & d & s).alias("selected_both"),
    )
