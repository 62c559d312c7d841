"""Latency quantiles out of sketches that are kept by the hour and merged over longer times.

A KLL sketch of size k answers a quantile with a rank that is off by about
2.3 / k ** 0.9 (with k = 800: half a percent), whatever the number of values, and two
sketches merge into one with the same error. So raw rows are read once; days,
weeks and regroupings come from the hours' rows, a few kilobytes each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 800


def hourly(rows: DataFrame, value: str, time: str, by: list[str], size: int = SIZE) -> DataFrame:
    """(by.., hour, n, sketch): one row for each hour with a value; null values are left out."""
    held = rows.where(F.col(value).isNotNull()).withColumn("hour", F.date_trunc("hour", time))
    return held.groupBy(*by, "hour").agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch"))


def merged(hours: DataFrame, by: list[str], unit: str = "day", size: int = SIZE) -> DataFrame:
    """(by.., <unit>, n, sketch): the hours' sketches merged."""
    return hours.groupBy(*by, F.date_trunc(unit, "hour").alias(unit)).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def quantiles(sketches: DataFrame, at: dict[str, float]) -> DataFrame:
    """The sketches' rows with a column for each quantile instead of the sketch."""
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(name) for name, q in at.items()]
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *found)


def rank_error(rows: DataFrame, value: str, found: DataFrame, by: list[str], at: dict[str, float]) -> DataFrame:
    """(by.., n, <name>_error): by how much the rank of each found quantile misses, against all values."""
    met = rows.where(F.col(value).isNotNull()).join(found.select(*by, *at), by)
    below = {name: F.avg((F.col(value) < F.col(name)).cast("double")) for name in at}
    upto = {name: F.avg((F.col(value) <= F.col(name)).cast("double")) for name in at}
    return met.groupBy(*by).agg(F.count("*").alias("n"), *[F.greatest(F.lit(0.0), below[name] - q, F.lit(q) - upto[name]).alias(f"{name}_error") for name, q in at.items()])
