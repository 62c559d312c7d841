"""What the service sets around its plans: admission by scheduler pools, and sizes by memory."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Least memory in GB, and what fits: rows of a batch and target bytes of a shuffle partition.
TIERS = ((64, {"tier": "large", "batch": 256, "partition_mb": 256}), (32, {"tier": "medium", "batch": 128, "partition_mb": 128}), (0, {"tier": "small", "batch": 32, "partition_mb": 64}))


def tier(memory_gb: float) -> dict:
    """The settings of the largest tier that the memory reaches."""
    return next(dict(settings) for least, settings in TIERS if memory_gb >= least)


def shuffle_partitions(input_bytes: int, memory_gb: float) -> int:
    """Partitions of a shuffle of so many bytes, one at least."""
    size = tier(memory_gb)["partition_mb"] << 20
    return max(1, -(-input_bytes // size))


@contextmanager
def pool(spark: SparkSession, name: str) -> Iterator[None]:
    """Jobs started inside run in a pool of the FAIR scheduler, whose minimum share and weight the cluster's allocation file sets: retrieval and generation can be held apart so."""
    sc = spark.sparkContext
    before = sc.getLocalProperty("spark.scheduler.pool")
    sc.setLocalProperty("spark.scheduler.pool", name)
    try:
        yield
    finally:
        sc.setLocalProperty("spark.scheduler.pool", before)
