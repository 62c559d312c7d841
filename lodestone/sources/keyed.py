"""A stored table with a key: rows are renewed, added and deleted in place of rewriting everything.

Rows lie in hash buckets of their key. A change reads and writes only the
buckets that hold one of its keys, and then publishes a version that names the
new files of those and the old files of all others. The work of a change is
thus that of its buckets; their number is fixed when the table is made, so
choose it for buckets of about a file each.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .versions import Versions


class KeyedTable:
    """Rows with one or more key columns, one row a key. Nulls in a key are a value like others."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.versions = spark, path, Versions(spark, path)

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: list[str], buckets: int = 64) -> KeyedTable:
        """A new table of these rows, whose keys must differ."""
        made = cls(rows.sparkSession, path)
        made._publish(0, {"key": key, "buckets": buckets, "schema": rows.schema.json(), "files": {}}, _single(rows, key), None)
        return made

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        _, held = self.versions.read(version)
        return self._rows(held, held["files"])

    def _rows(self, held: dict, buckets) -> DataFrame:
        schema = StructType.fromJson(json.loads(held["schema"]))
        files = [f"{self.path}/{f}" for b in buckets for f in held["files"].get(b, [])]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def _bucket(self, held: dict) -> Column:
        return F.pmod(F.xxhash64(*held["key"]), F.lit(held["buckets"])).cast("int")

    def upsert(self, rows: DataFrame) -> int:
        """Rows with a known key take its place, others are added; returns the version."""
        number, held = self.versions.read()
        names = StructType.fromJson(json.loads(held["schema"])).names
        return self._publish(number, held, _single(rows.select(*names), held["key"]), rows.select(*held["key"]))

    def delete(self, keys: DataFrame) -> int:
        """Take away the rows of these keys; unknown keys change nothing."""
        number, held = self.versions.read()
        return self._publish(number, held, None, keys.select(*held["key"]))

    def _publish(self, number: int, held: dict, new: DataFrame | None, gone: DataFrame | None) -> int:
        touched, rows = None, new
        if gone is not None:
            touched = [str(r[0]) for r in gone.select(self._bucket(held)).distinct().collect()]
            old = self._rows(held, touched)
            renamed = gone.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(held["key"])]).distinct()
            same = F.lit(True)
            for i, k in enumerate(held["key"]):
                same = same & old[k].eqNullSafe(renamed[f"_key{i}"])
            stay = old.join(renamed, same, "left_anti")
            rows = stay if new is None else stay.unionByName(new)
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket(held)).hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        written = {name.partition("=")[2]: self.versions.files(f"{folder}/{name}") for name in self.versions.folders(folder) if name.startswith("_bucket=")}
        files = {b: f for b, f in held["files"].items() if touched is not None and b not in touched} | written
        return self.versions.publish(number + 1, held | {"files": files})

    def vacuum(self, keep: int = 1) -> int:
        """Delete the files that none of the last ``keep`` versions names; returns how many. Not while a writer is at work."""
        named = {f for held in self.versions.forget(keep).values() for files in held["files"].values() for f in files}
        dead = []
        for part in self.versions.folders("data"):
            for bucket in self.versions.folders(f"data/{part}"):
                dead += [f for f in self.versions.files(f"data/{part}/{bucket}") if f not in named]
        for f in dead:
            self.versions.delete(f)
        return len(dead)


def _single(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows; an error if a key has two."""
    twice = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError(f"more than one row for a key of {key}")
    return rows
