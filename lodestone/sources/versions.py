"""Versions of a stored table: each is one small file that names all data files, so a reader sees one version whole.

Data files are never changed. A writer adds files and then publishes the next
version by renaming its manifest into place, which fails if another writer has
published that version first. On HDFS the rename decides; a local disk leaves a
moment between the look and the rename, and an object store without renames
needs one writer at a time. Manifests hold counts and file names, never rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has published this version; take the newest and try again."""


class Versions:
    """The manifests of one table: ``<path>/_versions/<number>.json``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.of = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.of(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Published versions, oldest first."""
        folder = self.of(f"{self.path}/_versions")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int | None = None) -> tuple[int, dict]:
        """(number, manifest) of a version, by default the newest; (0, {}) where there is none."""
        held = self.numbers()
        number = number or (held[-1] if held else 0)
        if not number:
            return 0, {}
        stream = self.fs.open(self.of(f"{self.path}/_versions/{number:010d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return number, json.loads(text)

    def publish(self, number: int, manifest: dict) -> int:
        """Make this the version of that number; Conflict if there is one."""
        to = self.of(f"{self.path}/_versions/{number:010d}.json")
        draft = self.of(f"{self.path}/_versions/_draft-{uuid.uuid4().hex}")
        self.fs.mkdirs(to.getParent())
        out = self.fs.create(draft, False)
        try:
            out.write(json.dumps(manifest).encode())
        finally:
            out.close()
        if self.fs.exists(to) or not self.fs.rename(draft, to):
            self.fs.delete(draft, False)
            raise Conflict(f"version {number} of {self.path} is there already")
        return number

    def files(self, folder: str) -> list[str]:
        """The data files in a folder below the table's path, as paths relative to it."""
        at = self.of(f"{self.path}/{folder}")
        if not self.fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(at)]
        return sorted(f"{folder}/{n}" for n in names if n.endswith(".parquet"))

    def folders(self, folder: str) -> list[str]:
        at = self.of(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at) if s.isDirectory()) if self.fs.exists(at) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.of(f"{self.path}/{name}"), True)

    def forget(self, keep: int) -> dict[int, dict]:
        """Drop all but the last ``keep`` manifests and return those that stay."""
        numbers = self.numbers()
        for n in numbers[:-keep]:
            self.delete(f"_versions/{n:010d}.json")
        return {n: self.read(n)[1] for n in numbers[-keep:]}
