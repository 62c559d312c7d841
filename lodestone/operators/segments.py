"""A stored lexical index that takes documents in and out: segments, tombstones, merges by level.

Added documents become a segment of their own: postings, lengths and term
counts, written once. Deleted ones, and the older copies of those added again,
get a tombstone, with the counts that they take out of their segments' terms.
A version of the index names its segments, tombstones and their counts of
documents and tokens, and is published as one file, so a search reads one
state whole while writers go on.

When ``fanout`` segments have reached one level (their documents' number, as a
power of it), they are merged into one without their dead documents. A
document is thus rewritten as often as the logarithm of the index, and a
search reads a handful of segments.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25
from ..sources.versions import Versions

_POSTINGS, _DOCS, _TERMS = "term string, doc_id {kind}, tf long", "doc_id {kind}, dl long", "term string, df long, cf long"


class SegmentedIndex:
    """The index at a path; ``markdown`` cleans texts first, as in ``bm25.build``."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 4, markdown: bool = False) -> None:
        self.spark, self.path, self.fanout, self.markdown = spark, path, fanout, markdown
        self.versions = Versions(spark, path)

    def _held(self, version: int | None = None) -> tuple[int, dict]:
        number, held = self.versions.read(version)
        return number, held or {"next": 1, "kind": "long", "segments": {}, "dead": []}

    def _table(self, held: dict, part: str, schema: str, names=None) -> DataFrame:
        """(segment, ..) of the named segments, all of the version by default."""
        names = held["segments"] if names is None else names
        paths = [f"{self.path}/{part}/segment={held['segments'][s]['at']}" for s in names]
        schema = schema.format(kind=held["kind"])
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, segment int")
        tagged = self.spark.read.schema(f"{schema}, segment string").option("basePath", f"{self.path}/{part}").parquet(*paths)
        number = F.create_map(*[F.lit(x) for s in names for x in (held["segments"][s]["at"], int(s))])
        return tagged.withColumn("segment", F.element_at(number, F.col("segment")))

    def _dead(self, held: dict) -> DataFrame:
        """(doc_id, before): the document is dead in segments numbered below."""
        schema = f"doc_id {held['kind']}, before int"
        if not held["dead"]:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/dead/{d}" for d in held["dead"]])
        return rows.groupBy("doc_id").agg(F.max("before").alias("before"))

    def _alive(self, held: dict, rows: DataFrame) -> DataFrame:
        if not held["dead"]:
            return rows
        dead = self._dead(held).withColumnRenamed("doc_id", "_dead")
        return rows.join(dead, (rows["doc_id"] == dead["_dead"]) & (rows["segment"] < dead["before"]), "left_anti")

    def _write(self, postings: DataFrame, lengths: DataFrame) -> dict:
        """A new segment's tables and what the manifest says of it."""
        at = uuid.uuid4().hex
        to = lambda part: f"{self.path}/{part}/segment={at}"
        postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(to("postings"))
        lengths.write.parquet(to("docs"))
        stored = self.spark.read.parquet(to("postings"))
        stored.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).write.parquet(to("terms"))
        n = self.spark.read.parquet(to("docs")).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("cf")).first()
        return {"at": at, "docs": n.n, "tokens": n.cf}

    def add(self, docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> int:
        """Index documents; those whose id is there already are replaced. Ids must differ and not be null. Returns the version."""
        number, held = self._held()
        kind = dict(docs.dtypes)[id_col]
        held |= {"kind": kind}
        ids = docs.select(F.col(id_col).alias("doc_id"))
        postings = bm25.term_counts(docs, text, id_col, self.markdown)
        held = self._kill(held, ids)
        with bm25.kept(postings):
            per_doc = postings.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
            made = self._write(postings, ids.join(per_doc, "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0)).cast("long").alias("dl")))
        held["segments"] = held["segments"] | {str(held["next"]): made}
        held["next"] += 1
        return self.versions.publish(number + 1, self._merged(held))

    def delete(self, ids: DataFrame) -> int:
        """Take documents (doc_id) out; unknown ids change nothing. Returns the version."""
        number, held = self._held()
        held = self._kill(held, ids.select("doc_id"))
        return self.versions.publish(number + 1, held)

    def _kill(self, held: dict, ids: DataFrame) -> dict:
        """Tombstones for the living documents of these ids, and what they take out of the counts."""
        if not held["segments"]:
            return held
        found = self._alive(held, self._table(held, "docs", _DOCS)).join(ids.distinct(), "doc_id", "left_semi")
        name = uuid.uuid4().hex
        found.select("doc_id", "segment", "dl").write.parquet(f"{self.path}/killed/{name}")
        killed = self.spark.read.parquet(f"{self.path}/killed/{name}")
        lost = {r.segment: r for r in killed.groupBy("segment").agg(F.count("*").alias("n"), F.sum("dl").alias("cf")).collect()}
        if not lost:
            return held
        killed.select("doc_id", F.lit(held["next"]).alias("before")).write.parquet(f"{self.path}/dead/{name}")
        hit = self._table(held, "postings", _POSTINGS, [str(s) for s in lost]).join(killed.select("doc_id", "segment"), ["doc_id", "segment"], "left_semi")
        hit.groupBy("segment", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).write.parquet(f"{self.path}/lost/{name}")
        segments = {}
        for s, about in held["segments"].items():
            out = lost.get(int(s))
            segments[s] = about | ({"docs": about["docs"] - out.n, "tokens": about["tokens"] - out.cf, "lost": about.get("lost", []) + [name]} if out else {})
        return held | {"segments": segments, "dead": held["dead"] + [name], "next": held["next"] + 1}

    def _level(self, docs: int) -> int:
        n = 0
        while docs >= self.fanout:
            docs, n = docs // self.fanout, n + 1
        return n

    def _merged(self, held: dict) -> dict:
        """Merge levels that are full, from the lowest on, until none is."""
        while True:
            levels: dict[int, list[str]] = {}
            for s, about in held["segments"].items():
                levels.setdefault(self._level(about["docs"]), []).append(s)
            full = [names for _, names in sorted(levels.items()) if len(names) >= self.fanout]
            if not full:
                return held
            postings = self._alive(held, self._table(held, "postings", _POSTINGS, full[0])).select("term", "doc_id", "tf")
            lengths = self._alive(held, self._table(held, "docs", _DOCS, full[0])).select("doc_id", "dl")
            made = self._write(postings, lengths)
            rest = {s: a for s, a in held["segments"].items() if s not in full[0]}
            oldest = min((int(s) for s in rest), default=held["next"])
            held = held | {"segments": rest | {str(held["next"]): made}, "next": held["next"] + 1}
            # Nothing is dead any more where no segment is older than the merged one.
            held["dead"] = held["dead"] if oldest < int(held["next"]) - 1 else []

    def index(self, version: int | None = None) -> bm25.Index:
        """The living documents of a version as an index that ``bm25.search`` reads. Term counts come from the segments' own, not from their postings."""
        _, held = self._held(version)
        terms = self._table(held, "terms", _TERMS).select("term", "df", "cf")
        lost = [(s, n) for s, a in held["segments"].items() for n in a.get("lost", [])]
        if lost:
            names = sorted({n for _, n in lost})
            out = self.spark.read.schema("segment int, term string, df long, cf long").parquet(*[f"{self.path}/lost/{n}" for n in names])
            out = out.where(F.col("segment").isin([int(s) for s in held["segments"]]))
            terms = terms.unionByName(out.select("term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf")))
        df = terms.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")
        n, tokens = (sum(a[c] for a in held["segments"].values()) for c in ("docs", "tokens"))
        corpus = self.spark.createDataFrame([(n, tokens / n if n else None)], "n long, avgdl double")
        postings = self._alive(held, self._table(held, "postings", _POSTINGS)).select("term", "doc_id", "tf")
        lengths = self._alive(held, self._table(held, "docs", _DOCS)).select("doc_id", "dl")
        return bm25.Index(postings, lengths, bm25.weighted(df, F.lit(n)), corpus, n)

    def vacuum(self, keep: int = 1) -> None:
        """Delete what none of the last ``keep`` versions names. Not while a writer is at work."""
        stay = list(self.versions.forget(keep).values())
        live = {a["at"] for h in stay for a in h["segments"].values()}
        dead = {d for h in stay for d in h["dead"]}
        lost = {n for h in stay for a in h["segments"].values() for n in a.get("lost", [])}
        for part in ("postings", "docs", "terms"):
            for name in self.versions.folders(part):
                if name.partition("=")[2] not in live:
                    self.versions.delete(f"{part}/{name}")
        for part, names in (("dead", dead), ("lost", lost), ("killed", set())):
            for name in self.versions.folders(part):
                if name not in names:
                    self.versions.delete(f"{part}/{name}")
