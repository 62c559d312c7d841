"""SimHash near-duplicates found by pigeonring chains.

A 64-bit fingerprint is cut into a ring of five segments. If two fingerprints
differ in at most four bits, then from some segment on every run of k
consecutive segments holds at most floor(4 k / 5) of the differences (the
pigeonring principle). So the first segment of such a chain is equal, the
first two differ in at most one bit, the first three in two, and so on. Rows
are dealt by (start, first segment); within a bucket the chain is followed
segment by segment and the full Hamming distance is taken of what is left.

A bucket of more than ``limit`` rows is dealt again by a longer chain: each
fingerprint is stored under its first two (then three) segments and looked up
under every variant the chain budget allows, so the keys grow with the data
and no pair is lost. Only links of a spanning forest of each bucket leave it.

Cases: a null or empty text has no word and fingerprint zero, which links like
any other; equal fingerprints are one vertex; repeated rows keep a row each;
an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, written
from .components import components

BITS, SEGMENTS, RADIUS = 64, 5, 4
#: First bit and width of each segment of the ring.
RING = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]


def shingles(data: bytes, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``width`` words of whole text bytes; of all words where there are no more than that, none without words."""
    from xxhash import xxh64_intdigest

    w = data.lower().split()
    n = len(w)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(w)
    if n <= width:
        return np.array([xxh64_intdigest(joined, seed)], dtype=np.uint64)
    size = np.fromiter(map(len, w), dtype=np.int64, count=n)
    end = np.cumsum(size + 1) - 1
    start = end - size
    view = memoryview(joined)
    return np.array([xxh64_intdigest(view[a:b], seed) for a, b in zip(start[: n - width + 1].tolist(), end[width - 1 :].tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as an unsigned number."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(data: bytes, width: int = 4, seed: int = 42) -> int:
    """Of whole text bytes: the majority of its shingles' hashes."""
    return majority(shingles(data, width, seed))


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fp): one row for each input row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x or b"") for x in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=[id_col, "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.col(text).cast("binary").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def segment(fp: Column, i: int) -> Column:
    at, width = RING[i % SEGMENTS]
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def _masks(start: int) -> list[tuple[np.uint64, int]]:
    """The bits of the first k segments from a start, and the chain's budget for them."""
    bits, out = 0, []
    for k in range(1, SEGMENTS + 1):
        at, width = RING[(start + k - 1) % SEGMENTS]
        bits |= ((1 << width) - 1) << at
        out.append((np.uint64(bits), RADIUS * k // SEGMENTS))
    return out


_CHAINS = [_masks(i) for i in range(SEGMENTS)]


def _viable(x: np.ndarray, start: int) -> np.ndarray:
    """Indices of those differences x whose chain from the start stays within its budgets (the last one is the full distance)."""
    left = np.arange(len(x))
    for bits, budget in _CHAINS[start]:
        left = left[np.bitwise_count(x[left] & bits) <= budget]
        if not len(left):
            break
    return left


def forest(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links, as places in fps, that span the components of one bucket's distinct fingerprints; quadratic in a bucket only where nothing links."""
    edges, rest = [], np.arange(len(fps))
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            p = queue.pop()
            hit = _viable(fps[rest] ^ fps[p], start)
            if len(hit):
                found = rest[hit].tolist()
                edges += [(p, q) for q in found]
                queue += found
                rest = np.delete(rest, hit)
    return edges


def small_forest(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """The same for a bucket of up to some hundred: all pairs at once, in memory, and of them no more links than fingerprints."""
    a, b = np.triu_indices(len(fps), 1)
    hit = _viable(fps[a] ^ fps[b], start)
    if len(hit) >= len(fps):
        return forest(fps, start)
    return list(zip(a[hit].tolist(), b[hit].tolist()))


class _Sets:
    """Disjoint sets of numbers, each alone until it is joined."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        at = x
        while (y := self.up.get(at, at)) != at:
            at = y
        while x != at:
            self.up[x], x = at, self.up.get(x, x)
        return at

    def join(self, a: int, b: int) -> bool:
        """True if they were apart."""
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = self.up[min(a, b)] = min(a, b)
        return a != b


def spanning(own: np.ndarray, asked: np.ndarray, start: int, at_once: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what a bucket's own fingerprints link among themselves and with those asked for: at most as many as there are fingerprints."""
    edges = [] if len(own) < 2 else small_forest(own, start) if len(own) <= 128 else forest(own, start)
    pairs = np.array(edges, np.int64).reshape(-1, 2)
    a, b = [own[pairs[:, 0]]], [own[pairs[:, 1]]]
    if not len(own) or not len(asked):
        return a[0], b[0]
    sets = _Sets()
    for i, j in edges:
        sets.join(i, j)
    step = max(1, at_once // len(own))
    for i in range(0, len(asked), step):
        part = asked[i : i + step]
        hit = _viable((part[:, None] ^ own[None, :]).reshape(-1), start)
        who, whom = hit // len(own), hit % len(own)
        # Of one fingerprint's links into one set the first is enough.
        label = np.fromiter(map(sets.find, range(len(own))), np.int64, len(own))
        _, first = np.unique(who * len(own) + label[whom], return_index=True)
        who, whom = who[first], whom[first]
        new = np.array([sets.join(len(own) + i + x, y) for x, y in zip(who.tolist(), whom.tolist())], bool)
        a.append(part[who[new]])
        b.append(own[whom[new]])
    return np.concatenate(a), np.concatenate(b)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of equal (start, key) in rows (start, key, fp, role) that are sorted by them; one run is held at a time."""
    held: list[list[np.ndarray]] = []
    at = None
    for b in batches:
        start, key, fp, role = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(start):
            continue
        edge = np.flatnonzero((start[1:] != start[:-1]) | (key[1:] != key[:-1])) + 1
        for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(start)]):
            now = (int(start[lo]), int(key[lo]))
            if now != at and held:
                yield at[0], np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                held = []
            at = now
            held.append([fp[lo:hi].view(np.uint64), role[lo:hi]])
    if held:
        yield at[0], np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])


def _link(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Links of all buckets of a task, less those that earlier links of the task imply; up to ``most`` fingerprints are remembered for that."""
    sets = _Sets()
    for start, fp, role in _grouped(batches):
        a, b = spanning(np.unique(fp[role == 0]), np.unique(fp[role == 1]), start)
        if len(sets.up) > most:
            sets = _Sets()
        new = np.array([sets.join(x, y) for x, y in zip(a.tolist(), b.tolist())], bool)
        if new.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[new].view(np.int64)) for x in (a, b)], names=["a", "b"])


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("start", "key").sortWithinPartitions("start", "key").mapInArrow(_link, "a long, b long")


def _keys(depth: int) -> Column:
    """An array of (start, key): the first ``depth`` segments from each start as one number."""
    fp = F.col("fp")
    out = []
    for i in range(SEGMENTS):
        key = F.lit(0).cast("long")
        for k in range(depth):
            key = F.shiftleft(key, 13).bitwiseOR(segment(fp, i + k))
        out.append(F.struct(F.lit(i).alias("start"), key.alias("key")))
    return F.array(*out)


def _variants(depth: int) -> list[int]:
    """Differences, in key order, that a chain of this depth allows; the first segment never differs."""
    ways = [(0, 0)]
    for k in range(2, depth + 1):
        nxt = []
        for bits, used in ways:
            room = RADIUS * k // SEGMENTS - used
            masks = [(0, 0), *((1 << i, 1) for i in range(13))]
            if room >= 2:
                masks += [((1 << i) | (1 << j), 2) for i in range(13) for j in range(i)]
            nxt += [((bits << 13) | m, used + c) for m, c in masks if c <= room]
        ways = nxt
    return [b for b, _ in ways if b]


def links(nodes: DataFrame, limit: int = 4096) -> DataFrame:
    """nodes(fp): distinct fingerprints -> (a, b): links whose components are those of all pairs within four bits.

    The rows of one first segment share the depth of their chain: a row finds
    its neighbours under varied keys of that depth, so none may go deeper alone.
    """
    out, rows = None, nodes.select("fp", F.inline(_keys(1))).withColumn("root", F.col("key"))
    for depth in (1, 2, 3):
        big = None
        if depth < 3:
            big = cut(rows.groupBy("start", "root", "key").count().where(F.col("count") > limit).select("start", "root").distinct())
            if big.isEmpty():
                big = None
        small = rows if big is None else rows.join(big, ["start", "root"], "left_anti")
        stored = small.select("start", "key", "fp", F.lit(0).alias("role"))
        if depth > 1:
            flips = F.array(*[F.lit(v).cast("long") for v in _variants(depth)])
            asked = small.select("start", F.explode(F.transform(flips, lambda v: F.col("key").bitwiseXOR(v))).alias("key"), "fp", F.lit(1).alias("role"))
            stored = stored.unionByName(asked)
        found = _dealt(stored)
        out = found if out is None else out.unionByName(found)
        if big is None:
            break
        longer = rows.join(big, ["start", "root"], "left_semi").select("fp", "start", "root")
        rows = longer.select("fp", "start", F.element_at(_keys(depth + 1), F.col("start") + 1)["key"].alias("key"), "root")
    return out


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fp, component_id): the smallest id reachable over links of four or fewer bits, for each row."""
    fps = written(fingerprints(docs, text, id_col))
    nodes = cut(fps.groupBy("fp").agg(F.min(id_col).alias("low")))
    comp = components(links(nodes.select("fp")))
    joined = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    # Cut off before the join, so that AQE can split a component with very many fingerprints.
    least = cut(joined.groupBy("label").agg(F.min("low").alias("component_id")))
    by_fp = cut(joined.select("fp", "label").join(least, "label").select("fp", "component_id"))
    return fps.join(by_fp, "fp").select(id_col, "fp", "component_id")


def op7_simhash(spark, sf_dir):
    """doc_id, fingerprint (16 hex digits), component_id: one row for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
