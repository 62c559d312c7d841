"""Near copies by the Jaccard similarity of word shingles: SimHash chains and MinHash bands propose, whole shingle sets confirm.

SimHash with pigeonring chains (``simhash``, here over the shingle set) proposes
pairs within four bits. That alone can't give this operator's result: at
similarity 0.8 fingerprints differ in about ten of 64 bits, a radius at which no
segment of a chain is equal and which an index can't search. MinHash bands
propose the rest: a pair at similarity s shares a band of ``ROWS`` minima with a
chance of s^ROWS, so of pairs at 0.8 the ``BANDS`` miss 3 in a million, and fewer
above.

Rows of equal shingle sets are one node. A proposal is a bucket of nodes. The
texts of all nodes proposed are picked once. The chains' proposals are confirmed
first, which unites large groups of nearly equal texts; of the bands' buckets
only those go on that hold several components, of buckets with the same nodes
one, and of a bucket's nodes those with a partner in another component whose
fingerprint is within ``NEAR`` bits (a pair at 0.8 is, but for 2 in a million;
nodes of fewer than 64 shingles always are). What is left is compared set by
set until its links span all that is linked.

A bucket of more than ``limit`` nodes is dealt in chunks: the nodes outside its
largest component meet all chunks, so every pair of different components meets
and no task holds more than two chunks. Where more than ``limit`` nodes are
outside, one chunk meets all others first, and the components are taken anew.

Cases: a null or empty text has the empty set, and such rows are copies of
each other; a text of up to ``width`` words is one shingle. Extra columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, drop, release, written
from .components import components
from .simhash import links, majority, shingles

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 32, 5
#: Nodes of a chunk of a crowded bucket.
LIMIT = 1024
#: Differing bits of fingerprints beyond which sets of ``MANY`` shingles and more are not compared.
NEAR, MANY = 24, 64


def band_keys(found: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """One signed key for each band of minima of a shingle set; none for the empty set."""
    from xxhash import xxh64_intdigest

    if not len(found):
        return []
    rng = np.random.default_rng(11)
    a, b = rng.integers(0, 2**63, (2, bands * rows, 1), dtype=np.uint64)
    a = a * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(found), 1024):
        least = np.minimum(least, (found[None, i : i + 1024] * a + b).min(axis=1))
    keys = [xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(bands, rows))]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs(row, id, text) -> (row, id, digest of the shingle set, fp, few: whether it is small, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            digest, fp, few, keys = [], [], [], []
            for x in b.column(2):
                found = np.unique(shingles(x.as_py() or b"", width))
                digest.append(xxh3_128_digest(found.tobytes()))
                fp.append(majority(found))
                few.append(len(found) < MANY)
                keys.append(band_keys(found))
            cols = [pa.array(digest, pa.binary()), pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), pa.array(few, pa.bool_()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["row", "id", "digest", "fp", "few", "keys"])

    kind = dict(docs.dtypes)["id"]
    return docs.select("row", "id", F.col("text").cast("binary")).mapInArrow(run, f"row long, id {kind}, digest binary, fp long, few boolean, keys array<long>")


def forest(nodes: list[int], sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Links that span the components of all pairs of a bucket at ``least`` or more; quadratic in a bucket only where nothing links."""
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    left, edges = np.ones(len(sets), dtype=bool), []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first] = False
        queue = [first]
        while queue and left.any():
            p = queue.pop()
            lo, hi = np.searchsorted(flat, sets[p], "left"), np.searchsorted(flat, sets[p], "right")
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
            both = np.bincount(owner[at], minlength=len(sets))
            hit = np.flatnonzero(left & (both / (size + size[p] - both) >= least))
            left[hit] = False
            edges += [(nodes[p], nodes[q]) for q in hit.tolist()]
            queue += hit.tolist()
    return edges


def _links(width: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            edges = forest(nodes, sets, least) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])

        at, nodes, sets = None, [], []
        for b in batches:
            keys, parts, names = (b.column(i).to_pylist() for i in range(3))
            for i, now in enumerate(zip(keys, parts)):
                if now != at:
                    yield out()
                    nodes, sets = [], []
                at = now
                if not nodes or nodes[-1] != names[i]:
                    nodes.append(names[i])
                    sets.append(np.unique(shingles(b.column(3)[i].as_py() or b"", width)))
        yield out()

    return run


def bands(nodes: DataFrame) -> DataFrame:
    """nodes(node, keys) -> (key, node, n): buckets of two and more nodes, n of them, that share a band; of buckets with the same nodes one."""
    same = W.partitionBy("key")
    # Nearly all keys have one node: they are counted where they meet, so each is shuffled once.
    rows = nodes.select("node", F.explode("keys").alias("key"))
    rows = rows.select("key", "node", F.count("*").over(same).alias("n"), *[F.bit_xor(F.xxhash64("node", F.lit(i))).over(same).alias(f"x{i}") for i in (0, 1)])
    crowds = written(rows.where("n > 1"))
    one = crowds.groupBy("n", "x0", "x1").agg(F.min("key").alias("key"))
    return crowds.join(one.select("key"), "key").select("key", "node", "n")


def chains(nodes: DataFrame) -> DataFrame:
    """nodes(node, fp) -> (key, node, n): buckets of equal fingerprints, and of the two ends of each link that the chains find."""
    fps = cut(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    equal = nodes.join(fps.where("n > 1").select("fp", "n"), "fp").select(F.xxhash64(F.lit("fp"), "fp").alias("key"), "node", "n")
    near = cut(links(fps.select("fp")))
    ends = near.join(fps.select(F.col("fp").alias("a"), F.col("first").alias("u")), "a").join(fps.select(F.col("fp").alias("b"), F.col("first").alias("v")), "b")
    return equal.unionByName(ends.select(F.xxhash64(F.lit("link"), "a", "b").alias("key"), F.explode(F.array("u", "v")).alias("node"), F.lit(2).cast("long").alias("n")))


def confirm(dealt: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """dealt(key, part, node), texts(node, text) -> (a, b): links that span what is near within each (key, part)."""
    met = dealt.join(texts, "node").select("key", "part", "node", "text")
    return met.repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(_links(width, least), "a long, b long")


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, part, node, fp, few, label) sorted by the first three: those with a partner of another label in their (key, part) that is near by its fingerprint."""

    def out(rows: list[list[np.ndarray]]) -> pa.RecordBatch:
        key, part, node, fp, few, label = (np.concatenate(x) for x in zip(*rows))
        new = np.append(True, node[1:] != node[:-1])  # a node may come twice
        key, part, node, fp, few, label = (x[new] for x in (key, part, node, fp, few, label))
        fp, keep = fp.view(np.uint64), np.zeros(len(node), bool)
        for i in range(0, len(node), 256):
            near = (np.bitwise_count(fp[i : i + 256, None] ^ fp[None, :]) <= NEAR) | few[i : i + 256, None] | few[None, :]
            keep[i : i + 256] = (near & (label[i : i + 256, None] != label[None, :])).any(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, part, node)], names=["key", "part", "node"])

    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        edge = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
        for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), b.num_rows]):
            now = [c[lo:hi] for c in cols]
            if held and (held[-1][0][0], held[-1][1][0]) != (now[0][0], now[1][0]):
                yield out(held)
                held = []
            held.append(now)
    if held:
        yield out(held)


def _apart(dealt: DataFrame) -> DataFrame:
    """dealt(key, part, node, fp, few, label) -> (key, part, node) of what has to be compared."""
    rows = dealt.select("key", "part", "node", "fp", "few", "label").repartition("key", "part").sortWithinPartitions("key", "part", "node")
    return rows.mapInArrow(_partners, "key long, part long, node long")


def _mixed(members: DataFrame, comp: DataFrame, limit: int) -> DataFrame:
    """members(key, node, n, fp, few), comp(node, label) -> these with label, chunk, chunks and rest (the number outside the key's largest component) and outer (whether the node is), for keys of several components."""
    named = cut(members.join(comp, "node", "left").withColumn("label", F.coalesce("label", "node")))
    parts = named.groupBy("key", "label").agg(F.count("*").alias("k"), F.first("n").alias("n")).groupBy("key").agg(F.max(F.struct("k", "label")).alias("most"), F.first("n").alias("n"))
    several = parts.where("most.k < n").select("key", F.col("most.label").alias("most"), (F.col("n") - F.col("most.k")).alias("rest"))
    chunks = F.ceil(F.col("n") / limit).cast("long")
    met = named.join(several, "key").withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("node", "key"), chunks))
    return cut(met.withColumn("outer", F.col("label") != F.col("most")))


def linked(pairs: DataFrame, crowds: DataFrame, nodes: DataFrame, texts: DataFrame, width: int = WIDTH, least: float = LEAST, limit: int = LIMIT) -> DataFrame:
    """Buckets of chains and bands (key, node, n), nodes(node, fp, few), texts(node, text) -> (node, label): the components of all near copies that share a bucket."""

    def through(dealt: DataFrame) -> DataFrame:
        return cut(confirm(cut(_apart(dealt)), texts, width, least))

    alone = nodes.select("node", "fp", "few", F.col("node").alias("label"))
    edges, comp = None, None
    for members in (pairs, crowds):
        held = written(members.join(alone.drop("label"), "node"))
        if comp is None:
            comp = alone.select("node", "label").where("false")
        met = _mixed(held, comp, limit)
        long = lambda x: F.array(x.cast("long"))
        crowded = met.where(F.col("rest") > limit)
        if not crowded.isEmpty():
            # One chunk meets all others, so what is near it is one component afterwards.
            hub = F.when(F.col("chunk") == 0, F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.col("chunks") - 1))).otherwise(long(F.col("chunk")))
            found = through(crowded.withColumn("part", F.explode(hub)))
            edges = found if edges is None else edges.unionByName(found)
            comp = cut(components(edges))
            met = _mixed(held, comp, limit)
        rows = F.ceil(F.col("rest") / limit).cast("long")
        place = lambda i, j: i * F.col("chunks") + j
        first = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
        i = F.pmod(F.xxhash64("node", "key", F.lit(1)), rows)
        whole = met.where("chunks = 1").withColumn("part", F.lit(0).cast("long"))
        asked = met.where("chunks > 1 and outer").withColumn("part", F.explode(F.transform(first(F.col("chunks")), lambda j: place(i, j))))
        all_ = met.where("chunks > 1").withColumn("part", F.explode(F.transform(first(rows), lambda k: place(k, F.col("chunk")))))
        found = through(whole.unionByName(asked).unionByName(all_))
        edges = found if edges is None else edges.unionByName(found)
        comp = cut(components(edges))
        drop(held)
    return comp


def firsts(docs: DataFrame, width: int = WIDTH, least: float = LEAST, limit: int = LIMIT) -> DataFrame:
    """Stored docs(row: unique long, id, text) -> (row): of each group of near copies the row with the smallest id, then the smallest row."""
    spark = docs.sparkSession
    drawn = written(sketches(docs, width))
    nodes = drawn.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("low"), F.min("fp").alias("fp"), F.first("few").alias("few"), F.first("keys").alias("keys"))
    nodes = written(nodes.select(F.col("low.row").alias("node"), "low", "fp", "few", "keys"))
    drop(drawn)
    crowds, pairs = written(bands(nodes)), written(chains(nodes))
    release(spark)
    # Neither side's size has a bound, so it is merged at every size.
    picked = crowds.select("node").unionByName(pairs.select("node")).distinct()
    texts = docs.select(F.col("row").alias("node"), F.col("text").cast("binary").alias("text")).join(picked.hint("merge"), "node", "left_semi")
    texts = written(texts)
    release(spark)
    comp = linked(pairs, crowds, nodes, texts, width, least, limit)
    labelled = nodes.join(comp, "node", "left").select(F.coalesce("label", "node").alias("label"), "low")
    kept = cut(labelled.groupBy("label").agg(F.min("low").alias("low")).select(F.col("low.row").alias("row")))
    for table in (nodes, crowds, pairs, texts):
        drop(table)
    release(spark)
    return kept
