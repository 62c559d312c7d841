"""Removal of repeated substrings, by sorting suffixes around content-chosen anchors.

A byte goes if a string of ``LENGTH`` (50) bytes that covers it also starts in
a document with a smaller id. Strings that are equal hold the same anchor: the
gram of 26 bytes whose hash is the smallest of the string's 25 grams (the
leftmost of equals). Neighbouring strings with one anchor form a run, about 13
strings long, so a text is a list of runs, and equal strings lie in runs of
equal anchors. The steps:

1. ``packs``: documents are packed into rows of about a megabyte.
2. ``shared``: each pack sends the distinct hashes of its anchors, five bytes
   each, to hash buckets, and gets back which are also elsewhere, and which
   are in very many packs.
3. ``runs_of``: only runs with a shared anchor go on, with the bytes their
   strings cover (up to 74).
4. ``_sorted_bucket``: the suffixes in a bucket are sorted deep-shallow; equal
   strings meet, and strings of a document with a larger id than the smallest
   holder's are removed. Runs whose anchor is in very many packs, or very often
   in one, are first collapsed by content and joined, so no hot passage gathers
   in one task.
5. ``_finish``: the removed intervals come back to the packs.

Cases: null counts as the empty text. A null id is larger than all others. Rows
with one id never remove from each other. Texts under 50 bytes keep all. An
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import deepshallow
from .common import cut, drop, release, written

LENGTH, GRAM = 50, 26
WINDOW = LENGTH - GRAM + 1
PACK, BLOCK = 1 << 20, 1 << 17
#: An anchor in more packs than this, or more often than this in one pack, is hot: one that is not has at most HOT * HOT runs.
HOT = 64
#: Each bucket of runs is worked through in so many parts, by the anchor.
PARTS = 16
NO_ID = (1 << 63) - 1

def _packed(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def _data(packed: bytes, ends: list[int]) -> bytes:
    return pa.decompress(packed, ends[-1], codec="zstd", asbytes=True) if ends[-1] else b""


_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(50).integers(0, 2**64, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        n = BLOCK + 2 * LENGTH
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            t = np.full(n, b, np.uint64)
            t[0] = 1
            _powers.append(np.cumprod(t))
    return _powers


def _grams(u: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the gram at each position of at most BLOCK + LENGTH bytes."""
    up, down = _power_tables()
    h = np.zeros(len(u) + 1, np.uint64)
    np.cumsum(_TABLE[u] * up[: len(u)], out=h[1:])
    v = (h[GRAM:] - h[:-GRAM]) * down[: len(u) - GRAM + 1]
    v ^= v >> np.uint64(32)
    v *= np.uint64(0xFF51AFD7ED558CCD)
    v ^= v >> np.uint64(29)
    return v


def _leftmost(v: np.ndarray) -> np.ndarray:
    """For each WINDOW of 32-bit values the position of its smallest, the leftmost of equals: the position rides in the low half."""
    m, width = (v.astype(np.uint64) << np.uint64(32)) | np.arange(len(v), dtype=np.uint64), 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        m = np.minimum(m[:-step], m[step:])
        width += step
    return (m & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs(data: bytes, ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (first string's start, last string's start, anchor's position, anchor's hash) of documents that end at ``ends`` in data.
    Only runs are held beyond a block, so a very long text takes little more memory than its own."""
    u = np.frombuffer(data, np.uint8)
    n = len(u) - LENGTH + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, np.zeros(0, np.uint64)
    ok = np.ones(n, bool)
    for e in ends[:-1]:
        ok[max(0, e - LENGTH + 1) : e] = False  # these would cross a border
    parts: list[list[np.ndarray]] = []
    for b in range(0, n, BLOCK):
        s = np.flatnonzero(ok[b : b + BLOCK])
        if not len(s):
            continue
        v = _grams(u[b : b + BLOCK + LENGTH - 1])
        at = _leftmost((v >> np.uint64(32)).astype(np.uint32))[s]
        turn = np.flatnonzero((at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)) + 1
        lo = np.concatenate([[0], turn])
        hi = np.concatenate([turn, [len(s)]]) - 1
        now = [s[lo] + b, s[hi] + b, at[lo] + b, v[at[lo]]]
        if parts and parts[-1][2][-1] == now[2][0] and parts[-1][1][-1] + 1 == now[0][0]:  # the run goes on over the blocks' border
            parts[-1][1][-1] = now[1][0]
            now = [x[1:] for x in now]
        if len(now[0]):
            parts.append(now)
    if not parts:
        return empty, empty, empty, np.zeros(0, np.uint64)
    lo, hi, q, h = (np.concatenate(x) for x in zip(*parts))
    return lo, hi, q, h


def packs(docs: DataFrame, text: str, id_col: str, limit: int = PACK) -> DataFrame:
    """(pack, ids, ends, data): documents side by side, compressed, since the joins by pack shuffle them; the pack's number is kept in the row, so later steps need no task's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, n = TaskContext.get().partitionId() << 32, 0
        ids, ends, parts, size = [], [], [], 0

        def out():
            cols = [pa.array([base + n], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int32())), pa.array([_packed(b"".join(parts))], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["pack", "ids", "ends", "data"])

        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(1)):
                data = data.as_py() or b""
                if ids and size + len(data) > limit:
                    yield out()
                    n, ids, ends, parts, size = n + 1, [], [], [], 0
                size += len(data)
                ids.append(key)
                ends.append(size)
                parts.append(data)
        if ids:
            yield out()

    schema = "pack long, ids array<bigint>, ends array<int>, data binary"
    return docs.select(F.col(id_col).cast("long"), F.col(text).cast("binary")).mapInArrow(run, schema)


def _keyed(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in the order (bucket, rest), and for each input its place among them."""
    key, inverse = np.unique(h, return_inverse=True)
    by = np.lexsort((key // np.uint64(buckets), key % np.uint64(buckets)))
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    return key[by], place[inverse], by


def _five(rest: np.ndarray) -> bytes:
    return rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _rows(b: pa.RecordBatch) -> Iterator[list]:
    """The rows of a batch, one in memory at a time."""
    for i in range(b.num_rows):
        yield [c[i].as_py() for c in b.columns]


def shared(held: DataFrame, buckets: int, hot_at: int = HOT) -> DataFrame:
    """(pack, bucket, bits): for the pack's distinct hashes in a bucket, in order, one bit for 'also elsewhere' and then one for 'hot'."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, ends, data in _rows(b):
                lo, _, _, h = runs(_data(data, ends), ends)
                if not len(h):
                    continue
                key, place, _ = _keyed(h, buckets)
                doc = np.searchsorted(ends, lo, side="right")
                first = np.full(len(key), len(ends), np.int64)
                np.minimum.at(first, place, doc)
                many = np.zeros(len(key), bool)
                many[place[doc != first[place]]] = True
                heavy = np.bincount(place, minlength=len(key)) > hot_at
                bucket = (key % np.uint64(buckets)).astype(np.int64)
                rest = (key // np.uint64(buckets)) & np.uint64((1 << 40) - 1)
                edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(key)]]).tolist()
                at = [int(bucket[i]) for i in edge[:-1]]
                body = [_five(rest[i:j]) for i, j in zip(edge, edge[1:])]
                flag = [np.packbits(np.concatenate([many[i:j], heavy[i:j]])).tobytes() for i, j in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([pack] * len(at), pa.int64()), pa.array(body, pa.binary()), pa.array(flag, pa.binary())], names=["bucket", "pack", "body", "flag"])

    def meet(t: pa.Table) -> pa.Table:
        body, sizes, flags, heavies = [], [], [], []
        for x, f in zip(t.column("body").to_pylist(), t.column("flag").to_pylist()):
            five = np.frombuffer(x, np.uint8).reshape(-1, 5)
            eight = np.zeros((len(five), 8), np.uint8)
            eight[:, :5] = five
            body.append(eight.view("<u8").reshape(-1))
            n = len(five)
            sizes.append(n)
            m = np.unpackbits(np.frombuffer(f, np.uint8), count=2 * n).astype(bool)
            flags.append(m[:n])
            heavies.append(m[n:])
        rest, flag, heavy = np.concatenate(body), np.concatenate(flags), np.concatenate(heavies)
        del body, flags, heavies
        order = np.argsort(rest, kind="stable")
        s = rest[order]
        turn = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1])
        count = np.diff(np.append(turn, len(s)))
        hot_ = (count > hot_at) | np.logical_or.reduceat(heavy[order], turn)
        both, hot = np.empty(len(s), bool), np.empty(len(s), bool)
        both[order], hot[order] = np.repeat(count > 1, count), np.repeat(hot_, count)
        both |= flag
        at = np.cumsum([0, *sizes])
        bits = [np.packbits(np.concatenate([both[i:j], hot[i:j]])).tobytes() for i, j in zip(at, at[1:])]
        return pa.table({"pack": t.column("pack"), "bucket": t.column("bucket"), "bits": pa.array(bits, pa.binary())})

    sent = held.select("pack", "ends", "data").mapInArrow(send, "bucket int, pack long, body binary, flag binary")
    return sent.groupBy("bucket").applyInArrow(meet, "pack long, bucket int, bits binary")


def _blob(ctx: list[bytes], part: np.ndarray, off: np.ndarray, lo: np.ndarray, ids: np.ndarray, pack: np.ndarray) -> bytes:
    """Runs side by side: lengths, parts, anchor places, starts, ids, packs, contexts."""
    size = np.fromiter(map(len, ctx), np.int64, len(ctx)) - LENGTH
    kinds = ((size, "u1"), (part, "u1"), (off, "u1"), (lo, "<i4"), (ids, "<i8"), (pack, "<i8"))
    return b"".join([*[x.astype(k).tobytes() for x, k in kinds], *ctx])


class _Runs:
    """The runs of many blobs; ``text`` holds their contexts side by side."""

    def __init__(self, n: list[int], raw: list[int], blobs: pa.ChunkedArray):
        cols: list[list[np.ndarray]] = [[] for _ in range(6)]
        texts = []
        for k, size, blob in zip(n, raw, blobs):
            data = pa.decompress(blob.as_buffer(), size, codec="zstd", asbytes=True)
            at = 0
            for c, kind in zip(cols, ("u1", "u1", "u1", "<i4", "<i8", "<i8")):
                c.append(np.frombuffer(data, kind, k, at).copy())
                at += c[-1].nbytes
            texts.append(data[at:])
        self.text = b"".join(texts)
        size, self.part, self.off, self.lo, self.ids, self.pack = (np.concatenate(c) for c in cols)
        self.size = size.astype(np.int64) + LENGTH
        self.end = np.cumsum(self.size)

    def contexts(self, at: np.ndarray) -> list[bytes]:
        end = self.end[at]
        return [self.text[i:j] for i, j in zip((end - self.size[at]).tolist(), end.tolist())]


def runs_of(held: DataFrame, bits: DataFrame, buckets: int, cold_buckets: int, flush: int = 8 << 20) -> DataFrame:
    """Runs with a shared anchor; a run's context covers its strings. Hot runs are rows (off, ctx, id, pack, lo), off being the anchor's place in
    ctx; the others are one compressed blob for each bucket of anchors and ``flush`` bytes of packs (bucket, n, raw, blob)."""
    names = ["off", "ctx", "id", "pack", "lo", "bucket", "n", "raw", "blob"]
    kinds = [pa.int16(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def batch(rows: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[c], k) if c in cols else pa.nulls(rows, k) for c, k in zip(names, kinds)], names=names)

    def cold(texts: list[bytes], waiting: list[list[np.ndarray]]) -> pa.RecordBatch:
        of, bucket, part, off, lo, hi, own, pack = (np.concatenate(x) for x in zip(*waiting))
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(order)]]).tolist()
        at, sizes, blobs = [order[i:j] for i, j in zip(edge, edge[1:])], [], []
        for x in at:
            ctx = [texts[k][i : j + LENGTH] for k, i, j in zip(of[x].tolist(), lo[x].tolist(), hi[x].tolist())]
            raw = _blob(ctx, part[x], off[x], lo[x], own[x], pack[x])
            sizes.append(len(raw))
            blobs.append(_packed(raw))
        return batch(len(at), bucket=bucket[edge[:-1]].astype(np.int32), n=[len(x) for x in at], raw=sizes, blob=blobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, waiting, size = [], [], 0
        for b in batches:
            for pack, ids, ends, data, got in _rows(b):
                data = _data(data, ends)
                lo, hi, q, h = runs(data, ends)
                key, place, _ = _keyed(h, buckets)
                bucket = (key % np.uint64(buckets)).astype(np.int64)
                both, hot = np.zeros(len(key), bool), np.zeros(len(key), bool)
                for x in got:
                    i, j = np.searchsorted(bucket, [x["bucket"], x["bucket"] + 1]).tolist()
                    m = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=2 * (j - i)).astype(bool)
                    both[i:j], hot[i:j] = m[: j - i], m[j - i :]
                own = np.array([NO_ID if i is None else i for i in ids], np.int64)[np.searchsorted(ends, lo, side="right")]
                pick = np.flatnonzero(both[place] & hot[place])
                ctx = [data[i : j + LENGTH] for i, j in zip(lo[pick].tolist(), hi[pick].tolist())]
                yield batch(len(pick), off=(q - lo)[pick].astype(np.int16), ctx=ctx, id=own[pick], pack=np.full(len(pick), pack, np.int64), lo=lo[pick].astype(np.int32))
                pick = np.flatnonzero(both[place] & ~hot[place])
                if not len(pick):
                    continue
                mixed = h[pick] >> np.uint64(20)
                waiting.append([np.full(len(pick), len(texts), np.int32), (mixed % np.uint64(cold_buckets)).astype(np.int64), (h[pick] % np.uint64(PARTS)).astype(np.uint8), (q - lo)[pick].astype(np.uint8), lo[pick].astype(np.int32), hi[pick].astype(np.int32), own[pick], np.full(len(pick), pack, np.int64)])
                texts.append(data)
                size += len(data)
                if size >= flush:
                    yield cold(texts, waiting)
                    texts, waiting, size = [], [], 0
        if waiting:
            yield cold(texts, waiting)

    by_pack = bits.groupBy("pack").agg(F.collect_list(F.struct("bucket", "bits")).alias("got"))
    joined = held.join(by_pack, "pack").select("pack", "ids", "ends", "data", "got")
    return joined.mapInArrow(run, "off short, ctx binary, id long, pack long, lo int, bucket int, n int, raw int, blob binary")


def _lowest_of(ctx: list[bytes], low: np.ndarray) -> list[np.ndarray]:
    """The smallest id of each string of some contexts, after a deep-shallow sort of all their strings."""
    size = np.fromiter(map(len, ctx), np.int64, len(ctx))
    k = size - LENGTH + 1
    blob = np.frombuffer(b"".join(ctx), np.uint8)
    first = np.concatenate([[0], np.cumsum(k)])
    owner = np.repeat(np.arange(len(ctx)), k)
    start = np.repeat(np.cumsum(size) - size - first[:-1], k) + np.arange(first[-1])
    order, new = deepshallow.sort(np.lib.stride_tricks.sliding_window_view(blob, LENGTH)[start])
    at = np.flatnonzero(new)
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(low[owner[order]], at), np.diff(np.append(at, len(order))))
    return np.split(least, first[1:-1])


def lowest(ctx: list[bytes], gram: np.ndarray, low: np.ndarray, piece: int = 1 << 16) -> list[np.ndarray]:
    """For classes of runs (distinct contexts with their smallest id): the smallest id of each of their strings. The anchors' classes are
    sorted about ``piece`` strings at a time, so memory follows the largest anchor only."""
    n = np.fromiter(map(len, ctx), np.int64, len(ctx)) - LENGTH + 1
    out: list[np.ndarray] = [None] * len(ctx)
    order = np.argsort(gram, kind="stable")
    edge = np.concatenate([[0], np.flatnonzero(np.diff(gram[order])) + 1, [len(order)]])
    for i in order[edge[:-1][np.diff(edge) == 1]].tolist():
        out[i] = np.full(n[i], low[i], np.int64)
    several = np.flatnonzero(np.diff(edge) > 1)
    waiting, held = [], 0
    for last, g in enumerate(several.tolist(), 1 - len(several)):
        at = order[edge[g] : edge[g + 1]]
        waiting.append(at)
        held += int(n[at].sum())
        if held >= piece or not last:
            at = np.concatenate(waiting)
            for i, x in zip(at.tolist(), _lowest_of([ctx[i] for i in at.tolist()], low[at])):
                out[i] = x
            waiting, held = [], 0
    return out


def _intervals(lo: np.ndarray, ids: np.ndarray, cls: np.ndarray, lows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of removed bytes, for runs at lo with their ids and classes."""
    least = np.array([x.min() for x in lows], np.int64)
    most = np.array([x.max() for x in lows], np.int64)
    size = np.array([len(x) for x in lows], np.int64)
    whole = np.flatnonzero(ids > most[cls])
    rows, start, end = [whole], [lo[whole]], [lo[whole] + size[cls[whole]] + LENGTH - 1]
    for r in np.flatnonzero((ids > least[cls]) & (ids <= most[cls])).tolist():
        t = np.flatnonzero(lows[cls[r]] < ids[r])
        turn = np.flatnonzero(np.diff(t) != 1)
        a, z = t[np.concatenate([[0], turn + 1])], t[np.concatenate([turn, [len(t) - 1]])]
        rows.append(np.full(len(a), r))
        start.append(lo[r] + a)
        end.append(lo[r] + z + LENGTH)
    return np.concatenate(rows), np.concatenate(start), np.concatenate(end)


def _by_pack(pack: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
    """Intervals packed into one row for each pack."""
    order = np.argsort(pack, kind="stable")
    pack, start, end = pack[order], start[order].astype("<i4"), end[order].astype("<i4")
    edge = np.concatenate([[0], np.flatnonzero(np.diff(pack)) + 1, [len(pack)]]).tolist() if len(pack) else [0]
    parts = list(zip(edge, edge[1:]))
    return pa.table(
        {
            "pack": pa.array([int(pack[i]) for i, _ in parts], pa.int64()),
            "starts": pa.array([start[i:j].tobytes() for i, j in parts], pa.binary()),
            "ends_": pa.array([end[i:j].tobytes() for i, j in parts], pa.binary()),
        }
    )


def _sorted_bucket(t: pa.Table) -> pa.Table:
    """The runs of one bucket, part by part: equal contexts are one class (its anchor is known by a hash that holds within the task), the classes' strings are sorted."""
    r = _Runs(t.column("n").to_pylist(), t.column("raw").to_pylist(), t.column("blob"))
    found = []
    for part in range(PARTS):
        at = np.flatnonzero(r.part == part)
        if not len(at):
            continue
        seen: dict[tuple, int] = {}
        cls = np.array([seen.setdefault(k, len(seen)) for k in zip(r.off[at].tolist(), r.contexts(at))], np.int64)
        ids = r.ids[at]
        low = np.full(len(seen), NO_ID, np.int64)
        np.minimum.at(low, cls, ids)
        gram = np.array([hash(c[o : o + GRAM]) for o, c in seen], np.int64)
        rows, start, end = _intervals(r.lo[at].astype(np.int64), ids, cls, lowest([c for _, c in seen], gram, low))
        found.append((r.pack[at][rows], start, end))
    return _by_pack(*(np.concatenate(x) for x in zip(*found)))


_OUT = "pack long, starts binary, ends_ binary"


#: The hash that stands for a run's anchor.
_ANCHOR = "xxhash64(substring(ctx, off + 1, 26))"


def _verdicts(t: pa.Table) -> pa.Table:
    """For classes of hot runs: the smallest ids of their strings, where some holder's id exceeds one."""
    lows = lowest(t.column("ctx").to_pylist(), t.column("gram").to_numpy(), t.column("low").to_numpy())
    high = t.column("high").to_numpy()
    pick = [i for i, x in enumerate(lows) if x.min() < high[i]]
    return pa.table({"k1": t.column("k1").take(pick), "k2": t.column("k2").take(pick), "lows": pa.array([lows[i] for i in pick], pa.list_(pa.int64()))})


def _hot(rows: DataFrame, buckets: int, limit: int) -> DataFrame:
    """Intervals of runs with a hot anchor. Runs of equal content are one class after a partial aggregation; the classes are sorted, and the runs
    are joined to their classes' verdicts (AQE splits a class with very many runs). An anchor with more than ``limit`` classes is not sorted in one
    bucket: the strings of its classes meet by content, again after a partial aggregation."""
    key = [F.xxhash64("off", "ctx").alias("k1"), F.xxhash64(F.lit(1), "ctx", "off").alias("k2")]
    classes = written(rows.groupBy("off", "ctx").agg(F.min("id").alias("low"), F.max("id").alias("high")).select(*key, F.expr(_ANCHOR).alias("gram"), "ctx", "low", "high"))
    heavy = cut(classes.groupBy("gram").count().where(F.col("count") > limit).select("gram"))
    light = classes.join(heavy, "gram", "left_anti").groupBy(F.pmod("gram", F.lit(buckets)).alias("bucket"))
    lows = light.applyInArrow(lambda t: _verdicts(t), "k1 long, k2 long, lows array<bigint>")
    if not heavy.isEmpty():
        at = F.sequence(F.lit(0), F.length("ctx") - LENGTH)
        strings = classes.join(heavy, "gram", "left_semi").select("k1", "k2", "low", F.posexplode(F.transform(at, lambda i: F.substring(F.col("ctx"), i + 1, F.lit(LENGTH)))).alias("t", "string"))
        least = cut(strings.groupBy("string").agg(F.min("low").alias("least")))
        of_class = strings.join(least, "string").groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("t", "least")))["least"].alias("lows"))
        lows = lows.unionByName(of_class)
    met = rows.select(*key, "id", "pack", "lo").join(written(lows), ["k1", "k2"])
    at = F.sequence(F.lit(0), F.size("lows") - 1)
    each = met.select("pack", "lo", F.filter(at, lambda t: F.get("lows", t) < F.col("id")).alias("ts")).where(F.size("ts") > 0)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(b.column(2)).to_numpy())
            lo = b.column(1).to_numpy().astype(np.int64)[row] + b.column(2).flatten().to_numpy()
            turn = np.flatnonzero((lo[1:] != lo[:-1] + 1) | (row[1:] != row[:-1])) + 1
            first, last = np.concatenate([[0], turn]), np.concatenate([turn, [len(lo)]]) - 1
            yield from _by_pack(b.column(0).to_numpy()[row[first]], lo[first], lo[last] + LENGTH).to_batches()

    return each.mapInArrow(fold, _OUT)


def _finish(held: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, ends, data, got in _rows(b):
                data = _data(data, ends)
                u = np.frombuffer(data, np.uint8)
                change = np.zeros(len(u) + 1, np.int32)
                for x in got or ():
                    np.add.at(change, np.frombuffer(x["starts"], "<i4"), 1)
                    np.add.at(change, np.frombuffer(x["ends_"], "<i4"), -1)
                covered = np.cumsum(change[:-1], dtype=np.int32) > 0
                out, at = [], 0
                for i, e in zip(ids, ends):
                    c = covered[at:e]
                    n = int(c.sum())
                    spans = int(c[:1].sum() + (c[1:] & ~c[:-1]).sum()) if n else 0
                    out.append((i, e - at, n, spans, sha256(u[at:e][~c].tobytes() if n else data[at:e]).hexdigest()))
                    at = e
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=names)

    by_pack = gone.groupBy("pack").agg(F.collect_list(F.struct("starts", "ends_")).alias("got"))
    joined = held.join(by_pack, "pack", "left").select("ids", "ends", "data", "got")
    return joined.mapInArrow(run, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", bucket_bytes: int = 16 << 20, pack_bytes: int = PACK, hot_at: int = HOT, class_limit: int = 8192
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256): one row for each input row.

    Each step's result is written, so a lost executor repeats one step and the
    step's shuffle files can go.
    """
    spark = docs.sparkSession
    held = written(packs(docs, text, id_col, pack_bytes))
    total = held.agg(F.sum(F.element_at("ends", -1).cast("long")).alias("n")).first()["n"] or 0
    buckets = max(1, -(-total // bucket_bytes))
    bits = written(shared(held, buckets, hot_at))
    release(spark)
    found = written(runs_of(held, bits, buckets, 4 * buckets))
    drop(bits)
    release(spark)
    gone = written(_hot(found.where("bucket is null"), 4 * buckets, class_limit))
    release(spark)
    cold = found.where("bucket is not null").select("bucket", "n", "raw", "blob").groupBy("bucket")
    gone = gone.unionByName(written(cold.applyInArrow(lambda t: _sorted_bucket(t), _OUT)))
    drop(found)
    release(spark)
    return _finish(held, gone, id_col)


def op10_repeated_substrings(spark, sf_dir):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs)
