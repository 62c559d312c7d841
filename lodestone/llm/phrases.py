"""Collocations by hashed counting of phrases, one length after another.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and
pieces into words. A phrase of k words is counted in pass k, and in the same
pass the phrases of k + 1 words are counted by hash bucket. A phrase is counted
exactly only if its bucket holds the least count and both phrases of one word
less inside it are frequent (in pass k + 1 their buckets are known too, so
only phrases between two candidates go to a bucket at all). Both tests are
bitmaps of one fixed number of slots, broadcast; a slot shared by chance costs
a count too many and changes no result, since counts are of the words
themselves.

A task counts its texts in stretches of a few megabytes and hands on the counts
of each stretch, summed with partial aggregation by Spark, and its buckets as
compressed segments of saturated bytes, which are added segment by segment, one
batch at a time. The driver sees bitmaps only, of a size known beforehand.

Scores come from joins of the frequent phrases with their parts: of the cuts of
a phrase in two, the one with the lowest floor(2000000 a / (l + r)) counts. A
phrase inside a longer candidate with at least 80 % of its count is dropped.

Cases: null text has no words; a null language is ``und``. A word that fills
more than a stretch, and texts without any punctuation, are counted whole:
stretches end between words and take up the last three words of the one before.
An empty table gives an empty result; extra columns are not read. Repeated rows
count each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import cut, documents, drop, quoted, release, written

LONGEST = 4
#: Bytes of text that are counted together, and slots of a segment.
STRETCH, SEGMENT = 4 << 20, 1 << 14
#: Of each byte: 0 in a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_OUT = "lang string, phrase string, n long, segment int, blob binary"
_FIELDS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("segment", pa.int32()), ("blob", pa.binary())])


class Stretch:
    """Words of some text of one language: codes into a dictionary, the piece of each, and whether it was not in the stretch before."""

    def __init__(self, lang: str, data: np.ndarray, old: int) -> None:
        kind = _KIND[data]
        inside = kind == 0
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.starts, ends = edge[::2], edge[1::2]
        offsets = np.zeros(len(self.starts) + 1, np.int32)
        np.cumsum(ends - self.starts, out=offsets[1:])
        text = pa.py_buffer(_LOWER[data[inside]].tobytes())
        coded = pa.Array.from_buffers(pa.binary(), len(self.starts), [None, pa.py_buffer(offsets), text]).dictionary_encode()
        self.lang, self.words = lang, coded.dictionary
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), self.starts)
        self.fresh = self.starts >= old

    def hashes(self) -> np.ndarray:
        seed = _seed(self.lang)
        return np.fromiter((xxh64_intdigest(w, seed) for w in self.words.to_pylist()), np.uint64, len(self.words))[self.codes]

    def counts(self, at: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
        """The different phrases of k words at these positions, with their counts."""
        same, first = self.codes[at], at
        n = np.ones(len(at), np.int64)
        for j in range(1, k + 1):
            # After j words, ``same`` numbers the phrases of j words; the last round is the count.
            _, first, back, n = np.unique(same, return_index=True, return_inverse=True, return_counts=True)
            if j < k:
                same = (back << 32) | self.codes[at + j]
        heads = at[first] if k else at
        parts = [self.words.take(pa.array(self.codes[heads + j])) for j in range(k)]
        return (pc.binary_join_element_wise(*parts, b" ") if k > 1 else parts[0]).cast(pa.string()), n


def _seed(lang: str) -> int:
    return xxh64_intdigest(lang.encode())


def _longer(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word."""
    x = (g ^ (g >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _stretches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Stretch]:
    for batch in batches:
        langs = batch.column("lang")
        for lang in pc.unique(langs).to_pylist():
            texts = batch.column("text").filter(pc.equal(langs, lang)).cast(pa.large_binary())
            ends = np.cumsum(pc.binary_length(texts).to_numpy())
            at = 0
            while at < len(texts):
                # At least one text, and others as long as there is room; a line end between texts parts their pieces.
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
                yield from _parts(lang, np.frombuffer(b"\n".join(texts.slice(at, to - at).to_pylist()), np.uint8), size)
                at = to


def _parts(lang: str, data: np.ndarray, size: int) -> Iterator[Stretch]:
    start = done = 0
    while done < len(data):
        end = done + size
        while end < len(data):
            gap = np.flatnonzero(_KIND[data[end : end + size]])
            if len(gap):
                end += int(gap[0])
                break
            end += size
        end = min(end, len(data))
        part = Stretch(lang, data[start:end], done - start)
        if len(part.codes):
            yield part
        back = part.starts[-(LONGEST - 1) :]
        start = start + int(back[0]) if len(back) else end
        done = end


def _has(bits: np.ndarray, g: np.ndarray, slots: int) -> np.ndarray:
    slot = g & np.uint64(slots - 1)
    return ((bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _row(lang: str | None = None, phrases: pa.Array | None = None, n: np.ndarray | None = None, segment: int | None = None, blob: bytes | None = None) -> pa.RecordBatch:
    """Counts of phrases, or one segment of buckets."""
    m = 1 if phrases is None else len(phrases)
    cols = [pa.array([lang] * m, pa.string()), pa.nulls(m, pa.string()) if phrases is None else phrases, pa.nulls(m, pa.int64()) if n is None else pa.array(n), pa.array([segment] * m, pa.int32()), pa.array([blob] * m, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, schema=_FIELDS)


def _segments(held: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The segments of a task's buckets that hold anything."""
    codec = pa.Codec("zstd", compression_level=1)
    for k in range(-(-len(held) // SEGMENT)):
        part = held[k * SEGMENT : (k + 1) * SEGMENT]
        if part.any():
            yield _row(segment=k, blob=codec.compress(part.tobytes(), asbytes=True))


def _add(held: np.ndarray, slots: np.ndarray) -> None:
    """Count slots; a count stays at 255."""
    at, n = np.unique(slots, return_counts=True)
    held[at] = np.minimum(held[at] + n, 255)


def _pass(k: int, slots: int, buckets, frequent, size: int):
    """Counts of the phrases of k words that may be frequent, and the buckets of those of k + 1 words; buckets and frequent are broadcast bitmaps (none in pass 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(slots if k < LONGEST else 0, np.uint8)
        full, known = (None, None) if k == 1 else (np.frombuffer(b.value, np.uint8) for b in (buckets, frequent))
        for part in _stretches(batches, size):
            h = part.hashes()
            here = np.zeros(max(len(h) - k + 1, 0), bool)
            at = np.flatnonzero(part.piece[k - 1 :] == part.piece[: len(here)])
            below = g = h
            for j in range(1, k):
                below, g = g, _longer(g[:-1], h[j:])
            if k > 1:
                at = at[_has(known, below[at], slots)]
                at = at[_has(known, below[at + 1], slots)]
                at = at[_has(full, g[at], slots)]
            here[at] = True
            new = at[part.fresh[at + k - 1]]
            if len(new):
                yield _row(part.lang, *part.counts(new, k))
            if k < LONGEST and len(here) > 1:
                both = np.flatnonzero(here[:-1] & here[1:] & part.fresh[k:] & (part.piece[k:] == part.piece[: len(h) - k]))
                _add(held, _longer(g[both], h[both + k]) & np.uint64(slots - 1))
        yield from _segments(held)

    return run


def _mark(slots: int):
    """Buckets that hold the given phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(slots, np.uint8)
        for batch in batches:
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                seed = _seed(lang)
                h = np.array([[xxh64_intdigest(w.encode(), seed)] for w in phrase.split(" ")], np.uint64)
                g = h[0]
                for x in h[1:]:
                    g = _longer(g, x)
                held[g & np.uint64(slots - 1)] = 255
        yield from _segments(held)

    return run


def _fold(least: int):
    """One bit for each slot of a segment that holds the least count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column("segment").to_pylist(), batch.column("blob").to_pylist()):
                part = np.frombuffer(pa.decompress(blob, SEGMENT, codec="zstd"), np.uint8)
                held[k] = np.minimum(held[k] + part.astype(np.uint16), 255).astype(np.uint8) if k in held else part
        for k, part in held.items():
            bits = np.packbits(part >= min(least, 255), bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits], pa.binary())], names=["segment", "blob"])

    return run


def _bitmap(segments: DataFrame, least: int, slots: int) -> bytes:
    """The slots that hold the least count: slots / 8 bytes, whatever the input."""
    dealt = segments.select("segment", "blob").repartition("segment")
    out = bytearray(slots // 8)
    for r in dealt.mapInArrow(_fold(least), "segment int, blob binary").toLocalIterator():
        out[r.segment * SEGMENT // 8 : (r.segment + 1) * SEGMENT // 8] = r.blob
    return bytes(out)


def slots_for(texts: DataFrame, least: int) -> int:
    """Slots for a mean load of about a quarter of the least count: 2 ** 17 to 2 ** 27 (16 MB as a bitmap), beyond which buckets fill and prune less."""
    size = texts.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    return 1 << min(max((size // 6 * 4 // least).bit_length(), 17), 27)


def count(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, slots: int | None = None, size: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, n) of the phrases of one to four words with the least count, and (lang, n), the words of each language."""
    spark = df.sparkSession
    texts = df.select(F.coalesce(quoted(lang), F.lit("und")).alias("lang"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    slots = slots or slots_for(texts, least)
    buckets = frequent = words = None
    found = []
    for k in range(1, LONGEST + 1):
        got = written(texts.mapInArrow(_pass(k, slots, buckets, frequent, size), _OUT))
        counted = got.where("segment is null")
        if k == 1:
            words = cut(counted.groupBy("lang").agg(F.sum("n").alias("n")))
        found.append(written(counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "phrase", F.lit(k).alias("k"), "n")))
        if k < LONGEST:
            for b in (buckets, frequent):
                if b is not None:
                    b.destroy()
            buckets = spark.sparkContext.broadcast(_bitmap(got.where("segment is not null"), least, slots))
            frequent = spark.sparkContext.broadcast(_bitmap(found[-1].select("lang", "phrase").mapInArrow(_mark(slots), _OUT), 1, slots))
        drop(got)
        release(spark)
    for b in (buckets, frequent):
        b.destroy()
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out, words


def _words(first: str, n: str) -> str:
    return f"array_join(slice(split(phrase, ' '), {first}, {n}), ' ')"


def score(found: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, score) of each candidate, at its lowest cut."""
    cuts = found.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.expr(f"inline(transform(sequence(1, k - 1), c -> struct(c as c, {_words('1', 'c')} as head, {_words('c + 1', 'k - c')} as tail)))"))
    heads = found.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = found.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    met = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    value = F.expr("(2000000 * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    lowest = met.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(value.alias("score"), "c", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "k", "a", "cut.l", "cut.r", "cut.score")


def maximal(scored: DataFrame) -> DataFrame:
    """Without the candidates that a longer candidate holds at 80 % of their count or more."""
    parts = "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> " + _words("i", "m") + ")))"
    inside = scored.where("k > 2").select("lang", F.expr(f"explode({parts})").alias("phrase"), F.col("a").alias("longer"))
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = F.expr("longer is null or 100 * cast(longer as decimal(20, 0)) < 80 * cast(a as decimal(20, 0))")
    return scored.join(most, ["lang", "phrase"], "left").where(kept).drop("longer")


def top(scored: DataFrame, n: int) -> DataFrame:
    """The first n of each language; each of some shares of a language is ranked by itself first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(256))
    first = scored.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= n)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= n).drop("share")


def mine(df: DataFrame, text: str = "text", lang: str = "lang", first: int = 2000, least: int = 30, slots: int | None = None, size: int = STRETCH) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first phrases."""
    found, words = count(df, text, lang, least, slots, size)
    scored = written(score(written(found)))
    ranked = top(maximal(scored), first)
    out = ranked.join(words, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir):
    """lang, rank, phrase, a, l, r, n, score: the first 2,000 phrases of each language."""
    return mine(documents(spark, sf_dir))
