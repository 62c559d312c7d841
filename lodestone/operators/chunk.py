"""Chunkers: one text in, an array of chunks out, all with array functions.

Units are words unless said otherwise. Greedy packing takes n log n for n
paragraphs: running totals, a search by halving for each chunk's end, and the
chain of starts by doubling steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def starts(total: Column, size: Column, overlap: int) -> Column:
    """Start offsets 0, size - overlap, ... below the total; a last chunk may lie wholly inside the one before."""
    return F.when(total > 0, F.sequence(F.lit(0), (total - 1).cast("int"), (size - overlap).cast("int"))).otherwise(F.array().cast("array<int>"))


def fixed(words: Column, size: int, overlap: int) -> Column:
    """Array of struct(start, end, text)."""
    return _slices(words, F.lit(size), overlap)


def _slices(words: Column, size: Column, overlap: int) -> Column:
    total = F.size(words)
    cut = lambda s: F.struct(s.alias("start"), F.least(s + size, total).cast("int").alias("end"), F.array_join(F.slice(words, s + 1, size.cast("int")), " ").alias("text"))
    return F.transform(starts(total, size, overlap), cut)


def uniform(words: Column, target: int, overlap: int) -> Column:
    """One chunk up to the target; beyond it chunks of one size, so that n of them with overlaps span the text."""
    total = F.size(words)
    n = F.ceil((total - overlap) / F.lit(target - overlap))
    size = F.when(total <= target, F.lit(target)).otherwise(F.ceil((total + (n - 1) * overlap) / n))
    whole = F.array(F.struct(F.lit(0).alias("start"), total.alias("end"), F.array_join(words, " ").alias("text")))
    return F.when(total == 0, F.expr("cast(array() as array<struct<start: int, end: int, text: string>>)")).when(total <= target, whole).otherwise(_slices(words, size, overlap))


def _bound(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``name`` standing for a value that is made once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def paragraph_ranges(counts: str, size: int, overlap: int, older: bool = False) -> Column:
    """For an array column of token counts: array of struct(start, end) of greedily packed paragraphs.

    A chunk takes paragraphs until the next would pass ``size``, one at least;
    the next chunk starts ``overlap`` paragraphs before its end (never at or
    before its own start). ``older``: at most all but one of its paragraphs are
    repeated, and the chunk that reaches the end is the last.
    """
    n = f"size({counts})"
    zero = f"transform(concat(array(0), {counts}), x -> cast(x as bigint))"
    rounds = f"sequence(0, cast(ceil(log2({n} + 1)) as int))"
    total = f"aggregate({rounds}, {zero}, (acc, k) -> transform(acc, (x, i) -> if(i >= shiftleft(1, k), x + acc[i - shiftleft(1, k)], x)))"
    further = f"e + shiftleft(1, k) <= {n} and p[e + shiftleft(1, k)] - p[i] <= {size}"
    end = f"aggregate(reverse({rounds}), i + 1, (e, k) -> if({further}, e + shiftleft(1, k), e))"
    ends = f"transform(sequence(0, {n} - 1), i -> {end})"
    back = f"least({overlap}, e - i - 1)" if older else str(overlap)
    after = f"greatest(i + 1, e - {back})"
    following = f"concat(transform(ends, (e, i) -> {f'if(e = {n}, {n}, {after})' if older else after}), array({n}))"
    # After each round s holds twice as many starts of the chain, and f leads twice as far.
    chain = f"aggregate({rounds}, named_struct('s', array(0), 'f', {following}), (c, k) -> named_struct('s', concat(c.s, transform(c.s, x -> c.f[x])), 'f', transform(c.f, x -> c.f[x])), c -> array_distinct(filter(c.s, x -> x < {n})))"
    ranges = _bound(total, "p", _bound(ends, "ends", f"transform({chain}, i -> named_struct('start', i, 'end', ends[i]))"))
    return F.expr(f"if({n} = 0, cast(array() as array<struct<start: int, `end`: int>>), {ranges})")


def sections(text: str) -> list[str]:
    """A markdown text cut before each of its headings."""
    import re

    return [s for s in (x.strip("\n") for x in re.split(r"^(?=#{1,6}\s+\S)", text, flags=re.M)) if s.strip()]


def tail_size(chars: int, overlap: int) -> int:
    """How many of a chunk's last characters the next one repeats: ``overlap`` estimated tokens, none of a chunk that is not longer."""
    n = chars // 4
    size = overlap * chars // n if n >= overlap > 0 else 0
    return size if size < chars else 0


def packing(units: list[tuple[int, int]], size: int, overlap: int) -> list[tuple[int, int, int]]:
    """Chunks as (characters repeated from the chunk before, first unit, end unit), out of nothing but (length, place) of the units: place 0 is a
    section, 1 the first paragraph of one over the size, 2 a later one. Units meet with two line ends between. A chunk ends where the next unit's
    estimated tokens would pass ``size``, and before a section over it; later paragraphs of such a section repeat nothing."""
    plan: list[tuple[int, int, int]] = []
    carried = held = begin = 0
    for k, (chars, place) in enumerate(units):
        full = held and held // 4 + chars // 4 > size
        if held and (full or place == 1):
            plan.append((carried, begin, k))
            carried = 0 if place == 2 else tail_size(held, overlap)
            held, begin = carried, k
            if place == 1 and carried and carried // 4 + chars // 4 > size:  # what is repeated leaves no room: it stands alone
                plan.append((carried, k, k))
                carried = held = 0
        held += chars + (2 if held else 0)
    return plan + [(carried, begin, len(units))] if held else plan


def by_headers(df: DataFrame, text: str, size: int, overlap: int, keep: list[str]) -> DataFrame:
    """Markdown sections packed up to ``size`` estimated tokens, with the end of the chunk before; a section over the size is packed by its paragraphs.

    Where a chunk ends depends on what the chunk before hands on, so whole
    texts go through an Arrow batch function: lengths are packed first, then
    the chunks are cut.
    """

    def pack(t: str) -> list[str]:
        units: list[str] = []
        places: list[int] = []
        for s in sections(t):
            parts = s.split("\n\n") if len(s) // 4 > size else [s]
            units += parts
            places += [0] if len(s) // 4 <= size else [1] + [2] * (len(parts) - 1)
        out: list[str] = []
        for carried, first, end in packing([(len(u), p) for u, p in zip(units, places)], size, overlap):
            out.append("\n\n".join(([out[-1][-carried:]] if carried else []) + units[first:end]))
        return out

    return _per_text(df, text, keep, pack)


SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def _merged(parts: list[str], sep: str, size: int, overlap: int) -> list[str]:
    """Neighbours put together up to the size, up to ``overlap`` characters of them again in the next chunk."""
    out, held, n = [], [], 0
    for p in parts:
        extra = len(p) + (len(sep) if held else 0)
        if held and n + extra > size:
            out.append(sep.join(held))
            while held and (n > overlap or n + len(p) + len(sep) > size):
                n -= len(held.pop(0)) + (len(sep) if held else 0)
            extra = len(p) + (len(sep) if held else 0)
        held.append(p)
        n += extra
    return out + [sep.join(held)] if held else out


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """One text's chunks."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    out, fine = [], []
    for p in text.split(sep) if sep else list(text):
        if len(p) <= size:
            fine.append(p)
            continue
        out += _merged(fine, sep, size, overlap)
        fine = []
        out += split_recursively(p, size, overlap, finer) if finer else [p]
    return [c for c in (x.strip() for x in out + _merged(fine, sep, size, overlap)) if c]


def recursive(df: DataFrame, text: str, size: int, overlap: int, keep: list[str], separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """Split at the coarsest separator that occurs, finer within pieces over ``size`` characters, then merge neighbours with up to ``overlap`` characters repeated."""
    return _per_text(df, text, keep, lambda t: split_recursively(t, size, overlap, separators))


def _per_text(df: DataFrame, text: str, keep: list[str], fn) -> DataFrame:
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at, out = [], [], []
            for i, t in enumerate(b.column(len(keep)).to_pylist()):
                for n, c in enumerate(fn(t) if t else ()):
                    rows.append(i)
                    at.append(n)
                    out.append(c)
            cols = [b.column(k).take(pa.array(rows, pa.int64())) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(at, pa.int32()), pa.array(out, pa.string())], names=[*keep, "chunk_index", "chunk"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", chunk_index int, chunk string"
    return df.select(*keep, text).mapInArrow(run, schema)


def with_orphans(pieces: Column) -> Column:
    """Pieces with lone equation, figure and reference marks put back to the piece before (a leading one stays alone)."""
    held = F.transform(F.array(pieces), lambda p: F.struct(p.alias("p"), F.filter(F.transform(p, lambda x, i: F.when((i == 0) | ~T.orphan(x), i)), lambda i: i.isNotNull()).alias("heads")))
    until = lambda s, k: F.coalesce(F.get(s["heads"], k + 1), F.size(s["p"]))
    joined = lambda s: F.transform(s["heads"], lambda h, k: F.array_join(F.slice(s["p"], h + 1, until(s, k) - h), "\n"))
    return F.get(F.transform(held, joined), F.lit(0))


def token_span(words: Column, index: Column, size: int, start: Column | None = None, end: Column | None = None) -> Column:
    """A chunk by its stored token positions, or by its number and the chunk size where it has none."""
    at = F.coalesce(start, index * size) if start is not None else index * size
    to = F.coalesce(end, at + size) if end is not None else at + size
    return F.array_join(F.slice(words, (at + 1).cast("int"), F.greatest(F.lit(0), to - at).cast("int")), " ")
