"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from a bounded
sample of labelled texts. A text is encoded, whole, in blocks of ``block``
bytes with every dictionary; the language whose encoding is smallest wins.
The score compares the best two sizes; if the margin is under ``margin`` the
answer is marked ``rejected`` (the smallest stays the prediction).

Bounds: ``sample`` labelled texts of each language, ``dict_bytes`` of
dictionary for each. Which texts those are depends on a hash of their id only.
Each gives an equal share of the dictionary, in pieces of ``piece`` letters
from evenly spread places of the whole text. The driver holds languages x
dict_bytes: the lang values are taken to be a closed set.

Cases: null, empty and letterless texts are ``und`` with score 0. A null lang
or id teaches nothing, and a null id is not held out. Ties go to the smaller lang value. Without any labelled text
every answer is ``und``. Repeated rows are answered each; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def letters(text: Column) -> Column:
    """The lower-case letters of a whole text with one space for anything between: what both the dictionaries and the encodings see."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")


def train(labelled: DataFrame, sample: int = 200, dict_bytes: int = 65536, piece: int = 160) -> dict[str, bytes]:
    """labelled(doc_id, text, lang) -> dictionary content by language, from at most ``sample`` texts of each and at most ``dict_bytes``.

    Longer texts give more pieces only where others are shorter than their
    share: pieces are taken round by round until the dictionary is full. What
    reaches the driver is bounded by languages x 4 dict_bytes; the top
    ``sample`` of each language are found with a limit before the shuffle
    (WindowGroupLimit), so a language with most rows does not gather in a task.
    """
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    most = max(1, 4 * dict_bytes // (sample * piece))
    ids = labelled.where("lang is not null and text is not null and doc_id is not null").where(F.col("text").rlike(r"\p{L}"))
    top = ids.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("lang", "r", letters(F.col("text")).alias("text"))
    # Places of up to ``most`` pieces that do not overlap, spread over the text.
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.length("text") / piece).cast("int")))
    start = lambda i: (i * (F.length("text") - piece) / F.greatest(F.lit(1), F.col("n") - 1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring("text", F.greatest(F.lit(0), start(i)) + 1, F.lit(piece)))
    rows = top.withColumn("n", n).select("lang", "r", pieces.alias("pieces")).orderBy("lang", "r").collect()
    out: dict[str, bytes] = {}
    for lang in sorted({x["lang"] for x in rows}):
        mine = [x["pieces"] for x in rows if x["lang"] == lang]
        taken, size = [], 0
        for k in range(most):
            for x in mine:
                at = sorted(range(len(x)), key=lambda i: (i % 2, i))  # every other piece first
                if k < len(x) and size < dict_bytes:
                    taken.append(x[at[k]].encode("utf-8", "replace"))
                    size += len(taken[-1]) + 1
        out[lang] = b"\n".join(reversed(taken))[-dict_bytes:]
    return out


class Sizer:
    """Encoded size of a text with each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 9, block: int = 4096):
        import zstandard as z

        self.block, self.names, self.coders = block, list(dictionaries), []
        for content in dictionaries.values():
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            params = z.ZstdCompressionParameters.from_level(level, write_content_size=0, write_checksum=0, write_dict_id=0)
            d.precompute_compress(compression_params=params)
            self.coders.append(z.ZstdCompressor(dict_data=d, compression_params=params))

    def sizes(self, data: bytes) -> list[int]:
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]


def answer(sizer: Sizer, data: bytes, margin: float = 0.02) -> tuple[str, float, bool]:
    if not sizer.names:
        return "und", 0.0, True
    s = sorted(zip(sizer.sizes(data), sizer.names))
    if len(s) == 1:
        return s[0][1], 1.0, False
    gap = (s[1][0] - s[0][0]) / max(1, s[1][0])
    return s[0][1], min(1.0, 0.5 + gap * 2.5), gap < margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", id_col: str = "doc_id", margin: float = 0.02) -> DataFrame:
    """(id, lang_pred, score, rejected) for each row. The dictionaries are bounded by languages x dict_bytes and travel with the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(dictionaries)
        for b in batches:
            got = [answer(sizer, t, margin) if spoken else ("und", 0.0, True) for t, spoken in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            cols = [pa.array([x[i] for x in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[id_col, "lang_pred", "score", "rejected"])

    kind = dict(docs.dtypes)[id_col]
    spoken = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.select(id_col, letters(F.col(text)).cast("binary").alias("_text"), spoken.alias("_spoken")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")


def op6_language_id(spark, sf_dir):
    """doc_id, held_out, lang_pred, score, rejected: one row for each document. Learns from rows of folds 0 and 2 only."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = train(docs.where(fold() != 1).select("doc_id", "text", "lang"))
    out = identify(docs, learned)
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
