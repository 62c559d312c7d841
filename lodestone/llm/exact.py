"""Exact dedup by progressive refinement.

Texts are equal when they are identical after each run of white space is made
one space. Three keys, each dearer than the one before, settle them:

1. the length in bytes: a text alone with its length is settled;
2. the hash of its first characters, among texts whose length is shared;
3. the SHA-256 of the whole text, only for texts whose length and prefix are
   shared. Of equal texts the row with the smallest id stays.

The first scan writes length and prefix hash of each row (twelve bytes), from
which steps 1 and 2 count with partial aggregation. The surviving pairs of
length and prefix are marked in a table of ``slots`` bits, which is bounded and
broadcast; the second scan looks its pair up there and hashes the whole text
only where the bit is set. Two pairs that share a slot cost a hash too many and
never change a result: step 3 groups by the whole hash. Texts are never
shuffled, only their hashes, and only groups of two and more are joined.

Cases: null text counts as empty, so all empty texts are one group. A null id
comes after all others, so a group stays by a row with an id if it has one.
Of rows that repeat an id within a group one stays. An empty table gives an
empty result. The kept columns lie in the struct ``row`` and the verdicts in
the struct ``dedup``, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, documents, drop, quoted, written

#: Characters of the prefix that is hashed in step 2.
PREFIX = 128
#: Bits of the table of surviving pairs: 65,536 words of 64 bits, under 4 MB when broadcast.
SLOTS = 1 << 22


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _short(norm: Column, prefix: int) -> list[Column]:
    return [F.octet_length(norm).alias("length"), F.xxhash64(F.substring(norm, 1, prefix)).alias("prefix")]


def survivors(keys: DataFrame) -> DataFrame:
    """(length, prefix) that more than one row has. Rows alone with their length never reach the second grouping."""
    lengths = cut(keys.groupBy("length").count().where("count > 1").select("length"))
    # Rows are counted by pair before they meet the lengths, so a group of very many copies is one row there.
    counted = written(keys.groupBy("length", "prefix").count())
    return counted.join(lengths, "length", "left_semi").where("count > 1").select("length", "prefix")


def marks(pairs: DataFrame, slots: int) -> DataFrame:
    """(word, bits): the slots of these pairs as bits of at most slots / 64 rows."""
    slot = pairs.select(_slot(slots).alias("slot"))
    return slot.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))


def _slot(slots: int) -> Column:
    return F.pmod(F.xxhash64("length", "prefix"), F.lit(slots))


def refine(df: DataFrame, text: str = "text", id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), prefix: int = PREFIX, slots: int = SLOTS) -> DataFrame:
    """(row: the kept columns, dedup: keep_id, group_size, kept), for each input row."""
    norm = normalised(quoted(text))
    keys = written(df.select(*_short(norm, prefix)))
    table = cut(marks(survivors(keys), slots))
    drop(keys)
    held = df.select(F.struct(*[quoted(c) for c in keep]).alias("row"), quoted(id).alias("id"), norm.alias("norm"), *_short(norm, prefix))
    slot = held.select("row", "id", "norm", _slot(slots).alias("slot")).withColumn("word", F.shiftright("slot", 6))
    looked = slot.join(F.broadcast(table), "word", "left")
    survives = F.expr("coalesce(getbit(bits, cast(slot & 63 as int)), 0) = 1")
    whole = written(looked.select("row", "id", F.monotonically_increasing_id().alias("at"), F.when(survives, F.unhex(F.sha2("norm", 256))).alias("whole")))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "at"))
    # Groups are cut off, so that the join has an exchange on either side and AQE can split a group of very many rows.
    groups = cut(whole.where("whole is not null").groupBy("whole").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1"))
    met = whole.where("whole is not null").join(groups, "whole", "left")
    verdict = F.struct(F.when(F.col("n") > 1, F.col("first.id")).otherwise(F.col("id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), F.coalesce(F.col("first.at") == F.col("at"), F.lit(True)).alias("kept"))
    alone = F.struct(F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return met.select("row", verdict.alias("dedup")).unionByName(whole.where("whole is null").select("row", alone.alias("dedup")))


def deduplicate(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns."""
    return refine(df, text, id, keep=tuple(df.columns)).where("dedup.kept").select("row.*")


def op12_exact_dedup(spark, sf_dir):
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each document."""
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("text_sha256", F.sha2(normalised(F.col("text")), 256))
    return refine(docs, keep=("doc_id", "text_sha256")).select("row.doc_id", "dedup.keep_id", "dedup.group_size", "dedup.kept", "row.text_sha256")
