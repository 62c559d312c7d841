"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, BPE.

run(spark, sf_dir) applies STAGES to documents; each stage's result is written
as Parquet in the shared folder and read again as the next one's input. All but
the last stage return the columns of documents. SQL cannot express the
pipeline, so ORACLE_SQL is None; tests hold it against a brute-force version.
"""

from pyspark.sql import functions as F

from lodestone.llm import bpe, mixing, nearcopies, pii, quality
from lodestone.llm.common import documents, quoted, written


def quality_stage(spark, docs, sf_dir):
    """Keep the documents that the quality rules keep."""
    return quality.judge(docs, keep=tuple(docs.columns)).where("quality.kept").select("row.*")


def near_duplicate_stage(spark, docs, sf_dir):
    """Keep one row of each group of near-duplicates (five-word Jaccard similarity of 0.8 or more, and what that links): that with the smallest doc_id
    (null is smallest), and the first stored of rows that repeat it."""
    held = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[quoted(c) for c in docs.columns]).alias("doc"))
    found = nearcopies.firsts(held.select("row", F.col("doc.doc_id").alias("id"), F.col("doc.text").alias("text")))
    # The documents left have no bound, so they are merged at every size.
    return held.join(found.hint("merge"), "row", "left_semi").select("doc.*")


def pii_stage(spark, docs, sf_dir):
    """Replace personal data by its kind in brackets."""
    return pii.redact(docs)


def mixing_stage(spark, docs, sf_dir):
    """Repeat each document as often as the mix takes it."""
    return mixing.mix(docs)


def bpe_stage(spark, docs, sf_dir):
    """Token ids of every document row, with the digests of ids and decoded text."""
    return bpe.encode(docs, bpe.tokenizer_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("pii", pii_stage),
    ("mix_sources", mixing_stage),
    ("bpe", bpe_stage),
]


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
