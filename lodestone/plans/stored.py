"""Stored tables and indexes that change in place, read back after their changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bm25
from ..operators.blockmax import BlockIndex, cells
from ..operators import summaries as S
from ..operators.segments import SegmentedIndex
from ..sources import corpus
from ..sources.keyed import KeyedTable
from ..streaming.events import work_dir
from . import retrieval
from .relational import table

QUERIES, ORACLES = {}, {}


def query(sql):
    def add(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return add


@query("SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN label + 100 ELSE label END AS label, len(embedding)::BIGINT AS dim FROM embeddings WHERE (vec_id % 3 <> 0 OR vec_id % 2 = 0) AND vec_id % 7 <> 0")
def upserted_collection(spark, sf):
    """A vector collection: two thirds written, every even row renewed or added, every seventh deleted."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    held = KeyedTable.create(e.where("vec_id % 3 <> 0"), work_dir(spark), ["vec_id"])
    held.upsert(e.where("vec_id % 2 = 0").withColumn("label", F.col("label") + 100))
    held.delete(e.where("vec_id % 7 = 0"))
    return held.read().select("vec_id", "label", F.size("embedding").cast("long").alias("dim"))


@query("SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 'solved' ELSE event_type END AS event_type FROM events")
def updated_log(spark, sf):
    """A log whose errors are renewed by key; buckets without an error keep their files."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    held = KeyedTable.create(e, work_dir(spark), ["event_id"])
    held.upsert(e.where("event_type = 'error'").withColumn("event_type", F.lit("solved")))
    return held.read()


@query("SELECT conv_id, before, CASE WHEN conv_id % 5 = 0 THEN 'Chat ' || conv_id ELSE before END AS after FROM (SELECT conv_id, substring(arg_min(text, turn), 1, 40) AS before FROM conversations WHERE role = 'user' GROUP BY conv_id)")
def renamed_threads(spark, sf):
    """Threads by their first question, some renamed: both versions of the stored table, met by key."""
    c = table(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 40).alias("title"))
    held = KeyedTable.create(c, work_dir(spark), ["conv_id"], buckets=16)
    held.upsert(c.where("conv_id % 5 = 0").select("conv_id", F.concat(F.lit("Chat "), F.col("conv_id").cast("string")).alias("title")))
    return held.read(1).withColumnRenamed("title", "before").join(held.read().withColumnRenamed("title", "after"), "conv_id")


def _changed(docs):
    """The documents as they are after the changes of ``changed_index``: every tenth is gone, of every seventh the first half is left."""
    half = F.substring("text", 1, F.floor(F.length("text") / 2).cast("int"))
    return docs.where("doc_id % 10 <> 3").withColumn("text", F.when(F.col("doc_id") % 7 == 0, half).otherwise(F.col("text")))


_AFTER = retrieval._BM25.replace("FROM documents)", "FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN substring(text, 1, (length(text) // 2)::INT) ELSE text END AS text FROM documents WHERE doc_id % 10 <> 3))", 1)


@query(f"WITH {_AFTER} SELECT * FROM lx WHERE rank <= 10")
def changed_index(spark, sf):
    """A lexical index in segments: documents come in five parts, some again with another text, some go; a search then equals that of an index built anew."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held = SegmentedIndex(spark, work_dir(spark))
    for i in range(5):
        held.add(docs.where(f"doc_id % 5 = {i}"))
    held.add(_changed(docs).where("doc_id % 7 = 0"))
    held.delete(docs.where("doc_id % 10 = 3").select("doc_id"))
    return bm25.search(held.index(), bm25.query_terms(retrieval._asked(spark, sf), "query"), 10)


def _block_search(spark, sf):
    """Passages of a text as queries hold forty words and more, most of them frequent; only narrow blocks bound these."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    counts = bm25.term_counts(docs, cells=cells(spark, docs.count()))
    index = BlockIndex.build(bm25.build(docs, markdown=False, counts=counts), work_dir(spark), width=2)
    return index.begun(bm25.query_terms(retrieval._asked(spark, sf), "query"), 10)


@query(retrieval.ORACLES["bm25_topk"])
def blockmax_topk(spark, sf):
    """The lexical search by blocks of postings: the rows of ``bm25_topk``."""
    return _block_search(spark, sf).best()


@query("SELECT count(DISTINCT item_id) AS n_queries, true AS under_half FROM benchmark")
def blockmax_share(spark, sf):
    """Fewer than half of the queries' postings are scored for it."""
    share = _block_search(spark, sf).share()
    return share.agg(F.count("*").alias("n_queries"), (F.sum("n_scored") < 0.5 * F.sum("n_postings")).alias("under_half"))


@query("SELECT event_id, event_type, value FROM events WHERE event_id // 4 < 100 + 40 * (event_id % 4)")
def log_until_bad(spark, sf):
    """Four logs of JSON lines, each broken at one place: what came before it is read, and nothing after."""
    path = work_dir(spark)
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    part, broken = F.col("event_id") % 4, F.floor(F.col("event_id") / 4) == 100 + 40 * (F.col("event_id") % 4)
    line = F.when(broken, F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"))).otherwise(F.to_json(F.struct("event_id", "event_type", "value")))
    rows = e.select(part.alias("part"), "event_id", line.alias("value")).repartition("part").sortWithinPartitions("part", "event_id")
    rows.select("part", "value").write.partitionBy("part").text(path)
    return corpus.jsonl_until_bad(spark, path, "event_id long, event_type string, value double")


_WORDS = r"list_filter(string_split_regex({x}, '[ \t\n]+'), lambda w: w <> '')"


@query(rf"""WITH RECURSIVE r AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format(x="coalesce(text, '')")} AS w, 0 AS level FROM documents
UNION ALL SELECT doc_id, t, {_WORDS.format(x='t')} AS w, level FROM (SELECT doc_id, level + 1 AS level, array_to_string(list_transform(range(0, len(w), 200), lambda s, i: 'Section ' || i || ':' || chr(10) || array_to_string(w[s + 1:s + 20], ' ')), chr(10) || chr(10)) AS t FROM r WHERE len(w) > 100))
SELECT doc_id, level, md5(t) AS text_md5, len(w)::BIGINT AS n_words FROM r WHERE len(w) <= 100""")
def level_summaries(spark, sf):
    """Documents brought to a hundred words by levels: chunks of 200 words, their first twenty, and again."""
    fits = lambda t: F.size(S.words(t)) <= 100
    got = S.by_levels(table(spark, sf, "documents"), "doc_id", "text", fits, S.word_chunks(200), S.first_words(20))
    return got.select("doc_id", "level", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.size(S.words(F.col("text"))).cast("long").alias("n_words"))


def _folder(spark, sf):
    """The documents as one file for each source and language, in the order of their ids, below a new folder."""
    path = work_dir(spark)
    d = table(spark, sf, "documents").where("text is not null").select("source", "lang", "doc_id", "text")
    d.repartition("source", "lang").sortWithinPartitions("source", "lang", "doc_id").drop("doc_id").write.partitionBy("source", "lang").text(path)
    return path


_FILES = "SELECT source, lang, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS t FROM documents WHERE text IS NOT NULL GROUP BY source, lang"


def _named(column):
    return [F.regexp_extract(column, f"{k}=([^/]*)/", 1).alias(k) for k in ("source", "lang")]


@query(f"SELECT source, lang, length(t) AS n_chars, md5(t) AS text_md5 FROM ({_FILES})")
def stored_markdown(spark, sf):
    """A folder of texts read whole, a row a file, with what its path says."""
    rows = corpus.markdown(spark, _folder(spark, sf), recursive=True, glob="*.txt")
    return rows.select(*_named("file_path"), F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"SELECT source, lang, strlen(t) AS n_bytes, md5(t) AS content_md5 FROM ({_FILES})")
def stored_binary(spark, sf):
    """The same folder as bytes, as a page parser takes them."""
    rows = corpus.binary(spark, _folder(spark, sf), glob="*.txt")
    return rows.select(*_named("path"), F.col("length").alias("n_bytes"), F.md5("content").alias("content_md5"))


@query(f"SELECT source, lang, strlen(t) AS n_bytes FROM ({_FILES})")
def listed_inputs(spark, sf):
    """The folder's files as a list of inputs; contents are not read."""
    return corpus.inputs(spark, _folder(spark, sf), glob="*.txt").select(*_named("path"), F.col("length").alias("n_bytes"))


@query("SELECT source, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars, min(doc_id) AS first_id FROM documents GROUP BY source")
def stored_json_documents(spark, sf):
    """One JSON document a source, over several lines, that holds its documents as a list; each file is read whole."""
    path = work_dir(spark)
    d = table(spark, sf, "documents").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "n_chars"))).alias("docs"))
    d.select("source", F.to_json(F.struct(F.col("source").alias("name"), "docs"), {"pretty": "true"}).alias("value")).repartition("source").write.partitionBy("source").text(path)
    read = corpus.json_document(spark, path, "name string, docs array<struct<doc_id: long, n_chars: long>>")
    total = F.aggregate("docs", F.lit(0).cast("long"), lambda s, x: s + x["n_chars"])
    return read.select(F.col("name").alias("source"), F.size("docs").cast("long").alias("n_docs"), total.alias("n_chars"), F.array_min(F.transform("docs", lambda x: x["doc_id"])).alias("first_id"))
