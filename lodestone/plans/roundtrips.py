"""Queries that write and read again, and queries of the smaller functions: each against the rows it began with.

Tables are written below spark.checkpoint.dir, in a folder of their own for each call.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import bm25, chunk, evalset, records, rerank, traces
from ..sources import corpus
from ..streaming.events import work_dir
from . import retrieval
from .answer import anonymous, list_papers
from .relational import table

QUERIES, ORACLES = {}, {}


def query(sql):
    def add(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return add


@query(retrieval.ORACLES["bm25_topk"])
def stored_index(spark, sf):
    """A lexical index that is written, read again and searched."""
    path = work_dir(spark)
    docs = table(spark, sf, "documents")
    bm25.build(docs, markdown=False).write(path)
    return bm25.search(bm25.Index.read(spark, path), bm25.query_terms(retrieval._asked(spark, sf), "query"), 10)


@query("SELECT event_id, event_type, value FROM events")
def stored_log(spark, sf):
    """A log of JSON lines that is appended to twice, the second time gzipped, and read again."""
    path = work_dir(spark)
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    corpus.append_jsonl(e.where("event_id % 2 = 0"), path)
    corpus.append_jsonl(e.where("event_id % 2 = 1"), path, gzip=True)
    return corpus.jsonl(spark, path, "event_id long, event_type string, value double").drop("_corrupt_record")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'solved' ELSE event_type END AS event_type FROM events")
def rewritten_log(spark, sf):
    """A log whose errors are marked and which replaces itself."""
    path, schema = work_dir(spark), "event_id long, event_type string"
    corpus.append_jsonl(table(spark, sf, "events").select("event_id", "event_type"), path)
    now = spark.read.schema(schema).json(path)
    corpus.rewrite_jsonl(now.withColumn("event_type", F.when(F.col("event_type") == "error", "solved").otherwise(F.col("event_type"))), path)
    return spark.read.schema(schema).json(path)


@query("SELECT vec_id, len(embedding)::BIGINT AS dim FROM embeddings WHERE label % 2 = 1")
def stored_collection(spark, sf):
    """Two collections that are appended to twice with the same rows, and one of them read."""
    path = work_dir(spark)
    e = table(spark, sf, "embeddings").select(F.concat(F.lit("c"), (F.col("label") % 2).cast("string")).alias("collection"), "vec_id", "embedding")
    corpus.write_collection(e.where("vec_id % 3 = 0"), path, "vec_id")
    corpus.write_collection(e, path, "vec_id")
    return corpus.collection(spark, path, "c1").select("vec_id", F.size("embedding").cast("long").alias("dim"))


@query("SELECT doc_id FROM documents WHERE doc_id % 4 <> 1")
def resumed_run(spark, sf):
    """What is left to do after a checkpoint that holds a quarter of the documents."""
    path = work_dir(spark)
    ids = table(spark, sf, "documents").select("doc_id")
    assert corpus.checkpoint(spark, path, "doc_id long").isEmpty()
    corpus.save_checkpoint(ids.where("doc_id % 4 = 1"), path)
    return corpus.pending(ids, corpus.checkpoint(spark, path, "doc_id long"), "doc_id")


_STAGES = "SELECT event_id // 8 AS trace_id, event_type AS stage, round(sum(value), 4) AS duration_ms FROM events GROUP BY ALL"


@query(f"SELECT trace_id, max(duration_ms) FILTER (WHERE stage = 'click') AS click, max(duration_ms) FILTER (WHERE stage = 'error') AS error FROM ({_STAGES}) GROUP BY trace_id")
def stored_stages(spark, sf):
    """Stage rows that come in two appends and are read as wide traces."""
    path = work_dir(spark)
    e = table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 8).alias("trace_id"), F.col("event_type").alias("stage")).agg(F.round(F.sum("value"), 4).alias("duration_ms"))
    corpus.append_stages(e.where("stage <> 'click'"), path)
    corpus.append_stages(e.where("stage = 'click'"), path)
    read = spark.read.schema("trace_id long, duration_ms double, stage string").parquet(path)
    return traces.wide(read, ("click", "error"))


@query("SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(x) >= 40), chr(10) || chr(10))) AS text_md5, len(list_filter(string_split(text, chr(10)), lambda x: length(x) < 40)) AS removed FROM documents")
def stored_filtered_texts(spark, sf):
    path = work_dir(spark)
    p = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "paragraph")).withColumn("kept", F.length("paragraph") >= 40)
    corpus.write_filtered(p, path)
    meta = spark.read.schema("doc_id long, removed long").json(f"{path}/meta")
    return spark.read.parquet(f"{path}/text").join(meta, "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "removed")


@query("SELECT page_id, url, length(html)::BIGINT AS n FROM pages")
def stored_triple(spark, sf):
    """Pages as markdown, metadata and layout, written apart and met by key."""
    path = work_dir(spark)
    rows = table(spark, sf, "pages").select("page_id", F.col("html").alias("markdown"), F.to_json(F.struct("url")).alias("metadata"), F.lit("[]").alias("layout"))
    corpus.write_triple(rows, path, "page_id")
    meta = spark.read.schema("page_id long, metadata string").json(f"{path}/metadata")
    return spark.read.parquet(f"{path}/markdown").join(meta, "page_id").select("page_id", F.get_json_object("metadata", "$.url").alias("url"), F.length("markdown").cast("long").alias("n"))


@query("SELECT question_type, count(*) AS n FROM (SELECT CASE WHEN item_id % 3 = 0 THEN 'factual' ELSE 'summary' END AS question_type FROM benchmark) GROUP BY question_type UNION ALL SELECT NULL, count(*) FROM benchmark")
def stored_eval_set(spark, sf):
    path = work_dir(spark)
    q = table(spark, sf, "benchmark").select("item_id", F.when(F.col("item_id") % 3 == 0, "factual").otherwise("summary").alias("question_type"))
    corpus.write_eval_set(q, path, ["question_type"])
    return spark.read.schema("question_type string, n long").json(f"{path}/metadata")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'KEEP' WHEN 1 THEN event_type WHEN 2 THEN 'OUT' END AS decision, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'nested' WHEN 2 THEN 'no reason given' END AS reason FROM events")
def decisions(spark, sf):
    """Decisions out of a model's answers: fenced, nested, broken and none."""
    kind, name = F.col("event_id") % 4, F.col("event_type")
    fenced = F.concat(F.lit('```json\n{"decision": "KEEP", "reason": "'), name, F.lit('"}\n```'))
    nested = F.concat(F.lit('I say {"about": {"x": 1}, "decision": "'), name, F.lit('", "reason": "nested"} so'))
    e = table(spark, sf, "events").withColumn("answer", F.when(kind == 0, fenced).when(kind == 1, nested).when(kind == 2, F.lit('"decision": "out", and')).otherwise(name))
    return e.select("event_id", T.decision(F.col("answer")).alias("d")).select("event_id", "d.decision", "d.reason")


@query("SELECT event_id, '[' || event_id || ', {\"k\": [1]}]' AS found FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 2 = 1")
def outer_arrays(spark, sf):
    a = F.concat(F.lit("Here:\n```json\n["), F.col("event_id").cast("string"), F.lit(', {"k": [1]}]\n``` done'))
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, a).otherwise(F.col("event_type")).alias("a"))
    return e.select("event_id", T.outer_json(F.col("a")).alias("found"))


@query("SELECT event_id, round(1 / (1 + exp(-(value - 20) / 10)), 6) AS p, round(exp(value / 50) / (exp(value / 50) + exp(0.5)), 6) AS yes, round_even(value, 1) AS even FROM events")
def probabilities(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", F.round(T.sigmoid((v - 20) / 10), 6).alias("p"), F.round(T.yes_probability(v / 50, F.lit(0.5)), 6).alias("yes"), F.bround(v, 1).alias("even"))


@query("SELECT doc_id, md5(CASE WHEN n <= 100 THEN text ELSE substring(text, 1, (length(text) * 100 // n)::INT) END) AS head, md5(CASE WHEN n <= 20 THEN text ELSE right(text, (length(text) * 20 // greatest(n, 1))::INT) END) AS tail FROM (SELECT doc_id, text, length(text) // 4 AS n FROM documents)")
def cut_by_tokens(spark, sf):
    n = T.token_estimate(F.col("text"))
    cut = {"head": T.by_token_ratio(F.col("text"), n, 100), "tail": T.tail_by_ratio(F.col("text"), n, 20)}
    return table(spark, sf, "documents").select("doc_id", *[F.md5(c.cast("binary")).alias(k) for k, c in cut.items()])


@query("SELECT page_id, replace(replace(regexp_replace(list_last(string_split(url, '/')), '\\.[^.]*$', ''), '_', ' '), '-', ' ') AS name FROM pages")
def pretty_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.pretty_name(F.col("url")).alias("name"))


@query("SELECT doc_id, list_aggregate(list_transform(w[11:30], lambda x: x), 'string_agg', ' ') AS span FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n]+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 30")
def token_spans(spark, sf):
    """Words 10 to 30 of each document: its second chunk of ten by number, to a stored end."""
    w = table(spark, sf, "documents").select("doc_id", F.filter(F.split("text", r"[ \t\n]+"), lambda x: x != "").alias("w")).where(F.size("w") > 30)
    return w.select("doc_id", chunk.token_span(F.col("w"), F.lit(1), 10, end=F.lit(30)).alias("span"))


@query("SELECT DISTINCT source AS file_path, lang AS title FROM documents")
def paper_list(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("file_path"), F.col("lang").alias("title"))
    return list_papers(d)


@query("SELECT event_type, count(*) AS n FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'first' WHEN event_id % 3 = 1 THEN event_type ELSE 'Unknown' END AS shown, event_type FROM events) WHERE shown <> 'Unknown' GROUP BY event_type")
def shown_sources(spark, sf):
    s = F.array(F.struct(F.when(F.col("event_id") % 3 == 0, "first").alias("title"), F.when(F.col("event_id") % 3 == 1, F.col("event_type")).alias("file_path")))
    e = table(spark, sf, "events").select("event_type", records.display_sources(s).alias("s"))
    return e.where(F.get("s", F.lit(0)) != "Unknown").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, list_transform((list(value ORDER BY event_id))[1:5], lambda x: round_even(x, 1))::VARCHAR AS firsts FROM events GROUP BY user_id")
def capped_scores(spark, sf):
    s = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("s"))
    return s.select("user_id", F.concat(F.lit("["), F.array_join(F.transform(records.capped(F.col("s.value"), 5, 1), lambda x: x.cast("string")), ", "), F.lit("]")).alias("firsts"))


@query("SELECT event_id, event_type = 'error' AS anonymous FROM events")
def anonymous_users(spark, sf):
    header = F.when(F.col("event_type") == "error", "True").when(F.col("event_type") == "click", "no")
    return table(spark, sf, "events").select("event_id", anonymous(header).alias("anonymous"))


@query(f"WITH {retrieval._BM25} SELECT query_id, 'fallback' AS method, doc_id, rank FROM lx WHERE rank <= 3")
def failed_scorer(spark, sf):
    """A scorer that fails leaves every query's order as it came: that of the lexical search."""
    hits = retrieval._lexical(spark, sf, 8).select("query_id", "doc_id", F.col("rank").alias("orig_rank"))
    rows = hits.join(retrieval._asked(spark, sf), "query_id").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return rerank.rerank(rows, 3, lambda query, text: F.lit(None).cast("double")).select("query_id", "method", "doc_id", "rank")


@query("SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 4) AS one FROM (SELECT vec_id, list_transform(embedding[1:16], lambda x: x::DOUBLE / (sqrt(list_sum(list_transform(embedding[1:16], lambda y: y::DOUBLE * y::DOUBLE))) + 1e-8)) AS v FROM embeddings)")
def truncated_vectors(spark, sf):
    """The first sixteen dimensions at unit length."""
    v = V.normalised(F.slice(V.doubles(F.col("embedding")), 1, 16))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x), 4).alias("one"))


@query("SELECT count(*) AS n, round(avg((doc_id % 2)::DOUBLE), 6) AS hit_rate, round(avg(CASE WHEN doc_id % 2 = 1 THEN 0.5 ELSE 0 END), 6) AS mrr FROM documents")
def measured_retrieval(spark, sf):
    """Hit rate and mean reciprocal rank where every odd query finds its document second."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "doc_id")
    hits = d.select("query_id", F.lit(2).alias("rank"), F.when(F.col("doc_id") % 2 == 1, F.col("doc_id")).otherwise(F.lit(-1)).alias("doc_id"))
    return evalset.retrieval(hits, d, 10).withColumnRenamed("n_queries", "n")
