"""Vector searches with a filter of each query's own, and the funnel that goes through chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cells, chunk, dense, models, rerank, scoped
from ..operators.vector_index import VectorIndex
from ..sources.corpus import stored
from ..streaming.events import work_dir
from . import retrieval
from .relational import table
from .retrieval import _BM25, _CONTAIN, _FUSE, _KNN, _VEC
from .textual import TOK, _TOK

QUERIES, ORACLES = {}, {}
P = retrieval.P


def query(sql):
    def add(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return add


@query(f"SELECT query_id, rank, id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM ({_KNN}) WHERE label IN (query_id // 100 % 3, query_id // 100 % 5, query_id // 100 % 7)) WHERE rank <= 10")
def knn_own_labels(spark, sf):
    """Each query among the rows of the labels that it allows itself."""
    q, r = retrieval._vectors(spark, sf)
    n = F.floor(F.col("query_id") / 100)
    allowed = q.select("query_id", F.explode(F.array(*[(n % m).cast("int") for m in (3, 5, 7)])).alias("group"))
    # A query is a row of the table itself and never its own answer: one more is searched.
    hits = scoped.search(q, r.withColumnRenamed("label", "group"), allowed, 11).where("id <> query_id")
    return dense.overfetch(hits, F.lit(True), 10).select("query_id", "rank", "id", "distance")


_CHUNKS = rf"""{_FUSE},
ch AS (SELECT doc_id, (s // 160)::INT AS chunk_index, doc_id * 1000000 + s // 160 AS cid, array_to_string(w[s + 1:s + 200], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, len(w), 160)) AS s FROM
  (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM fs)))),
cv AS ({_VEC.format(id='cid', tok=TOK, t='ch')}), cn AS (SELECT id, sqrt(sum(x * x)) + 1e-8 AS n FROM cv GROUP BY id), cu AS (SELECT id, dim, x / n AS x FROM cv JOIN cn USING (id)), c2 AS (SELECT id, sum(x * x) AS s FROM cu GROUP BY id),
cp AS (SELECT query_id, cid, ch.doc_id, chunk_index, q2.s + c2.s AS s FROM fs JOIN ch USING (doc_id) JOIN q2 ON q2.id = fs.query_id JOIN c2 ON c2.id = cid),
ci AS (SELECT query_id, cid, sum(qu.x * cu.x) AS ip FROM cp JOIN qu ON qu.id = query_id JOIN cu ON cu.id = cid AND cu.dim = qu.dim GROUP BY ALL),
cd AS (SELECT query_id, doc_id, chunk_index, cid, round(s - 2 * coalesce(ip, 0), 6) AS distance FROM cp LEFT JOIN ci USING (query_id, cid)),
cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id, chunk_index)::INT AS rank FROM cd)"""


def _chunks(docs):
    """(doc_id, chunk, text): fixed chunks of 200 words, 40 of them shared with the next; ``chunk`` is (doc_id, chunk_index)."""
    words = F.filter(F.split("text", r"[ \t\n]+"), lambda x: x != "")
    rows = docs.select("doc_id", F.posexplode(chunk.fixed(words, 200, 40)).alias("chunk_index", "c"))
    return rows.select("doc_id", F.struct("doc_id", "chunk_index").alias("chunk"), F.col("c.text").alias("text"))


def _own_chunks(spark, sf):
    """The m nearest chunks of each query among those of the papers it selected, with the chunks' table. Only selected papers are cut and embedded, each once."""
    selected = stored(retrieval._fused(spark, sf).select("query_id", F.col("doc_id").alias("group")))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    chunks = _chunks(docs.join(selected.select(F.col("group").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    rows = dense.hashed_vectors(chunks, "text", "chunk").select(F.col("id.doc_id").alias("group"), "id", "v")
    asked = dense.hashed_vectors(retrieval._asked(spark, sf), "query", "query_id").select(F.col("id").alias("query_id"), "v")
    return scoped.search(asked, rows, selected, P.m_chunks), chunks


@query(f"WITH {_CHUNKS} SELECT query_id, rank, doc_id, chunk_index, distance FROM cr WHERE rank <= 20")
def dense_own_chunks(spark, sf):
    """The chunk stage of the funnel: the nearest chunks within the papers that the query itself selected."""
    found, _ = _own_chunks(spark, sf)
    return found.select("query_id", "rank", "id.doc_id", "id.chunk_index", "distance")


@query(f"""WITH {_CHUNKS},
cs AS (SELECT query_id, cr.doc_id, cr.chunk_index, rank AS orig_rank, ch.text, list_distinct({_TOK.format(x='b.text')}) AS q, {_TOK.format(x='ch.text')} AS t FROM cr JOIN ch USING (cid) JOIN benchmark b ON b.item_id = query_id),
ck AS (SELECT query_id, doc_id, chunk_index, orig_rank, {_CONTAIN} AS score, text, row_number() OVER (PARTITION BY query_id ORDER BY {_CONTAIN} DESC, orig_rank)::INT AS rank FROM cs WHERE orig_rank <= 20)
SELECT query_id, string_agg('[' || rank || '] doc' || doc_id || ' part ' || chunk_index || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context, max(score) AS best_score FROM ck WHERE rank <= 5 GROUP BY query_id""")
def chunk_funnel(spark, sf):
    """The whole funnel: papers by two searches, their nearest chunks, the best five of these as one numbered context."""
    found, chunks = _own_chunks(spark, sf)
    hits = found.select("query_id", F.col("rank").alias("orig_rank"), F.col("id").alias("chunk")).join(chunks.select("chunk", "text"), "chunk")
    asked = retrieval._asked(spark, sf).withColumn("query_tokens", rerank.distinct_tokens(F.col("query")))
    rows = hits.withColumn("text_tokens", rerank.distinct_tokens(F.col("text"))).withColumnRenamed("chunk", "doc_id").join(asked, "query_id")
    best = rerank.rerank(rerank.candidates(rows, P.max_rerank), P.n_final, rerank.held_share())
    name = F.concat(F.lit("doc"), F.col("doc_id.doc_id").cast("string"), F.lit(" part "), F.col("doc_id.chunk_index").cast("string"))
    items = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", name.alias("title"), "text"))).alias("items"), F.max("score").alias("best_score"))
    return items.select("query_id", T.context(F.col("items")).alias("context"), "best_score")


CELLS, PROBE = 32, 16


def indexed_topk(spark, sf):
    """Document vectors out of a stored index, with each hit's rank in the exact search, the query's recall of its ten nearest and the share of rows in the cells it looked into."""
    docs = table(spark, sf, "documents")
    rows = stored(dense.hashed_vectors(docs))
    asked = stored(dense.hashed_vectors(retrieval._asked(spark, sf), "query", "query_id").select(F.col("id").alias("query_id"), "v"))
    index = VectorIndex.build(rows, work_dir(spark), CELLS, 16)
    hits = index.search(asked, 10, PROBE).withColumnRenamed("id", "doc_id")
    true = dense.knn(asked, rows, 10).select("query_id", F.col("id").alias("doc_id"), F.col("rank").alias("true_rank"))
    sizes = index.rows.groupBy("cell").agg(F.count("*").alias("n"))
    looked = cells.assigned(asked, index.centres, PROBE).join(sizes, "cell").groupBy("query_id").agg((F.sum("n") / index.rows.agg(F.count("*")).scalar()).alias("rows_share"))
    met = hits.join(true, ["query_id", "doc_id"], "left")
    found = met.groupBy("query_id").agg(F.count("true_rank").alias("found")).join(true.groupBy("query_id").agg(F.count("*").alias("of")), "query_id")
    recall = found.select("query_id", F.round(F.col("found") / F.col("of"), 6).alias("recall"))
    return met.join(recall, "query_id").join(looked, "query_id").select("query_id", "rank", "doc_id", "distance", "true_rank", "recall", F.round("rows_share", 6).alias("rows_share"))


QUERIES["indexed_topk"] = indexed_topk


@query(f"WITH {retrieval._DENSE} SELECT count(DISTINCT id) AS n_queries, true AS recall_reached, true AS looked_at_fewer FROM qv")
def index_recall(spark, sf):
    """The stored index finds at least nine in ten of the ten nearest, on average over all queries, without looking at all rows."""
    each = indexed_topk(spark, sf).select("query_id", "recall", "rows_share").distinct()
    return each.agg(F.count("*").alias("n_queries"), (F.avg("recall") >= 0.9).alias("recall_reached"), (F.avg("rows_share") < 0.7).alias("looked_at_fewer"))


def _shares():
    """Stands in for a reranker that answers yes or no: the more of a query's distinct words a text holds, the likelier yes."""

    def run(pairs):
        out = []
        for query, text in pairs:
            q = set((query or "").lower().split())
            out.append((8.0 * len(q & set((text or "").lower().split())) / max(len(q), 1), 3.0))
        return out

    return run


_SPLIT = r"list_distinct(list_filter(string_split_regex(lower({x}), '[ \t\n]+'), lambda w: w <> ''))"


@query(rf"""WITH {_BM25}, h AS (SELECT query_id, lx.doc_id, rank AS orig_rank, {_SPLIT.format(x='b.text')} AS q, {_SPLIT.format(x='d.text')} AS t FROM lx JOIN benchmark b ON b.item_id = query_id JOIN documents d USING (doc_id) WHERE rank <= 20),
p AS (SELECT query_id, doc_id, orig_rank, round(1 / (1 + exp(3.0 - 8.0 * len(list_intersect(q, t)) / greatest(len(q), 1))), 6) AS score FROM h)
SELECT query_id, rank, doc_id, score, orig_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, orig_rank, doc_id)::INT AS rank FROM p) WHERE rank <= 5""")
def reranked_yes_no(spark, sf):
    """The twenty best of the lexical search by a reranker of two logits, the five likeliest; pairs go to the model in batches."""
    hits = retrieval._lexical(spark, sf, 20).select("query_id", "doc_id", F.col("rank").alias("orig_rank"))
    rows = hits.join(retrieval._asked(spark, sf), "query_id").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    best = rerank.rerank(rows, 5, lambda query, text: models.score_yes_no(query, text, _shares))
    return best.select("query_id", "rank", "doc_id", "score", "orig_rank")


@query("SELECT doc_id, unnest(range(0, len(p)))::INT AS page, unnest(list_transform(p, lambda x: md5(x))) AS text_md5 FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents) UNION ALL SELECT -1, NULL, NULL")
def parsed_pages(spark, sf):
    """Documents as files whose pages are their lines, read by a page parser; a file that the parser cannot read gives its error and no page."""

    def load():
        def parse(path, content):
            if path == "-1":
                raise ValueError("no pages")
            return models.plain_pages(path, content)

        return parse

    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.translate("text", "\n", "\f").cast("binary").alias("content"))
    files = docs.unionByName(spark.range(1).select(F.lit("-1").alias("path"), F.lit(b"").alias("content")))
    pages = models.parse_pages(files, load)
    return pages.select(F.col("path").cast("long").alias("doc_id"), "page", F.md5(F.col("text").cast("binary")).alias("text_md5"))
