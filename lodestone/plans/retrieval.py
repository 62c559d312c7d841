"""The retrieval funnel and its parts, for all queries of the query table at once.

``benchmark`` is the query set. Dense document vectors are hashed features, a
deterministic stand-in for an embedding model; ``embeddings`` serves the pure
vector searches, whose query set is every vec_id divisible by 100.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import bm25, cells, dense, fusion, rerank, verify
from ..operators import evalset as E
from ..sources.corpus import Params, stored
from .relational import table
from .textual import TOK, _TOK

QUERIES, ORACLES = {}, {}
P = Params()


def query(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


_held: dict = {}


def _counts(spark, sf):
    """The term counts of the documents, kept (memory, then disk) for all parts of a plan and for later queries on the same input; those of the input
    before are given up, so one is kept at most. For a standing index use Index.write and Index.read."""
    key = (id(spark._jsparkSession), spark.sparkContext.applicationId, sf)
    if key not in _held:
        for old in _held.values():
            try:
                old.unpersist()
            except Exception:  # its session has ended, and its memory with it
                pass
        _held.clear()
        _held[key] = bm25.term_counts(table(spark, sf, "documents")).persist()
    return _held[key]


def _index(spark, sf):
    _counts(spark, sf)
    return bm25.build(table(spark, sf, "documents"), markdown=False)


def _asked(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _lexical(spark, sf, k):
    return bm25.search(_index(spark, sf), bm25.query_terms(_asked(spark, sf), "query"), k)


def _dense(spark, sf, k):
    docs = table(spark, sf, "documents")
    _counts(spark, sf)
    rows = dense.hashed_vectors(docs)
    sizes = (_asked(spark, sf).count(), docs.count())
    asked = dense.hashed_vectors(_asked(spark, sf), "query", "query_id").select(F.col("id").alias("query_id"), "v")
    return dense.knn(asked, rows, k, sizes=sizes).select("query_id", "rank", F.col("id").alias("doc_id"), "distance")


_BM25 = f"""
tok AS (SELECT doc_id, {TOK} AS t FROM documents),
dl AS (SELECT doc_id, len(t) AS dl FROM tok), cor AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
post AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM post GROUP BY term), cor),
trm AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(({_TOK.format(x='substring(trim(text), 1, 1000)')})[1:100]) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN trm USING (term) JOIN post USING (term) JOIN dl USING (doc_id), cor GROUP BY query_id, doc_id),
lx AS (SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM sc))"""
_VEC = """SELECT {id} AS id, dim, sum(s) AS x FROM (SELECT {id}, ('0x' || substring(md5(term), 1, 4))::BIGINT % 64 AS dim, CASE WHEN ('0x' || substring(md5(term), 5, 1))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END AS s FROM (SELECT {id}, unnest({tok}) AS term FROM {t})) GROUP BY {id}, dim"""
_DENSE = f"""
dv AS ({_VEC.format(id='doc_id', tok=TOK, t='documents')}), qv AS ({_VEC.format(id='item_id', tok=TOK, t='benchmark')}),
dn AS (SELECT id, sqrt(sum(x * x)) + 1e-8 AS n FROM dv GROUP BY id), qn AS (SELECT id, sqrt(sum(x * x)) + 1e-8 AS n FROM qv GROUP BY id),
du AS (SELECT id, dim, x / n AS x FROM dv JOIN dn USING (id)), qu AS (SELECT id, dim, x / n AS x FROM qv JOIN qn USING (id)),
d2 AS (SELECT id, sum(x * x) AS s FROM du GROUP BY id), q2 AS (SELECT id, sum(x * x) AS s FROM qu GROUP BY id),
ip AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.x * d.x) AS ip FROM qu q JOIN du d USING (dim) GROUP BY q.id, d.id),
ds AS (SELECT q2.id AS query_id, d2.id AS doc_id, round(q2.s + d2.s - 2 * coalesce(ip, 0), 6) AS distance FROM q2 CROSS JOIN d2 LEFT JOIN ip ON ip.query_id = q2.id AND ip.doc_id = d2.id),
de AS (SELECT query_id, doc_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id)::INT AS rank FROM ds)"""


@query(f"WITH {_BM25} SELECT * FROM lx WHERE rank <= 10")
def bm25_topk(spark, sf):
    return _lexical(spark, sf, 10)


@query(f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM trm")
def bm25_terms(spark, sf):
    return _index(spark, sf).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BM25} SELECT (SELECT n FROM cor) AS n_docs, round((SELECT avgdl FROM cor), 6) AS avgdl, (SELECT count(*) FROM trm) AS n_terms, (SELECT count(*) FROM post) AS n_postings")
def bm25_corpus(spark, sf):
    i = _index(spark, sf)
    n_terms, n_postings = (x.agg(F.count("*")).scalar() for x in (i.terms, i.postings))
    return i.corpus.select(F.col("n").alias("n_docs"), F.round("avgdl", 6).alias("avgdl"), n_terms.alias("n_terms"), n_postings.alias("n_postings"))


_KNN = """SELECT q.vec_id AS query_id, r.vec_id AS id, r.label, round(list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 6) AS distance
FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id"""


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"), "label")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "v"), e.select(F.col("vec_id").alias("id"), "v", "label")


@query(f"SELECT query_id, rank, id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM ({_KNN})) WHERE rank <= 20")
def knn_topk(spark, sf):
    q, r = _vectors(spark, sf)
    return dense.knn(q, r, 20, distinct_from_self=True)


@query(f"SELECT query_id, rank, id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM ({_KNN}) WHERE label IN (1, 3, 5)) WHERE rank <= 10")
def knn_filtered(spark, sf):
    q, r = _vectors(spark, sf)
    return dense.knn(q, dense.within(r, "label", {1, 3, 5}), 10, distinct_from_self=True)


@query(f"SELECT query_id, rank, id, distance FROM (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY r)::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS r FROM ({_KNN})) WHERE r <= 100 AND label IN (1, 3, 5)) WHERE rank <= 10")
def knn_postfilter(spark, sf):
    q, r = _vectors(spark, sf)
    hits = dense.knn(q, r, 100, distinct_from_self=True).join(r.select("id", "label"), "id")
    return dense.overfetch(hits, F.col("label").isin(1, 3, 5), 10).select("query_id", "rank", "id", "distance")


@query(f"SELECT query_id, (1 + query_id // 100 % 2)::INT AS collection, rank, id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM ({_KNN}) WHERE label % 2 = query_id // 100 % 2) WHERE rank <= 10")
def knn_two_collections(spark, sf):
    """Two collections by the label; every query names the one it searches."""
    q, r = _vectors(spark, sf)
    named = (1 + F.floor(F.col("query_id") / 100) % 2).cast("int")
    return dense.knn_in_collections(q.withColumn("query", F.lit("?")).withColumn("collection", named), r.withColumn("collection", 1 + F.col("label") % 2), 10, distinct_from_self=True)


@query(ORACLES["knn_topk"])
def knn_in_all_cells(spark, sf):
    """The search by cells, looking into all of them: the exact answer, which a smaller ``probe`` comes near to."""
    q, r = _vectors(spark, sf)
    at = cells.fit(r, 8)
    return cells.search(q, cells.assigned(r.select("id", "v"), at), at, 20, 8, distinct_from_self=True)


@query("SELECT label, count(*) AS n, max(len(embedding))::BIGINT AS dim FROM embeddings GROUP BY label")
def collection_stats(spark, sf):
    return dense.collection_stats(table(spark, sf, "embeddings"), "label", "embedding")


@query("SELECT vec_id, label, len(embedding)::BIGINT AS dim FROM embeddings WHERE vec_id = 7")
def point_lookup(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id = 7").select("vec_id", "label", F.size("embedding").cast("long").alias("dim"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding[1:32], lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm32 FROM embeddings")
def truncated_norms(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(V.norm(F.slice("embedding", 1, 32)), 6).alias("norm32"))


@query(f"WITH {_DENSE} SELECT query_id, rank, doc_id, distance FROM de WHERE rank <= 10")
def dense_topk(spark, sf):
    return _dense(spark, sf, 10)


_FUSE = f"""{_BM25}, {_DENSE},
l AS (SELECT query_id, doc_id, 0.3 * (1 - (rank - 1) / count(*) OVER (PARTITION BY query_id)) AS s, rank FROM lx WHERE rank <= 60),
d AS (SELECT query_id, doc_id, 0.7 * (1 - (rank - 1) / count(*) OVER (PARTITION BY query_id)) AS s, rank FROM de WHERE rank <= 60),
fu AS (SELECT coalesce(l.query_id, d.query_id) AS query_id, coalesce(l.doc_id, d.doc_id) AS doc_id, round(coalesce(l.s, 0) + coalesce(d.s, 0), 6) AS score, l.rank AS lexical_rank, d.rank AS dense_rank FROM l FULL OUTER JOIN d ON l.query_id = d.query_id AND l.doc_id = d.doc_id),
fs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lexical_rank NULLS LAST, dense_rank NULLS LAST, doc_id)::INT AS rank FROM fu) WHERE rank <= 30)"""


def _fused(spark, sf):
    return fusion.fuse(_lexical(spark, sf, 2 * P.k_papers), _dense(spark, sf, 2 * P.k_papers), P.k_papers, (P.lexical_weight, P.dense_weight))


@query(f"WITH {_FUSE} SELECT query_id, rank, doc_id, score, lexical_rank, dense_rank FROM fs")
def hybrid_fusion(spark, sf):
    return _fused(spark, sf)


@query(f"""WITH {_BM25}, {_DENSE},
l AS (SELECT query_id, doc_id, 0.3 * (60 - (rank - 1)) / 60 AS s, rank FROM lx WHERE rank <= 60), d AS (SELECT query_id, doc_id, 0.7 * (60 - (rank - 1)) / 60 AS s, rank FROM de WHERE rank <= 60),
fu AS (SELECT coalesce(l.query_id, d.query_id) AS query_id, coalesce(l.doc_id, d.doc_id) AS doc_id, round(coalesce(l.s, 0) + coalesce(d.s, 0), 6) AS score, l.rank AS lexical_rank, d.rank AS dense_rank FROM l FULL OUTER JOIN d ON l.query_id = d.query_id AND l.doc_id = d.doc_id)
SELECT query_id, rank, doc_id, score, lexical_rank, dense_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lexical_rank NULLS LAST, dense_rank NULLS LAST, doc_id)::INT AS rank FROM fu) WHERE rank <= 30""")
def hybrid_fusion_v0(spark, sf):
    return fusion.fuse_by_position(_lexical(spark, sf, 60), _dense(spark, sf, 60), 30)


@query(f"""WITH {_FUSE} SELECT fu.query_id, count(*) FILTER (WHERE fu.dense_rank IS NULL) AS lexical_only, count(*) FILTER (WHERE fu.lexical_rank IS NULL) AS dense_only, count(*) FILTER (WHERE fu.lexical_rank IS NOT NULL AND fu.dense_rank IS NOT NULL) AS "both",
count(*) FILTER (WHERE fs.doc_id IS NOT NULL AND fu.dense_rank IS NULL) AS selected_lexical_only, count(*) FILTER (WHERE fs.doc_id IS NOT NULL AND fu.lexical_rank IS NULL) AS selected_dense_only,
count(*) FILTER (WHERE fs.doc_id IS NOT NULL AND fu.lexical_rank IS NOT NULL AND fu.dense_rank IS NOT NULL) AS selected_both
FROM fu LEFT JOIN fs ON fu.query_id = fs.query_id AND fu.doc_id = fs.doc_id GROUP BY fu.query_id""")
def hybrid_overlap(spark, sf):
    lexical, dn = _lexical(spark, sf, 60), _dense(spark, sf, 60)
    return fusion.overlap(lexical, dn, fusion.fuse(lexical, dn, 30))


#: Rows (query, paper) that are few enough to be sent to all tasks, some ten MB with a query's tokens in each, and papers whose texts one task works on.
FEW_PAPERS, PAPER_BLOCK = 1 << 16, 1 << 10


def _with_texts(spark, sf, wanted, each):
    """wanted(doc_id, ..), of at most ``each`` rows a query, with the texts. A selection of few rows is sent to the texts, and only those it names are
    dealt on; for a larger one the texts are dealt. So no task gathers or sorts more texts as there are more documents."""
    docs, n = table(spark, sf, "documents").select("doc_id", "text"), _asked(spark, sf).count() * each
    if n <= FEW_PAPERS:
        return bm25.dealt(docs.join(F.broadcast(wanted), "doc_id"), n, PAPER_BLOCK, "doc_id")
    return bm25.dealt(docs, docs.count(), bm25.DOC_BLOCK, "doc_id").join(wanted, "doc_id")


def _candidates(spark, sf):
    """The papers each query selected, as rerank candidates with their texts."""
    f = _fused(spark, sf).select("query_id", F.col("rank").alias("orig_rank"), "doc_id")
    # A paper meets the queries that selected it, at most the query set, as one row, so it is tokenised once and the selection is made once.
    wanted = f.groupBy("doc_id").agg(F.collect_list(F.struct("query_id", "orig_rank")).alias("queries"))
    docs = _with_texts(spark, sf, wanted, P.k_papers)
    pairs = docs.withColumn("text_tokens", rerank.distinct_tokens(F.col("text"))).select("doc_id", "text", "text_tokens", F.inline("queries"))
    asked = _asked(spark, sf).withColumn("query_tokens", rerank.distinct_tokens(F.col("query")))
    return pairs.join(asked, "query_id")


_CONTAIN = "round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, t)) / len(q) END, 6)"
_RERANK = f"""{_FUSE},
ca AS (SELECT query_id, rank AS orig_rank, doc_id, list_distinct({_TOK.format(x='b.text')}) AS q, {_TOK.format(x='d.text')} AS t, d.text FROM fs JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = fs.query_id),
rs AS (SELECT query_id, doc_id, orig_rank, {_CONTAIN} AS score, text FROM ca),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, orig_rank, doc_id)::INT AS rank FROM rs)"""


@query(f"WITH {_RERANK} SELECT query_id, rank, doc_id, score, orig_rank, (orig_rank - rank)::INT AS rank_improvement, 'scored' AS method FROM rr WHERE rank <= 5")
def rerank_details(spark, sf):
    r = rerank.rerank(rerank.candidates(_candidates(spark, sf), P.max_rerank), P.n_final, rerank.held_share())
    return r.select("query_id", "rank", "doc_id", "score", "orig_rank", "rank_improvement", "method")


@query(f"""WITH {_RERANK} SELECT query_id, round(avg(orig_rank - rank), 6) AS avg_change, max(orig_rank - rank)::INT AS max_change, min(orig_rank - rank)::INT AS min_change, count(*) FILTER (WHERE orig_rank > rank) AS improved,
count(*) FILTER (WHERE orig_rank < rank) AS degraded, count(*) FILTER (WHERE orig_rank = rank) AS unchanged, round(max(score) - min(score), 6) AS score_spread FROM rr WHERE rank <= 20 GROUP BY query_id""")
def rerank_impact(spark, sf):
    return rerank.impact(rerank.rerank(rerank.candidates(_candidates(spark, sf)), 20, rerank.held_share()))


@query(f"WITH {_FUSE} SELECT query_id, orig_rank, doc_id FROM (SELECT query_id, rank AS orig_rank, doc_id, sum(length(text) / 4.0) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS t FROM fs JOIN documents USING (doc_id) WHERE text <> '') WHERE t <= 8000")
def token_budget_cut(spark, sf):
    return rerank.candidates(_candidates(spark, sf), 100, 8000.0).select("query_id", "orig_rank", "doc_id")


_PIECES = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_VERIFY = f"""{_FUSE},
an AS (SELECT query_id AS answer_id, text AS answer FROM fs JOIN documents USING (doc_id) WHERE rank = 1),
cl AS (SELECT answer_id, (i - 1)::INT AS claim_idx, claim FROM (SELECT answer_id, unnest(c) AS claim, generate_subscripts(c, 1) AS i FROM (SELECT answer_id, list_filter(list_transform(c0, lambda z: z.x), lambda x: true) AS c FROM (
   SELECT answer_id, list_filter(list_transform(c1, lambda x, i: {{'x': x, 'i': i, 'f': list_position(c1, x)}}), lambda z: z.i = z.f) AS c0 FROM (
   SELECT answer_id, list_filter(list_transform({_PIECES.replace('text', 'answer', 1)}, lambda x: trim(x)), lambda x: length(x) > 20) AS c1 FROM an))))),
dc AS (SELECT query_id AS answer_id, rank - 1 AS doc_idx, {_TOK.format(x='text')} AS t FROM fs JOIN documents USING (doc_id) WHERE rank BETWEEN 2 AND 6),
pr AS (SELECT answer_id, claim_idx, claim, doc_idx, round(CASE WHEN len(q) = 0 THEN 0 ELSE coalesce(len(list_intersect(q, t)) / len(q), 0) END, 6) AS s FROM (SELECT *, list_distinct({_TOK.format(x='claim')}) AS q FROM cl) LEFT JOIN dc USING (answer_id)),
ve AS (SELECT answer_id, claim_idx, claim, max(s) AS max_score, coalesce(string_agg(doc_idx, ',' ORDER BY doc_idx) FILTER (WHERE s >= 0.5), '') AS supporting, max(s) >= 0.5 AS is_grounded FROM pr GROUP BY ALL)"""


def _verified(spark, sf):
    """The best paper as the answer, checked against the next five: an extractive stand-in for a generator. Six papers of a query meet in a row."""
    f = _with_texts(spark, sf, _fused(spark, sf).where("rank <= 6"), 6)
    rows = f.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("p"))
    docs = F.transform(F.filter("p", lambda x: x["rank"] > 1), lambda x: F.struct((x["rank"] - 1).alias("doc_idx"), x["text"].alias("text")))
    answers = rows.select(F.col("query_id").alias("answer_id"), F.get(F.filter("p", lambda x: x["rank"] == 1), F.lit(0))["text"].alias("answer"), docs.alias("docs"))
    return verify.verify_rows(answers, P.grounded)


@query(f"WITH {_VERIFY} SELECT answer_id, claim_idx, max_score, supporting, is_grounded FROM ve")
def claim_grounding(spark, sf):
    v = _verified(spark, sf).where("claim_idx is not null")
    return v.select("answer_id", "claim_idx", "max_score", F.array_join("supporting", ",").alias("supporting"), "is_grounded")


@query(f"WITH {_VERIFY} SELECT an.answer_id, count(claim_idx) AS n_claims, count(*) FILTER (WHERE is_grounded) AS n_grounded, CASE WHEN count(claim_idx) = 0 THEN 1.0 ELSE round(count(*) FILTER (WHERE is_grounded) / count(claim_idx), 6) END AS grounding_ratio FROM an LEFT JOIN ve ON an.answer_id = ve.answer_id GROUP BY an.answer_id")
def grounding_summary(spark, sf):
    return verify.summary(None, _verified(spark, sf)).drop("unsupported")


@query(f"WITH {_VERIFY} SELECT an.answer_id, coalesce(avg(is_grounded::INT), 1) >= 0.7 AS passes FROM an LEFT JOIN ve ON an.answer_id = ve.answer_id GROUP BY an.answer_id")
def grounding_gate(spark, sf):
    return verify.passes(verify.summary(None, _verified(spark, sf)))


@query(f"WITH {_BM25}, tr AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) SELECT count(*) AS n_queries, round(avg(CASE WHEN r IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(coalesce(1 / r, 0)), 6) AS mrr FROM (SELECT t.query_id, min(lx.rank) AS r FROM tr t LEFT JOIN lx ON lx.query_id = t.query_id AND lx.doc_id = t.doc_id AND lx.rank <= 10 GROUP BY t.query_id)")
def retrieval_hit_rate(spark, sf):
    """Truth: the documents that hold a passage word for word. A passage's inner words, six at most, are met by hash with the windows of as many words
    of the documents; one of two words and fewer has none and is met by its characters. Only windows whose slot in a bitmap of the passages' hashes is
    set become rows (128 KB, whatever the passages). Then the whole passage is checked."""
    n, slots = 6, 1 << 20
    words = lambda c: F.split(F.trim(c), r"\s+")
    joined = lambda parts, at, k, sep: F.xxhash64(F.lit(sep), k, F.array_join(F.slice(parts, at, k), sep))
    b = table(spark, sf, "benchmark").where("text <> ''").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"), words(F.col("text")).alias("w"))
    b = b.withColumn("k", F.least(F.lit(n), F.size("w") - 2)).withColumn("chars", F.split("passage", ""))
    long, short = F.col("k") > 0, F.col("k") <= 0
    lead = b.select("query_id", "passage", F.when(long, joined(F.col("w"), F.lit(2), F.col("k"), " ")).otherwise(joined(F.col("chars"), F.lit(1), F.size("chars"), "")).alias("h"))
    slot = lead.select(F.pmod("h", F.lit(slots)).alias("s"))
    marks = slot.groupBy(F.shiftright("s", 6).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("bits"))
    # At most slots / 64 numbers: the words of the bitmap, those without a passage left out, in one map of places.
    table_ = marks.agg(F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("m")).select(F.expr(f"transform(sequence(0, {slots // 64 - 1}), i -> coalesce(m[i], 0L))").alias("t")).scalar()
    docs = table(spark, sf, "documents").select("doc_id", "text")
    # The lengths in use: six of words at most, and those of passages of one or two words.
    used, lengths = b.where(long).agg(F.collect_set("k")).scalar(), b.where(short).agg(F.collect_set(F.size("chars"))).scalar()
    held = docs.select("doc_id", words(F.col("text")).alias("w"), F.when(F.size(lengths) > 0, F.split("text", "")).otherwise(F.array().cast("array<string>")).alias("c"), used.alias("used"), lengths.alias("lengths"), table_.alias("table"))
    windows = lambda of, parts, sep: F.flatten(F.transform(of, lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - k + 1)), lambda i: joined(F.col(parts), i, k, sep))))
    found = held.select("doc_id", "table", F.concat(windows("used", "w", " "), windows("lengths", "c", "")).alias("h"))
    marked = F.expr(f"filter(array_distinct(h), x -> getbit(table[cast(pmod(x, {slots}) div 64 as int)], cast(pmod(x, {slots}) % 64 as int)) = 1)")
    met = found.select("doc_id", F.explode(marked).alias("h")).join(lead, "h").select("doc_id", "query_id", "passage")
    # Some rows a passage, written once: each use of them would make the windows of all documents anew.
    truth = stored(met.join(docs, "doc_id").where(F.contains("text", F.col("passage"))).select("query_id", "doc_id").distinct())
    return E.retrieval(_lexical(spark, sf, 10), truth, 10)


@query(f"""WITH {_RERANK} SELECT query_id, string_agg('[' || rank || '] doc' || doc_id || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context, max(score) AS best_score FROM rr WHERE rank <= 5 GROUP BY query_id""")
def funnel(spark, sf):
    """Query to context: two searches, fusion, reranking, the five best papers, whole, as one numbered context."""
    r = rerank.rerank(rerank.candidates(_candidates(spark, sf), P.max_rerank), P.n_final, rerank.held_share())
    items = r.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("title"), "text"))).alias("items"), F.max("score").alias("best_score"))
    return items.select("query_id", T.context(F.col("items")).alias("context"), "best_score")


@query(f"""WITH {_FUSE}, ch AS (SELECT doc_id, (s // 160)::INT AS chunk_index, array_to_string(w[s + 1:s + 200], ' ') AS chunk FROM (SELECT doc_id, w, unnest(range(0, len(w), 160)) AS s FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n]+'), lambda x: x <> '') AS w FROM documents))),
sc2 AS (SELECT query_id, doc_id, chunk_index, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, t)) / len(q) END, 6) AS score FROM (SELECT fs.query_id, ch.doc_id, chunk_index, list_distinct({_TOK.format(x='b.text')}) AS q, {_TOK.format(x='chunk')} AS t FROM fs JOIN ch USING (doc_id) JOIN benchmark b ON b.item_id = fs.query_id))
SELECT query_id, rank, doc_id, chunk_index, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index)::INT AS rank FROM sc2) WHERE rank <= 20""")
def funnel_chunks(spark, sf):
    """The best chunks within the papers each query selected."""
    from ..operators import chunk as C

    selected = _fused(spark, sf).select("query_id", "doc_id")
    asked = _asked(spark, sf).select("query_id", rerank.distinct_tokens(F.col("query")).alias("query_tokens"))
    wanted = selected.join(asked, "query_id").groupBy("doc_id").agg(F.collect_list(F.struct("query_id", "query_tokens")).alias("queries"))
    # One plan selects the papers: each is cut and tokenised once and meets the queries that selected it, at most the query set.
    words = _with_texts(spark, sf, wanted, P.k_papers).select("doc_id", "queries", F.filter(F.split("text", r"[ \t\n]+"), lambda x: x != "").alias("w"))
    chunks = words.select("doc_id", "queries", F.posexplode(C.fixed(F.col("w"), 200, 40)).alias("chunk_index", "c"))
    pairs = chunks.select("doc_id", "chunk_index", rerank.distinct_tokens(F.col("c.text")).alias("text_tokens"), "queries").select("doc_id", "chunk_index", "text_tokens", F.inline("queries"))
    scored = pairs.withColumn("score", F.round(rerank.held_share()(F.lit(None), F.lit(None)), 6))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "chunk_index")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= P.m_chunks).select("query_id", "rank", "doc_id", "chunk_index", "score")
