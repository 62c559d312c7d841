"""Shapes of physical plans: pushdown, pruning, no nested loops, no Python where built-ins do."""

import pytest

from lodestone import catalog

SF = "/root/testdata/sf0.001"
#: Queries that run Python models, parsers or block comparisons on Arrow batches.
ARROW = {"chunk_recursive", "chunk_headers", "chunk_markdown", "answers", "embedded", "summaries", "knn_topk", "knn_filtered", "knn_postfilter", "knn_two_collections", "knn_in_all_cells", "dense_topk", "hybrid_fusion", "hybrid_fusion_v0", "hybrid_overlap", "rerank_details", "rerank_impact", "token_budget_cut", "claim_grounding", "grounding_summary", "grounding_gate", "funnel", "funnel_chunks", "knn_own_labels", "dense_own_chunks", "chunk_funnel", "indexed_topk", "index_recall", "reranked_yes_no", "parsed_pages"}
STREAMED = {"stream_hourly", "stream_sliding", "stream_sessions", "stream_fold", "stream_distinct", "stream_join", "stream_abandoned", "stream_requests"}


def plan(frame):
    frame.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "4000")
    return frame._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark):
    assert "EqualTo(vec_id,7)" in plan(catalog.QUERIES["point_lookup"](spark, SF))
    assert "PushedFilters: [In(event_type, [error,purchase])]" in plan(catalog.QUERIES["status_filter"](spark, SF))
    assert "GreaterThanOrEqual(l_shipdate" in plan(catalog.QUERIES["revenue_forecast"](spark, SF))


def test_columns_are_pruned(spark):
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(catalog.QUERIES["token_stats"](spark, SF))
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_shipdate:timestamp_ntz>" in plan(catalog.QUERIES["revenue_forecast"](spark, SF))


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(catalog.QUERIES["bm25_topk"](spark, SF))
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["eval_sample"](spark, SF))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - ARROW - STREAMED))
def test_no_pairs_and_no_python(spark, name):
    p = plan(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p and "NestedLoop" not in p
    assert "Python" not in p and "Pandas" not in p and "Arrow" not in p.replace("ArrowEval", "Arrow")


@pytest.mark.parametrize("name", ["funnel_chunks", "token_budget_cut", "claim_grounding"])
def test_selected_papers_are_sent_to_their_texts(spark, name, monkeypatch):
    """The texts are not gathered and sorted to meet the papers that were selected; a selection of many rows meets dealt texts and gives the same."""
    from lodestone.plans import retrieval

    f = spark.createDataFrame([(q, r, (7 * q + 3 * r) % 200) for q in range(40) for r in range(1, 9)], "query_id long, rank int, doc_id long")
    monkeypatch.setattr(retrieval, "_fused", lambda *_: f)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = retrieval.QUERIES[name](spark, SF)
        met = [x for x in plan(sent).splitlines() if "Join [doc_id" in x]
        assert met and all("BroadcastHashJoin" in x for x in met)
        rows = sorted(map(str, sent.collect()))
        monkeypatch.setattr(retrieval, "FEW_PAPERS", 0)
        dealt = retrieval.QUERIES[name](spark, SF)
        assert "BroadcastHashJoin [doc_id" not in plan(dealt) and "REPARTITION_BY_NUM" in plan(dealt)
        assert rows and sorted(map(str, dealt.collect())) == rows
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
