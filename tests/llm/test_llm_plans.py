"""The operators that must stay in the JVM do: their queries' plans, and those of the pipeline's native stages, hold no Python."""

import pytest

registry = pytest.importorskip("lodestone.llm.registry")
import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op2_license_scan", "op4_quality_rules", "op5_mix_sources", "op8_pii", "op9_chat_quotes", "op12_exact_dedup", "licence_tree", "chat_quotes_linked"])
def test_native_queries(spark, name):
    p = plan(registry.QUERIES[name](spark, SF))
    assert not any(x in p for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


@pytest.mark.parametrize("name", ["quality_rules", "pii", "mix_sources"])
def test_native_stages(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    p = plan(dict(corpus_pipeline.STAGES)[name](spark, docs, SF))
    assert not any(x in p for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
