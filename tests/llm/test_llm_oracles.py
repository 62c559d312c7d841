"""The llm queries with a SQL statement give the rows that DuckDB gives, and every query has one row for each row it must."""

import glob
import os

import duckdb
import pytest

registry = pytest.importorskip("lodestone.llm.registry")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    frame = registry.QUERIES[name](spark, SF)
    cols = sorted(frame.columns)
    got = con.execute(registry.ORACLES[name])
    names = [d[0] for d in got.description]
    rows = [dict(zip(names, r)) for r in got.fetchall()]
    assert sorted(names) == cols
    assert sorted(str([r[c] for c in cols]) for r in frame.collect()) == sorted(str([r[c] for c in cols]) for r in rows)


@pytest.mark.parametrize(("name", "columns"), [
    ("op1_bpe", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
    ("op4_quality_rules", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]),
    ("op5_mix_sources", ["doc_id", "size", "source_size", "target", "taken"]),
    ("op6_language_id", ["doc_id", "held_out", "lang_pred", "score"]),
    ("op7_simhash", ["doc_id", "fingerprint", "component_id"]),
    ("op8_pii", ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]),
    ("op10_repeated_substrings", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]),
])
def test_one_row_for_each_document(spark, name, columns):
    frame = registry.QUERIES[name](spark, SF)
    assert frame.columns[: len(columns)] == columns
    ids = sorted(r.doc_id for r in frame.select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
