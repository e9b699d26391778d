"""The registered queries: their columns, their SQL, and the pipeline against plain versions."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute

import corpus_pipeline
from coastline.llm import langid, pii, registry

COLUMNS = {
    "op1": "doc_id size source_size target taken", "op2": "doc_id n_shingles component_id kept", "op3": "doc_id n_bytes n_tokens over_limit", "op4": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op6": "doc_id n_words n_hit n_items items_sha256 contaminated", "op7": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op8": "page_id url text n_chars", "op9": "doc_id held_out lang_pred score",
    "op11": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256", "op12": "doc_id n_lines n_dropped kept_sha256",
    "op13": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_contract(spark, data, name):
    df = registry.queries()[name](spark, data)
    assert set(COLUMNS.get(name.split("_")[0], "doc_id").split()) <= set(df.columns)
    if name.startswith(("op5", "op11")):
        return
    assert df.count() == spark.read.parquet(f"{data}/{'pages' if name.startswith('op8') else 'documents'}.parquet").count()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = registry.queries()[name](spark, data)
    want = con.sql(registry.oracle_sql()[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)


def test_pipeline_against_plain_versions(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    roots = brute.near_components(rows)
    kept = {i for i, r in roots.items() if i == r}
    mostly = {i for i, t in rows if i in kept and (lambda n, h, _: h > 0.5 * n)(*brute.leaks(t, bench))}
    got = corpus_pipeline.run(spark, data)
    assert set(got.columns) == {*corpus_pipeline.COLUMNS, "copy"}
    out = got.select("doc_id", "text", "copy").collect()
    assert {r.doc_id for r in out} <= kept - mostly
    assert max(r.copy for r in out) <= 2 and len({(r.doc_id, r.copy) for r in out}) == len(out)
    assert all(not brute.pii(r.text) and brute.leaks(r.text, bench)[1] == 0 for r in out)


def test_stages_keep_clean_documents_and_columns(spark, data):
    clean = spark.createDataFrame([(i, f"The quick brown fox number{i} jumps over dog{i} and cat{i} while it rains on roof{i}.", "en", "s", 1) for i in range(20)] + [(99, "?!", "en", "s", 2), (98, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clean, data)
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
        assert {r.doc_id for r in out.collect()} >= set(range(20)), name
        if name == "language":
            assert out.where("doc_id in (98, 99)").count() == 0
    empty = spark.createDataFrame([], clean.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, data).count() == 0


def test_pipeline_has_five_stages():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert langid.UNKNOWN == "und" and pii.KINDS == ("email", "ip", "card", "phone")
