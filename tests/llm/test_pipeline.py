"""The pipeline's stages, each against what its operator says of its own input."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from pulseloom.llm import near_copies, quality, queries, secrets
from tests.conftest import SF
from tests.test_oracle import rows


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    first = stages["near-dedup"](spark, kept, SF)
    assert {r.doc_id for r in first.collect()} == {r["first"]["key"] for r in near_copies.near_duplicates(kept).collect()}
    clean = stages["secret scans"](spark, first, SF)
    assert clean.columns == docs.columns and clean.count() == first.count()
    assert all(not secrets.base_spans(r.text) and r.n_chars == len(r.text) for r in clean.collect())
    mixed = stages["mixing"](spark, clean, SF)
    assert mixed.columns == docs.columns and 0 < mixed.count() <= clean.count()
    out = stages["tokens"](spark, mixed, SF)
    assert out.count() == mixed.count() and out.where("NOT round_trip").count() == 0


def test_stages_take_odd_rows_and_clashing_names(spark):
    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    extra = ["kept", "weight", "selected", "mark", "spans", "row", "topic", "band_low", "__of", "first"]
    odd = [(None, good[0], None, None, None), (1, good[1], "en", "a", 1), (1, good[2], "en", "a", 1), (1, good[1], "en", "a", 1), (None, None, None, None, None), (5, "", "", "", 0), (1, "bad", "en", "a", 3)]
    data = [(*r, *["x"] * len(extra)) for r in [*odd, *((k + 10, t, "en", "b", 1) for k, t in enumerate(good))]]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra))
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        if name != "tokens":
            assert stage(spark, docs.limit(0), SF).count() == 0
        out = stage(spark, at, SF)
        if name != "tokens":
            assert out.columns == docs.columns, name
        if name == "quality rules":
            judged = quality.judge(corpus_pipeline.plain(docs), drop_text=False).where("kept").collect()
            assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted((str(r.doc_id), r.text) for r in judged)
            assert not any(r.text == "bad" for r in out.collect())
        if name == "secret scans":
            assert out.count() == at.count()
        at = spark.createDataFrame(out.collect(), out.schema)
    assert at.count() > 0


def test_queries_and_sql(spark):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for name, sql in queries.oracle_sql().items():
        assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(con.sql(sql).df()), name


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_contract_columns(spark, name):
    want = {"op1_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op3_passages": "doc_id n_bytes n_removed n_spans kept_sha256", "op4_spotsigs": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
            "op5_simhash": "doc_id fingerprint component_id", "op7_secrets": "doc_id n_assign n_access n_hex base_sha256 spans", "op8_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op9_urls": "page_id host path rule verdict"}
    out = queries.queries()[name](spark, SF)
    source = "pages" if name == "op9_urls" else "documents"
    assert set(want.get(name, "doc_id").split()) <= set(out.columns)
    assert out.count() == spark.read.parquet(f"{SF}/{source}.parquet").count()
