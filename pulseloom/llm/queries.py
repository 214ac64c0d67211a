"""The registered queries of the text operators, thin over each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm import bpe, lines, lm, mixing, passages, quality, secrets, simhash, spotsigs, urls
from pulseloom.llm.common import table

#: The vocabulary of the registered queries; the operators take any path.
RANK_FILE = "byte_bpe_multi_50k.tiktoken"

#: The rules that the registered URL query applies.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def vocabulary(spark: SparkSession) -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary.load(spark, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, words, decoded="decoded").select(
        "doc_id",
        (F.octet_length("ids_packed") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids_packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), unit=lines.BOTH, keep_text=False)
    return found.select(
        "doc_id",
        F.size("removed").cast("long").alias("n_spans"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"])).alias("n_removed_chars"),
        F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",").alias("removed"),
        "kept_text",
    )


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.remove_passages(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edit_report(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score(table(spark, sf_dir, "documents"), order=3)
    return found.select("doc_id", "n_words", F.round("log10_score", 6).alias("log10_score"), F.round("mean_log10_score", 6).alias("mean_log10_score"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = secrets.scan(docs, secrets.train(docs)).select("doc_id", "spans")
    written = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(written(F.filter("spans", lambda s: s["kind"] != "crf")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        count("crf").alias("n_added"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "log_perplexity", "band_low", "band_high"
    )


def url_rules(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES) + " AS t(host, path, verdict)")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), url_rules(spark)).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH r(rhost, rpath, rv) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
hit AS (SELECT u.page_id, u.host, u.path, r.*, row_number() OVER (PARTITION BY u.page_id ORDER BY length(rhost) DESC NULLS LAST, length(rpath) DESC) AS k
        FROM u LEFT JOIN r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath))
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(rv, 'allow') AS verdict FROM hit WHERE k = 1
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return mixing.mix(docs).select(
        "doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 9).alias("weight"), F.round("probability", 6).alias("probability"), "selected"
    )


def queries() -> dict:
    return {"op1_bpe": op1_bpe, "op2_lines": op2_lines, "op3_passages": op3_passages, "op4_spotsigs": op4_spotsigs, "op5_simhash": op5_simhash, "op6_lm": op6_lm, "op7_secrets": op7_secrets, "op8_quality": op8_quality, "op9_urls": op9_urls, "op10_mixing": op10_mixing}


def oracle_sql() -> dict[str, str]:
    return {"op9_urls": OP9_SQL}
