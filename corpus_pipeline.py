"""A corpus pipeline: quality rules, near-dedup, secret removal, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm import bpe, mixing, near_copies, quality, queries, secrets
from pulseloom.llm.common import store, table

NEEDED = ("doc_id", "text", "lang", "source", "n_chars")


def plain(docs: DataFrame) -> DataFrame:
    """``docs`` whose columns beside NEEDED have names that no operator adds; order and number stay."""
    return docs.toDF(*[c if c in NEEDED else f"__column_{k}" for k, c in enumerate(docs.columns)])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and their language's perplexity band accept, each judged by its own text.

    A null or empty text fails the base rules; a null language is one of its own."""
    own = plain(docs)
    return quality.judge(own, drop_text=False).where("kept").select(*own.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, its earliest document's: five-word shingles, similarity 0.8 or more.

    A null id is the smallest; null and empty texts are copies of each other."""
    return near_copies.keep_first(plain(docs)).toDF(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with a mark in place of each secret and n_chars counted anew; null texts stay null."""
    own = plain(docs)
    clean = secrets.scan(own, secrets.train(own), out="__spans", mark="<secret>")
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*own.columns).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn by the probabilities that meet the target mix; rows without words are not drawn."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", "lang", "text")
    return mixing.mix(own).where("selected").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's text (none of a null or empty one), and whether they decode to it."""
    words = queries.vocabulary(spark)
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "n_chars", "text"), words, verified="round_trip")
    return coded.select("doc_id", "lang", "source", "n_chars", (F.octet_length("ids_packed") / 4).cast("long").alias("n_tokens"), "ids_packed", "round_trip")


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("secret scans", secret_scan), ("mixing", mix_sources), ("tokens", tokens)]

#: The perplexity model and the tagger are trained, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store(docs)
    return docs
