"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, gif, leaks, near, ngram, oracles, packed_ids, passages, pii, shared, toxicity, urls

#: Place of the vocabulary file; a parameter of the operators.
VOCABULARY = str(public_tokenizers.path("byte_bpe_50k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = gif.store_samples(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return gif.read_samples(shared.write_table(stored, shared.run_folder(spark, "gif"), "media"))


def op2_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.run_folder(spark, "packed-ids")
    files = packed_ids.write_ids(table(spark, sf_dir, "documents"), folder, VOCABULARY, end_id=2)
    return packed_ids.read_ids(files, with_ids=False)


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scored = ngram.score(table(spark, sf_dir, "documents").select("doc_id", "text"), held_out, shared.run_folder(spark, "ngram"))
    # sums of many logarithms end in digits that depend on their order
    return scored.withColumns({c: F.round(c, n) for c, n in (("base_score", 6), ("score", 6), ("perplexity", 3))})


#: Listed rules of the URL query (fixed values).
LISTED = [urls.Listed("net", "/", "block"), urls.Listed("example.net", "/en/", "allow"), urls.Listed("example.com", "/de/", "block"), urls.Listed("org", "/fr/", "allow")]


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand for those of pages: a page is bad if the label of the document with its number has quality 0 or toxic 1."""
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    labelled = pages.join(labels, pages.page_id == labels.doc_id).select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return urls.judge(pages, labelled, LISTED)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY, keep=["doc_id"])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.grade(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).drop("text")


def op7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(table(spark, sf_dir, "documents"), shared.run_folder(spark, "near"))


def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shared.run_folder(spark, "leaks"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"), shared.run_folder(spark, "passages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op9_passages": op9_passages, "op6_toxicity": op6_toxicity, "op8_leaks": op8_leaks, "op7_near": op7_near, "op3_kneser_ney": op3_kneser_ney, "op4_url_rules": op4_url_rules, "op10_pii": op10_pii, "op1_gif": op1_gif, "op2_packed_ids": op2_packed_ids, "op5_bpe": op5_bpe}
ORACLES = {"op10_pii": pii.ORACLE, "op3_kneser_ney": oracles.KNESER_NEY, "op4_url_rules": oracles.url_rules(LISTED), "op7_near": oracles.NEAR}
