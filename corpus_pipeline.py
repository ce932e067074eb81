"""A training-corpus pipeline: toxic documents, near-duplicates, benchmark passages, personal data, token ids.

Each stage works on all rows that the one before it kept and returns the columns of its input; the last
returns token ids.  Null texts are empty in every stage and stay; rows with a null id are never dropped
as duplicates or leaks.  Repeated rows are near-duplicates of each other, so one stays.  An empty table
passes through.  Columns beyond those of documents stay; where a stage needs a name of its own, it
replaces a column of that name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, leaks, near, pii, shared, toxicity
from paperloom.llm.queries import VOCABULARY, table

#: Parts that a worker remembers while it encodes; the same workers run the other stages.
MEMO = 150_000


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not reject."""
    graded = toxicity.grade(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return graded.where(~F.col("rejected")).select(*docs.columns)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the least id."""
    return near.keep_one(docs, shared.run_folder(spark, "pipeline-near")).select(*docs.columns)


def _leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return leaks.drop_leaks(docs, table(spark, sf_dir, "benchmark"), shared.run_folder(spark, "pipeline-leaks")).select(*docs.columns)


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the names of their kinds in place of personal data."""
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def _bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and the hash of what they decode to."""
    coded = bpe.encode_text(docs, VOCABULARY, keep=["doc_id", "lang", "source"], memo=MEMO)
    return bpe.decode_ids(coded, VOCABULARY).select("doc_id", "lang", "source", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", _toxicity), ("near_duplicates", _near), ("decontamination", _leaks), ("pii", _pii), ("bpe", _bpe)]
#: Fitted models and alignments have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again before the next."""
    folder = shared.run_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.write_table(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
