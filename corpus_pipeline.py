"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, tokens.

Each stage is (spark, docs, sf_dir) -> DataFrame and gets what its predecessor kept, written as Parquet and read again.
All but the last return the columns of documents; the last gives the ids of every remaining document with digests.

All stages take texts whole, of any length, pass columns of any names through, give no rows for no documents, and judge repeated
rows alike. What else they do with odd rows stands with each.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import decontamination, pii, quality_rules, sentencepiece_bpe, shingle_sets
from tagloom.llm.common import ensure_checkpoint_dir


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, if the documents have it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines are removed; documents that the rules reject go.

    Null and empty texts have no words and are rejected; shares at their limits pass; rows without an id are judged as others.
    """
    return _with_length(quality_rules.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id.

    Groups are linked by a similarity of five-word shingles of at least 0.8: by SimHash covering first, then by what 2 bits
    leave apart. Null texts and texts without words are one group. A row without an id stays only if its group has no other, of
    repeated rows the least stays, and different texts of one id are told apart.
    """
    return shingle_sets.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item in whole or in part go.

    Null and empty texts hold nothing and stay, null and empty items are in no text; an empty benchmark leaves all documents.
    """
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in angle brackets.

    A null text stays null; spans of several kinds that overlap become one, named for the first; no document goes.
    """
    return _with_length(pii.mask(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and spans_sha256 of every remaining document; a null text counts as empty."""
    return sentencepiece_bpe.encode_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("benchmark_decontamination", decontaminate), ("pii", personal_data), ("sentencepiece", tokens)]

#: Fingerprint links, alignments and merges are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir; stages meet in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
