"""Corpus pipeline: quality, near duplicates, benchmark leaks, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept. All but the last return the columns of documents:
the quality stage drops what it rejects, the join keeps one document of each group, decontamination drops documents that hold a
benchmark item, the secret scan replaces secrets in the texts (no document goes), and the last encodes the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symloom.llm import bpe, decontam, jaccard, quality, secrets
from symloom.llm.common import discard, scratch, table
from symloom.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, vocabulary())


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("BPE encoding and decoding", token_ids),
]

#: The learned scores, the sketches and the token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written to the shared folder and read again, and goes when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            at = scratch(spark, f"stage{k}")
            docs.write.parquet(at)
            docs = spark.read.parquet(at)
            if before:
                discard(spark, before)
            before = at
    return docs
