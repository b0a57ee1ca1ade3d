"""Corpus pipeline: quality rules, near-duplicate removal, secret masking, packing.

Each stage works on all that the one before it kept. The first three return the columns
of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from slotledger.llm import packing, quality, secrets, simhash
from slotledger.llm.common import BATCH_BYTES, SMALL, cut, drop


def configure(spark):
    """The application's setting for its session, as its result is read after it returns: batches of texts that fit beside the JVM's heap."""
    spark.conf.set(BATCH_BYTES, SMALL)


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality rules reject go; their bands are fitted to the labels."""
    configure(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark, docs, sf_dir):
    """One document of each group of near copies stays: that of the smallest doc_id. Documents without doc_id are judged by their text."""
    return simhash.one_of_each(docs)


def secrets_stage(spark, docs, sf_dir):
    """Every document stays; secrets in its text are masked."""
    return secrets.masked(docs)


def packing_stage(spark, docs, sf_dir):
    return packing.pack(docs)


STAGES = [("quality rules", quality_stage), ("simhash near-dedup", near_dedup_stage), ("secret scans", secrets_stage), ("packing", packing_stage)]
#: Compression, the tokenizer and the differencing method are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The packed pieces of ``documents`` after all stages."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        if before:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
