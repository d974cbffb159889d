"""A training-data pipeline over ``documents``: five stages, each an operator of tidelog.llm.

quality rules       documents that the rules reject go;
line dedup          a line found in ten documents or more stays where it comes first only;
MinHash near-dedup  of each group of near copies (five-word shingles, similarity 0.8 or
                    more) the document with the smallest id stays;
source mix          documents are repeated or left out so that each source comes near its
                    share (weights 5, 2, 1 in turn, at most three epochs);
SentencePiece       each row's ids, and digests of them and of the text they decode to.

Every stage works on all rows of the one before.  All but the last return the columns of
``documents``; n_chars follows the text.  Empty tables and null texts pass through as each
operator defines it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import line_dedup, minhash_dedup, mixing, quality, sentencepiece_codec
from tidelog.llm.common import documents, saved_dir
from tidelog.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judge(docs).where("kept").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(docs, min_docs=10, keep_first=True)
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.drop_near_duplicates(docs, percent=80).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", minhash_near_dedup),
    ("source mix", source_mix),
    ("SentencePiece", sentencepiece),
]

#: Merge-type encoding has no SQL; tests/llm hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again before the next one."""
    rows, folder = documents(spark, sf_dir), f"{saved_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, rows, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        rows = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return rows
