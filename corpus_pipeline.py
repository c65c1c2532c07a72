"""A corpus pipeline of five stages over the documents table.

Quality rejection, line dedup, one document of each near-duplicate group, benchmark
decontamination, BPE encoding. Each stage takes what the one before it kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftaudit.llm import bpe, decontaminate, lines, quality, simhash
from weftaudit.llm.common import bounded_batches
from weftaudit.llm.queries import tokenizer_file
from weftaudit.sources.shared import shared_dir

#: SQL cannot express the classifier, SimHash or the tokenizer; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones of ``docs``, does not reject.

    Null and empty texts have a score like others; texts are scored whole; rows that repeat and rows
    without an id are judged each by itself; without labels nothing is rejected.
    """
    bounded_batches(spark)
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = f"score_{uuid.uuid4().hex}"  # no column of the documents
    return quality.with_scores(docs, machine, score).filter(F.col(score) >= quality.THRESHOLD).drop(score)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that other documents repeat; n_chars counts the new text.

    A null text becomes an empty one; no document goes, even if all its lines do. Rows of one id are
    one document for the choice of the row that keeps a line.
    """
    bounded_batches(spark)
    found = lines.dedup_lines(docs)
    text = F.col("line_dedup.kept")
    result = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        result = result.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return result.select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component; empty texts are one component, rows without an id all stay."""
    bounded_batches(spark)
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items; null and empty texts hold none, rows that share an id go together."""
    bounded_batches(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of each document; a null text has no tokens."""
    bounded_batches(spark)
    return bpe.encode_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", reject_low_quality),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if number + 1 == len(STAGES):
            return result
        result.write.parquet(f"{folder}/{number}")
        docs = spark.read.schema(result.schema).parquet(f"{folder}/{number}")
    return docs
