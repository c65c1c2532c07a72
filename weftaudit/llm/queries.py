"""Registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftaudit.llm import bpe, centroids, decontaminate, divergence, exact, extract, lines, lm, quality, secrets, simhash, tokenfile, winnow
from weftaudit.llm.oracle import DIVERGENCES, EXACT_COPIES, LINES, centroid_rounds


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer file on this machine; operators take the path as a parameter."""
    return importlib.import_module("public_tokenizers").path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.col("line_dedup.kept"), 256).alias("kept_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scores = quality.score_documents(docs, quality.train(docs, _table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int")
    return scores.select("doc_id", (quality.doc_crc() % 5 == 0).alias("held_out"), "score", predicted.alias("predicted"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_with_next(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(_table(spark, sf_dir, "pages"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(_table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, keys = tokenfile.write_tokens(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return files.read(keys).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(_table(spark, sf_dir, "embeddings")).report()


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.find_copies(_table(spark, sf_dir, "documents")).drop("row")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_decontamination, op3_quality, op4_bpe, op5_winnowing, op6_simhash, op7_main_text, op8_language_model,
        op9_secrets, op10_token_files, op11_centroid_clustering, op12_exact_dedup, op13_source_divergence, pipeline,
    )
}

ORACLE: dict[str, str] = {
    "op1_line_dedup": LINES,
    "op11_centroid_clustering": centroid_rounds(),
    "op12_exact_dedup": EXACT_COPIES,
    "op13_source_divergence": DIVERGENCES,
}
