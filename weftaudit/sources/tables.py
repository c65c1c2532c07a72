"""Reading the given tables and the tables derived from them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftaudit.plans.fixtures import with_clause

GIVEN = r"\bFROM (pages|events|conversations|documents)\b"


def spread(frame: DataFrame, key: str) -> DataFrame:
    """Deal a table over the cores whose rows lie in too few of its file splits.

    A split has rows only where a row group begins, so a large file of one row group is read by
    one task, however many splits it has. The rows of each split are counted first (no column is
    read for that); if the largest has over twice the share of a core, all rows are dealt out.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    splits = frame.groupBy(F.spark_partition_id().alias("split")).agg(F.count("*").alias("n"))
    rows, largest = splits.agg(F.sum("n"), F.max("n")).first()
    if not rows or largest * cores <= 2 * rows:
        return frame
    return frame.repartition(max(cores, frame.rdd.getNumPartitions()), key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows, "doc_id") if name == "documents" else rows


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame; its SQL reads the given tables by name."""
    query = f"WITH {with_clause(name)} SELECT * FROM {name}"
    rows = spark.sql(re.sub(GIVEN, lambda m: f"FROM parquet.`{sf_dir}/{m.group(1)}.parquet`", query))
    return spread(rows, "page_id") if name == "pages_raw" else rows
