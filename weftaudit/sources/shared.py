"""Intermediate results on the shared file system of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset a local master (tests) gets a folder of its own, removed at exit; on a
    cluster, whose machines would not see it, this is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    named = named or context.getCheckpointDir()
    if named is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.TemporaryDirectory(prefix="weftaudit-", ignore_cleanup_errors=True))
        named = _OWN[0].name
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def tables_dir(spark: SparkSession) -> str:
    """Where this application writes its intermediate tables."""
    return f"{shared_dir(spark).rstrip('/')}/weftaudit-{spark.sparkContext.applicationId}"


def remove_tables(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results read from them must be written before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own among the intermediate tables."""
    return f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialised(frame: DataFrame) -> DataFrame:
    """Write a frame that several steps read, and read it back column by column."""
    spark = frame.sparkSession
    path = fresh_path(spark, "table")
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def bucketed(frame: DataFrame, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Write a frame dealt and sorted by ``keys``, so that repeated joins on them neither shuffle nor sort it."""
    spark = frame.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"weftaudit_{uuid.uuid4().hex}"
    writer = frame.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", f"{tables_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)
