"""Sinks that replays cannot double, and runs that stop when all that has landed is worked off."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# Fixed value: the state store that keyed processors with timers need; it lives on disk, not in the heap.
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def batch_folders(path: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: batch n is written to the folder ``batch=n``, which a replay of the batch overwrites."""

    def write(rows: DataFrame, batch: int) -> None:
        done = rows if prepare is None else prepare(rows)
        done.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def read_batches(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """All rows of a sink of batch folders with the number of their batch."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(StructType([*fields, StructField("batch", LongType())])).option("basePath", path).parquet(path)


def run_available(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Work off what has landed, in one or more batches, and stop. The next run goes on from the checkpoint folder."""
    with _state_on_disk(rows.sparkSession):
        writer = rows.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint)
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
