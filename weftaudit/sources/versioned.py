"""A keyed table in the shared folder that can be updated: whole buckets are rewritten, a manifest makes it visible."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """Rows by key in hashed buckets. Each commit writes the buckets it touches anew and then a manifest.

    Manifest n names for every bucket the commit that wrote it last, and the commits' labels.
    It is written beside its place and renamed, which succeeds for one writer only; readers
    take the newest manifest, so they see a commit whole or not at all. A label that has been
    committed before is passed over, so a replay changes nothing. What an executor or a driver
    leaves when it is lost is not named by any manifest.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets

    # The manifest

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return jvm, place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The newest manifest: version, labels and the commit of each bucket."""
        jvm, place, system = self._files()
        names = [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []
        versions = [int(n) for n in names if n.isdigit()]
        if not versions:
            return {"version": 0, "labels": [], "buckets": {}}
        stream = system.open(jvm.org.apache.hadoop.fs.Path(place, str(max(versions))))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        jvm, place, system = self._files()
        beside = jvm.org.apache.hadoop.fs.Path(place, f"_{uuid.uuid4().hex}")
        stream = system.create(beside, False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        there = jvm.org.apache.hadoop.fs.Path(place, str(manifest["version"]))
        if system.exists(there) or not system.rename(beside, there):
            system.delete(beside, False)
            raise RuntimeError(f"version {manifest['version']} was committed by another writer; read again and repeat")

    # Rows

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _read(self, buckets: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/rows/{commit}/bucket={bucket}" for bucket, commit in sorted(buckets.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        """The rows of the newest version."""
        return self._read(self.manifest()["buckets"])

    def _commit(self, label: str, changes: DataFrame, change) -> bool:
        """Apply ``change`` (old rows, changes) to the buckets of ``changes``; False if the label was committed before."""
        now = self.manifest()
        if label in now["labels"]:
            return False
        touched = [str(r["bucket"]) for r in changes.select(self._bucket().alias("bucket")).distinct().collect()]
        old = self._read({b: c for b, c in now["buckets"].items() if b in touched})
        new = change(old, changes).select(*self.spark.createDataFrame([], self.schema).columns, self._bucket().alias("bucket"))
        commit = f"{now['version'] + 1}-{uuid.uuid4().hex}"
        new.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/rows/{commit}")
        written = {str(r["bucket"]) for r in new.select("bucket").distinct().collect()} if touched else set()
        kept = {b: c for b, c in now["buckets"].items() if b not in touched}
        self._publish({"version": now["version"] + 1, "labels": [*now["labels"], label], "buckets": kept | dict.fromkeys(sorted(written), commit)})
        return True

    def insert(self, label: str, rows: DataFrame) -> bool:
        """Add rows whose key is new; a key that is there, or comes twice, keeps its first row (the least, of rows that come together)."""
        others = [c for c in self.spark.createDataFrame([], self.schema).columns if c != self.key]

        def add(old: DataFrame, new: DataFrame) -> DataFrame:
            first = new.groupBy(self.key).agg(F.min(F.struct(*others)).alias("r")).select(self.key, "r.*")
            return old.unionByName(first.join(old.select(self.key), self.key, "left_anti"))

        return self._commit(label, rows, add)

    def update(self, label: str, changes: DataFrame, at: list[str], columns: list[str]) -> bool:
        """Set ``columns`` of the rows that are there to those of their last change in the order of the columns ``at``."""

        def change(old: DataFrame, new: DataFrame) -> DataFrame:
            last = new.groupBy(self.key).agg(F.max_by(F.struct(*columns), F.struct(*at)).alias("_set"))
            both = old.join(last, self.key, "left")
            kept = [F.when(F.col("_set").isNotNull(), F.col("_set")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns]
            return both.select(*kept)

        return self._commit(label, changes, change)
