"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches of descending ids. A batch's line keys become a run: one row
for each key with the number of documents and the largest id, bucketed and sorted by the
key's 128-bit hash. Before a run is added, the batch is merge-anti-joined with the runs
so far: keys that these already hold in enough documents are settled (their largest id
came first), so that the new run leaves them out. When a level has ``fanout`` runs they
are merged into one run of the next level. Runs are bucketed tables in the shared folder,
so neither the anti-joins nor the merges shuffle or sort the older runs again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftaudit.llm.common import id_ranges, range_of, slices
from weftaudit.sources.shared import shared_dir

KEY = ["h1", "h2"]
MIN_CHARS = 20
MIN_DOCS = 3


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 16-byte hash of a line's key, or None if the key is too short.

    ``bytes.strip`` takes exactly the six ASCII white-space characters, ``bytes.lower`` exactly A-Z.
    """
    key = line.strip().lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _keys(min_chars: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h1, h2, ids, parts = [], [], [], []
            for doc_id, part, text in zip(batch["doc_id"].to_pylist(), batch["part"].to_pylist(), batch["text"].to_pylist()):
                found = {line_key(line, min_chars) for line in (text or "").encode().split(b"\n")}
                found.discard(None)
                for key in found:
                    h1.append(int.from_bytes(key[:8], "big", signed=True))
                    h2.append(int.from_bytes(key[8:], "big", signed=True))
                ids += [doc_id] * len(found)
                parts += [part] * len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(ids, pa.int64()), pa.array(parts, pa.int32())],
                names=["h1", "h2", "doc_id", "part"],
            )

    return keys


class Runs:
    """Levelled runs of (h1, h2, n_docs, keep), each a bucketed and sorted table in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int, buckets: int) -> None:
        self.spark, self.min_docs, self.fanout, self.buckets = spark, min_docs, fanout, buckets
        self.folder = f"{shared_dir(spark).rstrip('/')}/line-runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.names: list[str] = []

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows = run.repartition(self.buckets, *KEY)
        writer = rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.folder}/{name}")
        writer.format("parquet").saveAsTable(name)
        self.names.append(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs as one, by merge joins of their buckets. (A union of bucketed tables must not be grouped: Spark 4.1
        takes it for dealt by the keys although its partitions are not put together.)"""
        rows = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).select(*KEY, F.col("n_docs").alias("more"), F.col("keep").alias("other"))
            both = rows.join(other.hint("merge"), KEY, "full")
            total = F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))
            rows = both.select(*KEY, total.alias("n_docs"), F.greatest("keep", "other").alias("keep"))
        return rows

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (h1, h2, doc_id), one row for each key and document."""
        run = lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keep"))
        for name in [n for level in self.levels for n in level]:
            settled = self.spark.table(name).filter(F.col("n_docs") >= self.min_docs)
            run = run.join(settled.hint("merge"), KEY, "left_anti")
        self._push(0, self._write(run))

    def _push(self, level: int, name: str) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            merged = self._write(self._merged(self.levels[level]))
            self.levels[level] = []
            self._push(level + 1, merged)

    def close(self) -> DataFrame:
        """The last compaction: all keys of all runs. The run tables leave the catalog; their files stay readable."""
        last = self._write(self._merged([n for level in self.levels for n in level]))
        schema = self.spark.table(last).schema
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{last}")


def _kept(min_chars: int):
    fields = pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])

    def kept(texts: pa.Array, drops: pa.Array) -> pa.Array:
        rows = []
        for text, drop in zip(texts, drops):
            text, drop = text.as_py() or "", drop.as_py()
            if not drop:
                rows.append((text.count("\n") + 1, 0, text))
                continue
            gone = {a.to_bytes(8, "big", signed=True) + b.to_bytes(8, "big", signed=True) for a, b in zip(drop[::2], drop[1::2])}
            lines = text.encode().split(b"\n")
            left = [line for line in lines if line_key(line, min_chars) not in gone]
            rows.append((len(lines), len(lines) - len(left), b"\n".join(left).decode()))
        return pa.array([dict(zip(("n_lines", "n_dropped", "kept"), r)) for r in rows], fields)

    return kept


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = 4, fanout: int = 2, buckets: int | None = None
) -> DataFrame:
    """All columns of ``docs`` plus struct ``line_dedup`` (n_lines, n_dropped, kept).

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys
    of ``min_chars`` code points or more that ``min_docs`` documents or more hold lose all
    their lines except in the document of the largest id. Every row counts as a document;
    rows of equal id are kept or emptied together; a null id ranks below all others. A null
    or empty text is one empty line. Other columns pass through unread, whatever their names (a
    column line_dedup is replaced); an empty table gives an empty result.

    Lines that a large share of the documents hold meet partial sums first; the join that
    spreads a key's decision to its documents is a plain sort-merge join, whose large
    partitions adaptive execution splits.
    """
    spark = docs.sparkSession
    drop_name, id_name = (f"{name}_{uuid.uuid4().hex}" for name in ("drops", "doc"))
    folder = f"{shared_dir(spark).rstrip('/')}/line-keys-{uuid.uuid4().hex}"
    cuts = id_ranges(docs.select("doc_id"), batches)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), range_of(F.col("doc_id"), cuts).alias("part"), "text")
    schema = "h1 long, h2 long, doc_id long, part int"
    source.mapInArrow(_keys(min_chars), schema).write.partitionBy("part").parquet(folder)
    lines = spark.read.schema(schema).parquet(folder)
    runs = Runs(spark, min_docs, fanout, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    for part in range(len(cuts), -1, -1):
        runs.add(lines.filter(F.col("part") == part))
    repeated = runs.close().filter(F.col("n_docs") >= min_docs)
    drops = (
        lines.join(repeated, KEY)
        .filter(~F.col("doc_id").eqNullSafe(F.col("keep")))
        .groupBy("doc_id")
        .agg(F.flatten(F.collect_set(F.array(*KEY))).alias(drop_name))
        .withColumnRenamed("doc_id", id_name)
    )
    joined = docs.join(drops, docs["doc_id"].eqNullSafe(drops[id_name]), "left")
    result = F.arrow_udf(_kept(min_chars), "n_lines long, n_dropped long, kept string")
    return joined.withColumn("line_dedup", result(F.col("text"), F.col(drop_name))).drop(id_name, drop_name)
