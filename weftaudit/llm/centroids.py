"""Centroid clustering over an incremental matrix of exact dot products.

The state is a stored table of one row per vector: its whole-number components, its squared
length, its dot product with every centroid and its cluster. A round moves some components of
some centroids; only these change the dot products, by (new - old) * component. The nearest
centroid then follows from |v|^2 - 2 v.c + |c|^2 without reading the centroids again. The sums
of the clusters are kept too and change only by the vectors that went from one to another.
All of it is exact integer arithmetic. Every round is written to the shared folder, so lost
executors cost at most the round at hand; the table of the round before is deleted then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftaudit.sources.shared import fresh_path

CLUSTERS = 8
ROUNDS = 10
DIMS = 64
SCALE = 1024
SEED = 3
#: Components may be this large, so that every distance fits into 64 bits; larger ones are an error.
LARGEST = 1 << 27
#: Rows worked on at a time.
ROWS = 4096

STATE = "vec_id long, v array<long>, dots array<long>, length long, cluster int, was int, distance long"
_LONGS = pa.list_(pa.int64())


def whole_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors with ``dims`` components, none null, NaN or infinite; v is floor(scale * component)."""
    parts = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(parts, lambda x: F.floor(x * float(scale)))
    small = F.forall(parts, lambda x: F.abs(x * float(scale)) <= float(LARGEST))
    fits = F.when(small, whole).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} / {scale}")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where((F.size("embedding") == dims) & finite)
    return kept.select("vec_id", fits.cast("array<bigint>").alias("v"))


def first_centroids(whole: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """The vectors with the ``k`` smallest hashes of their ids; equal ids go by their components."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = whole.withColumn("code", code).orderBy("code", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def _lists(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(matrix.ravel()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _step(old: np.ndarray | None, new: np.ndarray):
    """Bring dot products from the ``old`` centroids (None: none are stored) to the ``new`` ones and assign again."""
    k, dims = new.shape
    lengths = (new * new).sum(axis=1)
    change = new if old is None else new - old
    moved = [(j, np.flatnonzero(change[j])) for j in range(k)]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                v = _matrix(rows["v"], dims)
                if old is None:
                    dots, length = np.zeros((len(v), k), dtype=np.int64), (v * v).sum(axis=1)
                    was = np.full(len(v), -1, dtype=np.int32)
                else:
                    dots, length = _matrix(rows["dots"], k), rows["length"].to_numpy()
                    was = rows["cluster"].to_numpy()
                for j, parts in moved:
                    if len(parts):
                        dots[:, j] += v[:, parts] @ change[j, parts]
                distances = length[:, None] - 2 * dots + lengths[None, :]
                cluster = distances.argmin(axis=1).astype(np.int32)  # the first of equal ones
                yield pa.RecordBatch.from_arrays(
                    [
                        rows["vec_id"], _lists(v), _lists(dots), pa.array(length), pa.array(cluster), pa.array(was),
                        pa.array(distances[np.arange(len(v)), cluster]),
                    ],
                    names=["vec_id", "v", "dots", "length", "cluster", "was", "distance"],
                )

    return step


def _changes(k: int, dims: int):
    """What a task's vectors change in the sums and sizes of the clusters: one row for each cluster."""

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, dims + 1), dtype=np.int64)  # the last row takes what was in no cluster
        for batch in batches:
            v = np.column_stack([_matrix(batch["v"], dims), np.ones(batch.num_rows, dtype=np.int64)])
            for column, sign in (("cluster", 1), ("was", -1)):
                at = batch[column].to_numpy()
                for j in np.unique(at):
                    total[j] += sign * v[at == j].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), _lists(total[:k])], names=["cluster", "sums"])

    return changes


def _moved_sums(state: DataFrame, k: int, dims: int) -> np.ndarray:
    """Summed changes of the clusters' components and sizes; k * (dims + 1) numbers reach the driver."""
    moved = state.where(F.col("cluster") != F.col("was")).select("v", "cluster", "was")
    parts = moved.mapInArrow(_changes(k, dims), "cluster int, sums array<long>")
    each = parts.select("cluster", F.posexplode("sums").alias("part", "value")).groupBy("cluster", "part").agg(F.sum("value").alias("value"))
    total = np.zeros((k, dims + 1), dtype=np.int64)
    for r in each.collect():
        total[r["cluster"], r["part"]] = r["value"]
    return total


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@dataclass
class Clusters:
    """``assigned`` has vec_id, cluster and distance of each vector; ``centroids`` are the last ones, k x dims."""

    assigned: DataFrame
    centroids: np.ndarray

    def digest(self, cluster: int) -> str:
        return hashlib.sha256(",".join(str(int(c)) for c in self.centroids[cluster]).encode()).hexdigest()

    def report(self) -> DataFrame:
        """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector."""
        spark = self.assigned.sparkSession
        sums = self.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("s")).collect()
        every = sum(r["s"] for r in sums)
        rows = [(r["cluster"], r["s"], every, self.digest(r["cluster"])) for r in sums]
        facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        joined = self.assigned.join(F.broadcast(facts), "cluster")  # one row for each cluster
        return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_vectors(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED
) -> Clusters:
    """Lloyd's rounds over whole-number vectors, then a last assignment.

    ``vectors`` has vec_id and embedding. Vectors of another length, or with a null, NaN or
    infinite component, are left out; null ids are kept and count as an empty text when the
    first centroids are chosen. Ties go to the smaller cluster number. Rows that repeat count
    each. With fewer than ``k`` vectors there are as many centroids; equal first centroids
    leave the later one empty, and it stays as it is. An empty table gives no rows. Other columns
    are not read. Components beyond ``LARGEST`` are an error. Rounds end early when no centroid
    moved, as later ones would change nothing.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, dims, scale)
    new = first_centroids(whole, k, seed)
    if not len(new):
        return Clusters(spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dims), np.int64))
    k = len(new)
    old, state, path = None, whole, None
    sums = np.zeros((k, dims + 1), dtype=np.int64)
    for number in range(rounds + 1):
        stored = fresh_path(spark, "dots")
        state.mapInArrow(_step(old, new), STATE).write.parquet(stored)
        state = spark.read.schema(STATE).parquet(stored)
        if path is not None:
            _delete(spark, path)
        path = stored
        if number == rounds:
            break
        sums += _moved_sums(state, k, dims)
        sizes = sums[:, dims:]
        old, new = new, np.where(sizes > 0, sums[:, :dims] // np.maximum(sizes, 1), new)
        if np.array_equal(old, new):
            break
    return Clusters(state.select("vec_id", "cluster", "distance"), new)
