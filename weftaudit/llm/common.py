"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftaudit.sources.shared import materialised

#: Rows turned into Python objects at a time inside a task.
SLICE = 256
#: Bytes of a slice where slices are bounded by bytes too, about (a longer text is a slice by itself).
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes in this session unless it has a lower bound: rows may be long, and ten thousand go into one batch else."""
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def doc_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


#: Ids that are sent to every task at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not among ``ids`` (column doc_id); null ids stay.

    The ids are stored and counted first. Few enough are broadcast, so that no text is
    shuffled; any larger number takes a merge join with the same result.
    """
    gone = materialised(ids.filter("doc_id is not null").select(F.col("doc_id").alias("__doc")).distinct())
    way = "broadcast" if gone.count() <= BROADCAST_IDS else "merge"
    return docs.join(gone.hint(way), docs["doc_id"] == gone["__doc"], "left_anti")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches, so that only a few texts at a time are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def small_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same, with fewer rows where rows are long."""
    for batch in batches:
        rows = max(1, min(SLICE, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def code_points(text: str) -> np.ndarray:
    """The code points of a text as unsigned 32-bit integers."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class RollingHash:
    """Hashes of all windows of ``k`` code points of a text, by wrapping 64-bit prefix sums.

    With an odd base B, sum(c[j] * B**j) over a window times B**-start depends on the
    window's code points only; a final mix spreads the bits.
    """

    BASE = 0x9E3779B97F4A7C15
    #: Code points worked on at a time: what is needed besides the result stays small for a text of any length.
    BLOCK = 1 << 20

    def __init__(self, k: int) -> None:
        self.k = k
        self.powers = np.ones(1, dtype=np.uint64)
        self.inverse = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = 1 << max(12, (n - 1).bit_length())
            for name, base in (("powers", self.BASE), ("inverse", pow(self.BASE, -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, points: np.ndarray) -> np.ndarray:
        """One hash for each start; empty if the text is shorter than ``k``."""
        n = len(points) - self.k + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        if n > self.BLOCK:
            blocks = range(0, n, self.BLOCK)
            return np.concatenate([self(points[a : a + self.BLOCK + self.k - 1]) for a in blocks])
        self._grow(len(points))
        sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * self.powers[: len(points)], out=sums[1:])
        return mix((sums[self.k :] - sums[: -self.k]) * self.inverse[:n])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), for whole arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def id_ranges(docs: DataFrame, parts: int, doc_id: str = "doc_id") -> list[int]:
    """Ascending cut points that deal the ids into about ``parts`` ranges of equal size.

    Only the id column is read, and only the cut points reach the driver.
    """
    shares = [i / parts for i in range(1, parts)]
    if not shares:
        return []
    cuts = docs.agg(F.percentile_approx(doc_id, shares, 10 * parts).alias("cuts")).first()["cuts"]
    return sorted(set(cuts or []))


def range_numbers(ids: pa.Array, cuts: list[int]) -> np.ndarray:
    """The number of each id's range, from 0; a cut belongs to the range below it, null ids to range 0."""
    filled = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    return np.searchsorted(np.array(cuts, dtype=np.int64), filled, side="left").astype(np.int32)


def range_of(doc_id: Column, cuts: list[int]) -> Column:
    """``range_numbers`` as a column."""

    def numbers(ids: pa.Array) -> pa.Array:
        return pa.array(range_numbers(ids, cuts))

    return F.arrow_udf(numbers, "int")(doc_id.cast("long"))
