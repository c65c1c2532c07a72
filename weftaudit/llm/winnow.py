"""Document fingerprints by winnowing.

Hashes of all k-grams of code points; in every window of ``window`` successive hashes the
smallest is chosen, the rightmost of equal ones, and kept with its position. Any common
substring of k + window - 1 code points then shares a chosen hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftaudit.llm.common import RollingHash, code_points, id_ranges, range_numbers, range_of, slices

K = 24
WINDOW = 77


class Winnower:
    """Chosen (hash, position) pairs of a text."""

    def __init__(self, k: int = K, window: int = WINDOW) -> None:
        self.k, self.window = k, window
        self.rolling = RollingHash(k)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """32-bit hashes and their positions. A text shorter than k is one gram; an empty one has none."""
        points = code_points(text)
        if not len(points):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        hashes = (self.rolling if len(points) >= self.k else RollingHash(len(points)))(points) >> np.uint64(32)
        n, w = len(hashes), self.window
        late = np.uint64((1 << 32) - 1) - np.arange(n, dtype=np.uint64)
        keys = hashes << np.uint64(32) | late  # smallest hash first, then the rightmost
        if n <= w:
            chosen = keys.min(keepdims=True)
        else:  # minima of all windows from running minima of blocks, forward and backward
            padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
            padded[:n] = keys
            blocks = padded.reshape(-1, w)
            ahead = np.minimum.accumulate(blocks, axis=1).ravel()
            behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
            least = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
            chosen = least[np.concatenate([[True], least[1:] != least[:-1]])]
        return chosen >> np.uint64(32), (np.uint64((1 << 32) - 1) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common hashes among all distinct hashes of two fingerprints; 1 for two empty ones."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def written(hashes: np.ndarray, positions: np.ndarray) -> str:
    """``hash:position`` in order, hashes as 8 hexadecimal digits, joined by commas."""
    return ",".join(["%08x:%d" % pair for pair in zip(hashes.tolist(), positions.tolist())])


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars and fingerprint for each row; null texts count as empty. No shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnow = Winnower(k, window)
        for batch in slices(batches):
            texts = [t or "" for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([len(t) for t in texts], pa.int64()), pa.array([written(*winnow(t)) for t in texts], pa.string())],
                names=["doc_id", "n_chars", "fingerprint"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(rows, "doc_id long, n_chars long, fingerprint string")


def _parts(cuts: list[int], first: dict[int, int | None], borrower: dict[int, int]):
    """The range of each id and, for the first ids of a range, the range that borrows them."""

    def parts(ids: pa.Array) -> pa.Array:
        own = range_numbers(ids, cuts).tolist()
        return pa.array([[p, borrower[p]] if i == first[p] else [p] for i, p in zip(ids.to_pylist(), own)], pa.list_(pa.int32()))

    return parts


def _compared(k: int, window: int):
    schema = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnow = Winnower(k, window)

        def against(doc, following) -> tuple:
            doc_id, text, print_ = doc
            other = edited(text, following[1])
            changed = winnow(other)
            sha = hashlib.sha256(other.encode()).hexdigest()
            return doc_id, len(text), sha, written(*print_), written(*changed), likeness(print_[0], changed[0]), likeness(print_[0], following[2][0])

        part, held = None, None
        for batch in slices(batches):
            out = []
            for at, doc_id, text, lent in zip(*(batch[c].to_pylist() for c in ("part", "doc_id", "text", "lent"))):
                if at != part:
                    part, held = at, None
                elif held is None:
                    continue  # the lent row has served
                doc = (doc_id, text or "", winnow(text or ""))
                if held is not None:
                    out.append(against(held, doc))
                held = None if lent else doc
            columns = list(zip(*out)) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=schema)

    return rows


def compare_with_next(docs: DataFrame, k: int = K, window: int = WINDOW, parts: int | None = None) -> DataFrame:
    """Each document against its edited text and against the next document in descending doc_id.

    The edited text has the last floor(n / 2) code points replaced by the first as many of the
    next document (after the last comes the first; a single document follows itself). Ids are
    dealt into ranges by cut points, so one shuffle brings neighbours together; each range is
    lent the first rows of the range below. Rows of equal id are ordered by text; null ids
    come last, null texts count as empty, other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = id_ranges(source.select("doc_id"), parts)
    ranges = source.select("doc_id").groupBy(range_of(F.col("doc_id"), cuts).alias("part")).agg(F.max("doc_id").alias("first")).collect()
    first = {r["part"]: r["first"] for r in ranges}  # one entry for each range
    held = sorted(first, reverse=True)
    borrower = {below: above for above, below in zip(held, [*held[1:], *held[:1]])}
    rows = source.withColumn("to", F.arrow_udf(_parts(cuts, first, borrower), "array<int>")("doc_id")).select(
        "doc_id", "text", F.posexplode("to").alias("lent", "part")
    )
    dealt = rows.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "lent", F.col("doc_id").desc_nulls_last(), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(_compared(k, window), schema)
