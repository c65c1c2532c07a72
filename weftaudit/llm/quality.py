"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w[i] x[i] + 1/2 sum_f ((sum_i v[i,f] x[i])**2 - sum_i (v[i,f] x[i])**2)),
so that all pairwise interactions cost time linear in the number of distinct features.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftaudit.llm.common import doc_crc, small_slices

WORD_BINS = 1 << 14
STAT_BINS = 12
STATS = ("log_words", "log_chars_column", "mean_word", "upper", "digit", "symbol", "space", "newline", "non_ascii", "distinct", "top_word", "repeat", "bang_words", "bars")
#: Labelled rows used for the fit at most: a bounded, documented sample (the smallest hashes of the ids).
SAMPLE_ROWS = 8000
THRESHOLD = 0.3
FACTORS = 8
N_FEATURES = WORD_BINS + STAT_BINS * len(STATS)

_CLASS = np.zeros(256, dtype=np.int64)
for _chars, _kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b"#$%&*+<=>@\\^_`|~!?{}[]/", 3), (b" \t\r\x0b\x0c", 4), (b"\n", 5)):
    _CLASS[list(_chars)] = _kind
_CLASS[128:] = 6


class Features:
    """Turns a text into (feature numbers, values)."""

    def __call__(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        raw = (text or "").encode()
        words = raw.lower().split()
        n, size = len(words), max(1, len(raw))
        counts = Counter(words)
        kinds = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=7) / size
        stats = (
            np.log2(n + 1) / 20,
            0.0 if n_chars is None or n_chars < 0 else np.log2(n_chars + 1) / 24,
            min(1.0, size / max(1, n) / 24),
            min(1.0, 1.2 * kinds[1]),
            min(1.0, 4 * kinds[2]),
            min(1.0, 3 * kinds[3]),
            min(1.0, 2 * kinds[4]),
            min(1.0, 20 * kinds[5]),
            kinds[6],
            len(counts) / max(1, n),
            max(counts.values(), default=0) / max(1, n),
            sum(map(bytes.__eq__, words, words[1:])) / max(1, n),
            raw.count(b"!!") / max(1, n),
            min(1.0, raw.count(b" |") / max(1, n)),
        )
        at = np.array([WORD_BINS + j * STAT_BINS + min(STAT_BINS - 1, int(s * STAT_BINS)) for j, s in enumerate(stats)], dtype=np.int64)
        if not n:
            return at, np.full(len(at), 0.5)
        bins = np.fromiter(map(zlib.crc32, counts), dtype=np.int64, count=len(counts)) % WORD_BINS
        weight = 1.0 + np.log(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
        summed = np.bincount(bins, weights=weight, minlength=WORD_BINS)
        kept = np.flatnonzero(summed)
        values = summed[kept] / np.linalg.norm(summed[kept])
        return np.concatenate([kept, at]), np.concatenate([values, np.full(len(at), 0.5)])


@dataclass
class FactorisationMachine:
    """Weights of the machine; scores and gradients by the sum-of-squares identity."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    @staticmethod
    def start(seed: int = 7) -> FactorisationMachine:
        rng = np.random.default_rng(seed)
        return FactorisationMachine(0.0, np.zeros(N_FEATURES), rng.normal(0, 0.02, (N_FEATURES, FACTORS)))

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.factors[at] * x[:, None]
        return float(self.bias + self.linear[at] @ x + 0.5 * ((vx.sum(0) ** 2).sum() - (vx**2).sum()))

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.raw(at, x), -35, 35))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int, rate: float = 0.08, l2: float = 2e-5, seed: int = 11) -> FactorisationMachine:
        """Mini-batch AdaGrad on the logistic loss, in an order fixed by the seed."""
        rng = np.random.default_rng(seed)
        seen_w, seen_v, seen_b = np.full(N_FEATURES, 1e-3), np.full((N_FEATURES, FACTORS), 1e-3), 1e-3
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for first in range(0, len(order), 64):
                chosen = order[first : first + 64]
                at = np.concatenate([rows[i][0] for i in chosen])
                x = np.concatenate([rows[i][1] for i in chosen])
                row = np.repeat(np.arange(len(chosen)), [len(rows[i][0]) for i in chosen])
                vx = self.factors[at] * x[:, None]
                sums = np.zeros((len(chosen), FACTORS))
                np.add.at(sums, row, vx)
                squares = np.bincount(row, weights=(vx**2).sum(1), minlength=len(chosen))
                raw = self.bias + np.bincount(row, weights=self.linear[at] * x, minlength=len(chosen)) + 0.5 * ((sums**2).sum(1) - squares)
                slope = (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - labels[chosen]) / len(chosen)
                g = slope.sum()
                seen_b += g * g
                self.bias -= rate * g / np.sqrt(seen_b)
                touched, inverse = np.unique(at, return_inverse=True)
                gw = np.bincount(inverse, weights=slope[row] * x, minlength=len(touched)) + l2 * self.linear[touched]
                each = slope[row][:, None] * x[:, None] * (sums[row] - vx)
                gv = np.stack([np.bincount(inverse, weights=each[:, f], minlength=len(touched)) for f in range(FACTORS)], 1) + l2 * self.factors[touched]
                seen_w[touched] += gw**2
                seen_v[touched] += gv**2
                self.linear[touched] -= rate * gw / np.sqrt(seen_w[touched])
                self.factors[touched] -= 0.5 * rate * gv / np.sqrt(seen_v[touched])
        return self


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in small_slices(batches):
        at, x = zip(*(features(t, n) for t, n in zip(batch["text"].to_pylist(), batch["n_chars"].to_pylist()))) if batch.num_rows else ((), ())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["quality"], pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), pa.array([v.astype("<f4").tobytes() for v in x], pa.binary())],
            names=["doc_id", "quality", "at", "x"],
        )


def _inputs(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), n_chars.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> FactorisationMachine:
    """Fit on at most ``sample_rows`` labelled documents whose crc32(doc_id as text) mod 5 is not 0.

    The sample is the labelled ids of smallest hash: it is bounded, so its ids are broadcast
    and only its features come to the driver. Repeated labels of a document count as their
    minimum; labels that are null are left out. Without labels every score is 0.5.
    """
    chosen = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (doc_crc() % 5 != 0))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(F.col("quality").cast("int")).alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    rows = _inputs(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text", "n_chars")
    found = rows.mapInArrow(_featurised, "doc_id long, quality int, at binary, x binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["at"]))
    if not found:
        return FactorisationMachine(0.0, np.zeros(N_FEATURES), np.zeros((N_FEATURES, FACTORS)))
    data = [(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["x"], "<f4").astype(np.float64)) for r in found]
    return FactorisationMachine.start().fit(data, np.array([float(r["quality"] > 0) for r in found]), epochs=max(4, min(30, 40_000 // len(found))))


def score_documents(docs: DataFrame, machine: FactorisationMachine) -> DataFrame:
    """One row (doc_id, score) for each row of ``docs``; null and empty texts are scored as having no words."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in small_slices(batches):
            scores = [machine.score(*features(t, n)) for t, n in zip(batch["text"].to_pylist(), batch["n_chars"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return _inputs(docs).mapInArrow(scored, "doc_id long, score double")


def with_scores(docs: DataFrame, machine: FactorisationMachine, name: str = "__score") -> DataFrame:
    """All columns of ``docs`` plus the score, without a shuffle."""

    def scores(texts: pa.Array, sizes: pa.Array) -> pa.Array:
        features = Features()
        return pa.array([machine.score(*features(t.as_py(), n.as_py())) for t, n in zip(texts, sizes)], pa.float64())

    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.withColumn(name, F.arrow_udf(scores, "double")(F.col("text"), n_chars))
