"""SimHash near-duplicates by covering locality-sensitive hashing.

For radius r each bit position i gets a vector m(i) of r + 1 bits, and each non-zero vector v
a mask: the positions with <m(i), v> = 1. Two fingerprints that differ in at most r positions
agree on the whole mask of some v, for the differing m(i) span at most r dimensions and some
v is orthogonal to them all. So no pair within the radius is missed: 2 ** (r + 1) - 1 tables.

With m(i) dealt evenly each mask has half of the 64 bits. A bucket of many fingerprints is
not compared pair by pair: it is refined by the same construction on the bits that its mask
leaves free. After three levels at most 8 bits are free, so a bucket then holds at most 256
distinct fingerprints. Buckets give spanning edges, not all pairs, and components come from
star contraction of these edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftaudit.llm.common import slices, without_ids
from weftaudit.sources.shared import materialised

RADIUS = 4
SHINGLE = 4
#: Buckets of more fingerprints are refined; the last level holds 2 ** 8 at most.
BUCKET = 2048
LEVELS = 3


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits: bit b is set if it is set in over half of the XXH64 hashes (seed 42) of the word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - shingle + 1)
    stops = ends[min(shingle, len(words)) - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), stops.tolist())], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for first in range(0, n, 4096):
        part = hashes[first : first + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist()))


def covering_masks(free: list[int], radius: int = RADIUS) -> list[int]:
    """The masks of the covering construction over the given bit positions, one for each non-zero v."""
    width = radius + 1
    if len(free) >= 1 << width:
        vectors = [j % (1 << width) for j in range(len(free))]
    else:  # too few positions for all vectors: those with the top bit set keep the masks even
        vectors = [(1 << radius) | (j % (1 << radius)) for j in range(len(free))]
    return [sum(1 << i for i, m in zip(free, vectors) if (m & v).bit_count() % 2) for v in range(1, 1 << width)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _positions(mask: int) -> list[int]:
    return [b for b in range(64) if mask >> b & 1]


def _keys(radius: int):
    """(fp, mask) -> (mask of the next level, bits under it, fp) for every mask that covers the free bits."""
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def masks(used: int) -> np.ndarray:
        if used not in known:
            free = _positions(~used & (1 << 64) - 1)
            known[used] = np.array([used | m for m in covering_masks(free, radius)], dtype=np.uint64)
        return known[used]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch["fp"].to_numpy().view(np.uint64)
            used = batch["mask"].to_numpy().view(np.uint64)
            for mask in np.unique(used):
                own, tables = fps[used == mask], masks(int(mask))
                for first in range(0, len(own), 8192):
                    part = own[first : first + 8192]
                    table = np.repeat(tables, len(part))
                    fp = np.tile(part, len(tables))
                    columns = [x.view(np.int64) for x in (table, fp & table, fp)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["mask", "bits", "fp"])

    return keys


def spanning_edges(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph that links fingerprints within the radius.

    Found by growing each component from its smallest member: every member is compared once
    with those not reached yet, so that no list of all pairs arises.
    """
    left, a, b = np.sort(fps), [], []
    while len(left) > 1:
        todo, left = [left[:1]], left[1:]
        while todo and len(left):
            hub, todo[-1] = todo[-1][:1], todo[-1][1:]
            if not len(todo[-1]):
                todo.pop()
            near = np.bitwise_count(left ^ hub) <= radius
            if near.any():
                a.append(np.repeat(hub, near.sum()))
                b.append(left[near])
                todo.append(left[near])
                left = left[~near]
    if not a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(a), np.concatenate(b)


def _bucket_edges(radius: int, most: int | None):
    """Rows sorted by (mask, bits) -> edges (a, b, 0) of small buckets and members (fp, mask, 1) of large ones."""

    def out(a: np.ndarray, b: np.ndarray, large: bool) -> pa.RecordBatch:
        flags = pa.array(np.full(len(a), large))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), flags], names=["a", "b", "large"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, spilled = None, [], False
        for batch in batches:
            if not batch.num_rows:
                continue
            mask, bits, fp = (batch[c].to_numpy().view(np.uint64) for c in ("mask", "bits", "fp"))
            ends = np.append(np.flatnonzero((mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])) + 1, len(fp))
            starts, left, right = np.append(0, ends[:-1]), [], []
            several = ends - starts > 1
            several[[0, -1]] = True  # these may go on in the batch before or after
            for start, end in zip(starts[several].tolist(), ends[several].tolist()):
                now = (mask[start], bits[start])
                if now != key:
                    if len(held) > 1 and not spilled:
                        pair = spanning_edges(np.array(held, dtype=np.uint64), radius)
                        left.append(pair[0])
                        right.append(pair[1])
                    key, held, spilled = now, [], False
                part = fp[start:end]
                if not spilled and most is not None and len(held) + len(part) > most:
                    part, held, spilled = np.concatenate([np.array(held, dtype=np.uint64), part]), [], True
                if spilled:
                    yield out(part, np.full(len(part), key[0], dtype=np.uint64), True)
                else:
                    held += part.tolist()
            if left:
                yield out(np.concatenate(left), np.concatenate(right), False)
        if len(held) > 1 and not spilled:
            yield out(*spanning_edges(np.array(held, dtype=np.uint64), radius), False)

    return edges


def fingerprint_edges(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, levels: int = LEVELS) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints ``fp`` which the radius connects.

    Each level deals (mask, bits) over the tasks; buckets of over ``bucket`` members pass
    through as a stream and go on to the next level.
    """
    found = None
    todo = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    for level in range(levels):
        keys = todo.mapInArrow(_keys(radius), "mask long, bits long, fp long")
        dealt = keys.repartition("mask", "bits").sortWithinPartitions("mask", "bits", "fp")
        most = bucket if level + 1 < levels else None
        rows = materialised(dealt.mapInArrow(_bucket_edges(radius, most), "a long, b long, large boolean"))
        edges = rows.filter(~F.col("large")).select("a", "b")
        found = edges if found is None else found.unionByName(edges)
        todo = rows.filter("large").select(F.col("a").alias("fp"), F.col("b").alias("mask")).distinct()
        if level + 1 < levels and not todo.take(1):
            break
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component that has an edge, by alternating star contraction.

    A large star links every larger neighbour of a node to the smallest node it sees, a small
    star every smaller neighbour and the node itself; both keep the components and end in
    stars. Each round is written to the shared folder, so that a lost executor does not
    repeat earlier rounds. Smallest neighbours are partial minima, and the joins that spread
    them are plain, so adaptive execution splits a hub's rows.
    """
    pairs = materialised(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    if not pairs.take(1):
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = materialised(small.filter("u <> v").distinct())
        changed = after.exceptAll(pairs).take(1) or pairs.exceptAll(after).take(1)
        pairs = after
        if not changed:
            break
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _fingerprints(shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [_signed(fingerprint(t, shingle)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return rows


def simhash_components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp (signed 64 bits), component_id, root (one fingerprint of the component).

    Words are runs without ASCII white space, A-Z in lower case; shingles keep repeats; a text
    of fewer words is one shingle, a null or empty one has fingerprint zero and links like any
    other. component_id is the smallest doc_id that links reach; null ids take part but are
    never the smallest, so a component of null ids only has a null component_id. Equal
    fingerprints are one node, so copies cost no pairs. Columns besides doc_id and text are
    not read.
    """
    source = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    prints = materialised(source.mapInArrow(_fingerprints(shingle), "doc_id long, fp long"))
    nodes = materialised(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(fingerprint_edges(nodes.select("fp"), radius, bucket))
    labels = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = labels.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(labels.join(smallest, "root"), "fp").select("doc_id", "fp", "component_id", "root")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One document of each component: the one of the smallest doc_id, with all its columns.

    Rows that repeat an id are told apart by their fingerprints: each counts for its own
    component, and of several rows of the smallest id of a component the least one stays (by its
    columns in their order). Rows without an id cannot be named by a component, so all of them
    stay. Empty texts are a component, texts of any length are read whole, an empty table gives
    an empty one, and no column name of ``docs`` is taken.
    """
    found = materialised(simhash_components(docs, radius, shingle))
    gone = found.filter("doc_id <> component_id").select("doc_id")
    repeated = materialised(found.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if repeated.isEmpty():
        return without_ids(docs, gone)

    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([_signed(fingerprint(t.as_py(), shingle)) for t in texts], pa.int64())

    components_of = found.select(F.col("fp").alias("fp_"), F.col("component_id").alias("component_"), F.col("root").alias("root_")).distinct()
    odd = docs.join(repeated.select(F.col("doc_id").alias("id_")), docs["doc_id"] == F.col("id_"), "left_semi")
    packed = odd.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), F.arrow_udf(prints, "long")("text").alias("fp_"))
    own = packed.join(components_of, "fp_").filter(F.col("row_.doc_id") == F.col("component_"))
    least = own.groupBy("root_").agg(F.min("row_").alias("row_")).select("row_.*")
    return without_ids(docs, gone.unionByName(repeated)).unionByName(least)
