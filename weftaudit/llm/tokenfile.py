"""Token ids in raw shard files with a minimal perfect hash index.

A shard file is a header (magic, id width, 0) and the ids of its documents one
after another, little-endian. Documents are dealt to shards by id ranges, so the shards in
order hold the documents in ascending order of doc_id. The index maps a document's key to
(shard, offset, length): keys are dealt into buckets by hash, and each bucket is a minimal
perfect hash with a fingerprint for every key, so a lookup reads one bucket row and a few
bits, and a missing key is told from a present one.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftaudit.llm.common import id_ranges, mix, range_of, slices
from weftaudit.llm.pieces import BYTE_LEVEL_PATTERN, Pieces
from weftaudit.sources.shared import shared_dir

MAGIC = b"WEFTIDS1"
HEADER = "<8sIQ"
HEADER_BYTES = struct.calcsize(HEADER)
END_ID = 2
#: Keys in an index bucket, about.
BUCKET_KEYS = 1 << 15
GAMMA = 2.0
MAX_LEVELS = 24


def key_hashes(ids: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
    """64-bit hashes of (doc_id, ordinal among rows of this id)."""
    return mix(mix(ids.view(np.uint64)) + ordinals.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: levels of bits, each set where just one remaining key falls.

    A key's number is the rank of its bit. Keys left after the last level are listed.
    """

    levels: list[np.ndarray]
    rest: np.ndarray

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left) and len(levels) < MAX_LEVELS:
            size = max(64, int(GAMMA * len(left)) + 63 & ~63)
            at = PerfectHash._place(left, len(levels), size)
            single = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(single, bitorder="little").view(np.uint64))
            left = left[~single[at]]
        return PerfectHash(levels, np.sort(left))

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; for a key that was not built in, any number or -1."""
        found = np.full(len(keys), -1, dtype=np.int64)
        before = 0
        for level, words in enumerate(self.levels):
            ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
            at = self._place(keys, level, 64 * len(words))
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (found < 0) & ((word >> bit) & np.uint64(1)).astype(bool)
            inside = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            found = np.where(hit, before + ranks[at >> 6] + inside, found)
            before += int(ranks[-1])
        if len(self.rest):
            low = np.minimum(np.searchsorted(self.rest, keys), len(self.rest) - 1)
            found = np.where((found < 0) & (self.rest[low] == keys), before + low, found)
        return found

    def dump(self) -> bytes:
        sizes = json.dumps([len(w) for w in self.levels]).encode()
        return struct.pack("<I", len(sizes)) + sizes + b"".join(w.tobytes() for w in [*self.levels, self.rest])

    @staticmethod
    def load(raw: bytes) -> PerfectHash:
        (n,) = struct.unpack_from("<I", raw)
        words = np.frombuffer(raw, dtype="<u8", offset=4 + n) if (len(raw) - 4 - n) % 8 == 0 else np.empty(0, np.uint64)
        levels, at = [], 0
        for size in json.loads(raw[4 : 4 + n]):
            levels.append(words[at : at + size])
            at += size
        return PerfectHash(levels, words[at:])


ENTRY = np.dtype([("print", "<u4"), ("shard", "<u4"), ("start", "<u8"), ("n", "<u8")])


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of the shared folder, as tasks reach it."""
    return pafs.FileSystem.from_uri(folder if "://" in folder or not folder.startswith("file:") else "file://" + folder[5:])


#: Pieces of a generation whose ids a worker keeps; they are some bytes each.
CACHE_PIECES = 300_000


class DocumentIds:
    """Ids of a text as raw bytes of the file's width."""

    def __init__(self, path: str, kind: str) -> None:
        self.kind = kind
        self.pieces = Pieces(path, BYTE_LEVEL_PATTERN, False, lambda ids: np.array(ids, dtype=kind).tobytes(), CACHE_PIECES)

    def __call__(self, text: str | None) -> bytes:
        return b"".join(self.pieces(text or ""))


_ENCODERS: dict[tuple[str, str], DocumentIds] = {}


def encoder(path: str, kind: str) -> DocumentIds:
    """The worker's encoder for a tokenizer file; it outlives the task."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = DocumentIds(path, kind)
    return _ENCODERS[path, kind]


def _written(folder: str, path: str, kind: str, end_id: int):
    width = np.dtype(kind).itemsize
    names = ["shard", "doc_id", "ordinal", "start", "n"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    end = np.array([end_id], dtype=kind).tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, kind)
        shard = TaskContext.get().partitionId()
        system, top = _opened(folder)
        name = f"{top}/.shard-{shard:06d}-{uuid.uuid4().hex}"
        start, last, ordinal = 0, object(), 0
        with system.open_output_stream(name) as file:
            file.write(struct.pack(HEADER, MAGIC, width, 0))
            for batch in slices(batches):
                out = []
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                    raw = encode(text) + end
                    file.write(raw)
                    ordinal = ordinal + 1 if doc_id == last else 0
                    last = doc_id
                    out.append((shard, doc_id, ordinal, start, len(raw) // width))
                    start += len(raw) // width
                columns = list(zip(*out)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
        system.move(name, f"{top}/shard-{shard:06d}.bin")

    return rows


def _bucket_index(table: pa.Table) -> pa.Table:
    ids = table["doc_id"].fill_null(np.iinfo(np.int64).min).to_numpy()
    keys = key_hashes(ids, table["ordinal"].to_numpy())
    order = np.argsort(keys, kind="stable")
    perfect = PerfectHash.build(keys)
    at = perfect(keys[order])
    entries = np.zeros(len(keys), dtype=ENTRY)
    entries["print"][at] = _fingerprints(keys[order])
    for name in ("shard", "start", "n"):
        entries[name][at] = table[name].to_numpy()[order]
    row = {"bucket": [table["bucket"][0].as_py()], "hash": [perfect.dump()], "entries": [entries.tobytes()]}
    return pa.table(row, schema=pa.schema([("bucket", pa.int32()), ("hash", pa.binary()), ("entries", pa.binary())]))


def _buckets(n: int):
    def buckets(ids: pa.Array, ordinals: pa.Array) -> pa.Array:
        keys = key_hashes(ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), ordinals.to_numpy(zero_copy_only=False))
        return pa.array((mix(keys ^ np.uint64(0x5BD1E995)) % np.uint64(n)).astype(np.int32))

    return F.arrow_udf(buckets, "int")


@dataclass
class TokenFiles:
    """A written set: the folder, the number of index buckets and the ids before each shard."""

    spark: SparkSession
    folder: str
    buckets: int
    base: dict[int, int]

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(doc_id, ordinal, shard, start, n) of the keys (doc_id, ordinal) that the index holds; start counts inside the shard."""
        index = self.spark.read.schema("bucket int, hash binary, entries binary").parquet(f"{self.folder}/index")
        asked = keys.select("doc_id", "ordinal").withColumn("bucket", _buckets(self.buckets)(F.col("doc_id"), F.col("ordinal")))
        schema = "doc_id long, ordinal long, shard int, start long, n long"
        return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(_looked_up, schema)

    def read(self, keys: DataFrame, with_ids: bool = False) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) of the keys, read back from the shard files; with_ids: also the ids.

        Every shard is opened by one task, which reads its documents in order of their offsets.
        """
        found = self.lookup(keys)
        shards = max([1, *(s + 1 for s in self.base)])
        dealt = found.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "start")
        schema = "doc_id long, ordinal long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
        return dealt.mapInArrow(_read_back(self.folder, self.base, with_ids), schema)


def _looked_up(keys: pa.Table, index: pa.Table) -> pa.Table:
    ids = keys["doc_id"].fill_null(np.iinfo(np.int64).min).to_numpy()
    hashes = key_hashes(ids, keys["ordinal"].to_numpy())
    entries, at = np.zeros(1, dtype=ENTRY), np.full(len(hashes), -1)
    if index.num_rows:
        entries = np.frombuffer(index["entries"][0].as_py(), dtype=ENTRY)
        at = PerfectHash.load(index["hash"][0].as_py())(hashes)
    known = (at >= 0) & (entries["print"][at] == _fingerprints(hashes))
    hit = entries[at[known]]
    columns = [keys["doc_id"].filter(pa.array(known)), keys["ordinal"].filter(pa.array(known))]
    columns += [pa.array(hit[name].astype(t)) for name, t in (("shard", np.int32), ("start", np.int64), ("n", np.int64))]
    return pa.table(dict(zip(["doc_id", "ordinal", "shard", "start", "n"], columns)))


def _read_back(folder: str, base: dict[int, int], with_ids: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _opened(folder)
        shard, file, kind = None, None, "<u2"
        for batch in slices(batches):
            out = []
            for doc_id, ordinal, at, start, n in zip(*(batch[c].to_pylist() for c in ("doc_id", "ordinal", "shard", "start", "n"))):
                if at != shard:
                    if file is not None:
                        file.close()
                    shard, file = at, system.open_input_file(f"{top}/shard-{at:06d}.bin")
                    magic, width, _ = struct.unpack(HEADER, file.read_at(HEADER_BYTES, 0))
                    if magic != MAGIC:
                        raise ValueError(f"shard {at} of {folder} is no token file")
                    kind = f"<u{width}"
                width = int(kind[-1])
                ids = np.frombuffer(file.read_at(n * width, HEADER_BYTES + start * width), dtype=kind).astype("<u4")
                out.append((doc_id, ordinal, base[at] + start, n, zlib.crc32(ids.tobytes()), *([ids.tolist()] if with_ids else [])))
            names = ["doc_id", "ordinal", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
        if file is not None:
            file.close()

    return rows


def write_tokens(docs: DataFrame, path: str, end_id: int = END_ID, shards: int | None = None, folder: str | None = None, bucket_keys: int = BUCKET_KEYS) -> tuple[TokenFiles, DataFrame]:
    """Encode and write all rows of ``docs``; returns the files and the table of written keys (doc_id, ordinal).

    ``path`` is a byte-level BPE file of the tokenizers library; ids have two bytes if the
    vocabulary allows it. A null text is empty (the end id alone). Rows of equal id follow
    each other by text and are told apart by an ordinal; null ids come first. One shuffle
    deals the texts to their shards; a shard is written under a name of its own and renamed
    when complete, so a repeated task leaves the same file. Only doc_id and text are read.
    """
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    kind = "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
    source = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    cuts = id_ranges(source.select("doc_id"), shards or int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = source.withColumn("shard", range_of(F.col("doc_id"), cuts)).repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "text")
    spark.createDataFrame([(0,)], "format int").write.parquet(f"{folder}/about")  # makes the folder by Spark's own means
    schema = "shard int, doc_id long, ordinal long, start long, n long"
    dealt.select("doc_id", "text").mapInArrow(_written(folder, path, kind, end_id), schema).write.parquet(f"{folder}/written")
    written = spark.read.schema(schema).parquet(f"{folder}/written")
    totals = written.groupBy("shard").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).orderBy("shard").collect()  # one row for each shard
    base, before = {}, 0
    for row in totals:
        base[row["shard"]] = before
        before += row["n"]
    buckets = max(1, -(-sum(r["rows"] for r in totals) // bucket_keys))
    keyed = written.withColumn("bucket", _buckets(buckets)(F.col("doc_id"), F.col("ordinal")))
    keyed.groupBy("bucket").applyInArrow(_bucket_index, "bucket int, hash binary, entries binary").write.parquet(f"{folder}/index")
    return TokenFiles(spark, folder, buckets, base), written.select("doc_id", "ordinal")
