"""Exact dedup over an extendible-hash index on shared files, in DataFrame functions only.

A text's key is the 64-bit hash of the text with A-Z in lower case. The index is a table in
the shared folder whose partition folders are buckets; a directory maps the first ``depth``
bits of a key to a bucket, which knows how many of these bits are its own. A bucket of more
than ``capacity`` keys is split by its next bits: its rows are written into the folders of
its children, and the directory doubles when the bucket already used all of its bits. Rows
of a bucket that the directory no longer names are dead. Further batches are added as further
files of the buckets.

A bucket is a range of keys, and one task owns it: it puts the rows of a key together, from
all files of the bucket, and finds the chains, the keys that several documents hold. The
texts of chains are then compared byte by byte, as strings: equal ones are one group, others
that only share the key stay apart. A group of copies of any size is counted before it is
shuffled, in every step.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftaudit.sources.shared import fresh_path, materialised

#: Keys (distinct texts) of a bucket before it is split.
CAPACITY = 100_000
#: Bits of a key that a directory uses at most; a bucket that is still overfull keeps its rows.
MAX_DEPTH = 24
#: Keys (8 bytes each) or directory slots that are sent to every task at most; beyond, joins shuffle.
BROADCAST_KEYS = 500_000
#: Groups of copies (some 150 bytes each) that are sent to every task at most.
BROADCAST_GROUPS = 100_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENTRY = "doc_id long, row long, h long, sha string"
KEPT = "struct<doc_id:bigint,row:bigint>"
SEGMENT = f"h long, sha string, size long, keep {KEPT}, segment int, bucket string"


def normalised(text: Column) -> Column:
    """The text with A-Z, and nothing else, in lower case; null as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())


def text_key(text: Column, key_bits: int = 64) -> Column:
    """The first ``key_bits`` bits of the 64-bit hash of a text, the others 0 (fewer bits make collisions, for tests)."""
    return F.xxhash64(text).bitwiseAND(F.lit(-1 << (64 - key_bits)).cast("long"))


def _sized(small: DataFrame, most: int) -> DataFrame:
    """A stored table with the hint to broadcast it if it has ``most`` rows or fewer, else to merge-join it."""
    return small.hint("broadcast" if small.count() <= most else "merge")


class ExtendibleIndex:
    """Keys of documents in buckets of bounded size. Rows are (h, sha, size, keep), keep being (doc_id, row)."""

    def __init__(self, spark: SparkSession, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> None:
        self.spark, self.capacity, self.max_depth = spark, capacity, max_depth
        self.folder = fresh_path(spark, "extendible")
        self.depth, self.segments, self.versions = 0, 0, 0
        self.directory = self._stored_directory(spark.createDataFrame([(0, "b", 0)], "slot long, bucket string, own int"))

    def _stored_directory(self, rows: DataFrame) -> DataFrame:
        path = f"{self.folder}/directory/version-{self.versions}"
        rows.write.parquet(path)
        self.versions += 1
        return self.spark.read.schema("slot long, bucket string, own int").parquet(path)

    def placed(self, keys: DataFrame) -> DataFrame:
        """``keys`` with the bucket that the directory names for their h."""
        slot = F.shiftrightunsigned("h", 64 - self.depth) if self.depth else F.lit(0).cast("long")
        way = "broadcast" if 1 << self.depth <= BROADCAST_KEYS else "merge"
        slots = self.directory.select("slot", "bucket").hint(way)
        return keys.withColumn("slot", slot).join(slots, "slot").drop("slot")

    def buckets(self) -> DataFrame:
        return self.directory.select("bucket", "own").distinct()

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(SEGMENT).parquet(f"{self.folder}/rows").drop("segment")

    def rows(self) -> DataFrame:
        """The live rows of all files: those in buckets that the directory names."""
        live = self.buckets().select("bucket").hint("broadcast" if 1 << self.depth <= BROADCAST_KEYS else "merge")
        return self._stored().join(live, "bucket", "left_semi")

    def _split(self, sizes: DataFrame) -> bool:
        """Split the overfull ones of ``sizes`` (bucket, keys, low, high); False if there are none.

        A bucket is split by as many bits at once as its size asks for. The slots of the
        directory double until the deepest bucket finds its bits in them.
        """
        many = (F.col("keys") > self.capacity) & (F.col("low") != F.col("high"))
        asked = F.greatest(F.lit(1), F.ceil(F.log2(F.col("keys") / F.lit(self.capacity))).cast("int"))
        over = self.buckets().join(sizes.where(many).select("bucket", asked.alias("more")), "bucket").where(F.col("own") < self.max_depth)
        over = materialised(over.select("bucket", F.least(F.col("own") + F.col("more"), F.lit(self.max_depth)).alias("deeper")))
        deepest = over.agg(F.max("deeper").alias("d")).first()["d"]
        if deepest is None:
            return False
        doubled = max(0, deepest - self.depth)
        self.depth += doubled
        slots = self.directory.withColumn("slot", F.explode(F.expr(f"sequence(slot << {doubled}, (slot << {doubled}) + {(1 << doubled) - 1})")))
        bits = F.lpad(F.bin("slot"), self.depth, "0")
        deeper = slots.join(_sized(over, BROADCAST_KEYS), "bucket", "left").withColumn("own", F.coalesce("deeper", "own"))
        child = F.concat(F.lit("b"), bits.substr(F.lit(1), F.col("own")))
        self.directory = self._stored_directory(deeper.select("slot", F.when(F.col("deeper").isNull(), F.col("bucket")).otherwise(child).alias("bucket"), "own"))
        return True

    def add(self, keys: DataFrame) -> None:
        """Add stored keys (h, sha, size, keep), one row for each h and sha, splitting buckets until all of them fit."""
        hashes, before = keys.select("h"), self.buckets().select("bucket")
        if self.segments:
            hashes = hashes.unionByName(self.rows().select("h"))
            before = materialised(before)
        sizes = lambda: self.placed(hashes).groupBy("bucket").agg(F.count("*").alias("keys"), F.min("h").alias("low"), F.max("h").alias("high"))
        columns = ["h", "sha", "size", "keep"]
        old = self.rows().select("bucket", *columns) if self.segments else None
        while self._split(sizes()):
            pass
        rows = keys.select(*columns)
        if old is not None:  # the rows of buckets that are gone move to their children
            moved = old.join(self.buckets().select("bucket"), "bucket", "left_anti").select(*columns)
            rows = rows.unionByName(moved)
        owned = self.placed(rows).repartition("bucket").sortWithinPartitions("bucket", "h")
        owned.write.partitionBy("bucket").parquet(f"{self.folder}/rows/segment={self.segments}")
        self.segments += 1

    def entries(self) -> DataFrame:
        """(bucket, h, sha, size, keep), one row for each h and sha; the owner of a bucket merges its files."""
        owned = self.rows().repartition("bucket")
        return owned.groupBy("bucket", "h", "sha").agg(F.sum("size").alias("size"), F.max("keep").alias("keep"))

    def chains(self) -> DataFrame:
        """The keys that several documents hold, found by the owners of their buckets."""
        owned = self.rows().repartition("bucket")
        return owned.groupBy("bucket", "h").agg(F.sum("size").alias("size")).where("size > 1").select("bucket", "h")


def _checked_groups(compared: DataFrame, entries: DataFrame) -> DataFrame:
    """(h, sha, size, keep) of the texts that several documents hold.

    ``compared`` has a row (h, sha, n) for each text of a chain. Inside a chain the digest
    names the text, which is checked here and not assumed.
    """
    texts = compared.groupBy("h", "sha").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
    both = texts.join(entries, ["h", "sha"])
    same = (F.col("texts") == 1) & (F.col("n") == F.col("size"))
    size = F.when(same, F.col("size")).otherwise(F.raise_error(F.lit("two texts of one digest, or documents that changed meanwhile")))
    return both.withColumn("size", size).where("size > 1").select("h", "sha", "size", "keep")


def find_copies(
    docs: DataFrame, capacity: int = CAPACITY, batches: int = 1, key_bits: int = 64, broadcast_keys: int = BROADCAST_KEYS,
    broadcast_groups: int = BROADCAST_GROUPS, row: str | None = None,
) -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs`` (doc_id, text).

    Texts are equal if they are the same after A-Z are lower-cased. Of equal texts the row
    with the largest doc_id stays; a null id ranks below all others. Of repeated rows of that id one
    stays (the last one read). A null text counts as empty, and the empty texts are a group
    like any other. Texts are compared whole, however long they are. An empty table gives no
    rows. Other columns are not read. ``row`` names a column that numbers the rows; without it
    rows are numbered here. ``batches`` adds the keys in so many parts.

    The texts of chains are found by a broadcast of their keys if these are few enough
    (counted first); otherwise all texts are compared, with the same result.
    """
    number = F.col(row) if row else F.monotonically_increasing_id()
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), number.alias("row"), normalised(F.col("text")).alias("text"))
    keyed = read.withColumn("h", text_key(F.col("text"), key_bits))
    entries = materialised(keyed.select("doc_id", "row", "h", F.sha2("text", 256).alias("sha")))
    index = ExtendibleIndex(docs.sparkSession, capacity)
    keep = F.max(F.struct("doc_id", "row")).alias("keep")
    for part in range(batches):
        some = entries.where(F.pmod("row", F.lit(batches)) == part) if batches > 1 else entries
        index.add(materialised(some.groupBy("h", "sha").agg(F.count("*").alias("size"), keep)))

    chains = materialised(index.chains())
    few = chains.count() <= broadcast_keys
    texts = keyed.join(F.broadcast(chains.select("h")), "h", "left_semi") if few else keyed
    compared = texts.groupBy("h", "text").agg(F.count("*").alias("n")).select("h", F.sha2("text", 256).alias("sha"), "n")
    groups = materialised(_checked_groups(compared, index.entries().select("h", "sha", "size", "keep")))
    found = entries.join(_sized(groups, broadcast_groups), ["h", "sha"], "left")
    single = F.col("size").isNull()
    return found.select(
        "row", "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("row") == F.col("keep.row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stay, with all of their columns. The numbered rows are stored once."""
    row = f"row_{uuid.uuid4().hex}"
    numbered = materialised(docs.withColumn(row, F.monotonically_increasing_id()))
    gone = find_copies(numbered, row=row, **how).where(~F.col("kept")).select(F.col("row").alias(row))
    return numbered.join(_sized(materialised(gone), BROADCAST_KEYS), row, "left_anti").drop(row)
