"""A stored index of address parts, by which pages are found without scanning all addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters of a part.
GRAM = 3
#: Folders into which parts, and pages, are hashed.
FOLDERS = 128
#: Parts of a wanted text that are looked up: the rarest ones.
LOOKED_UP = 3

PARTS = "part string, page_id bigint, folder int"
COUNTS = "part string, pages bigint, folder int"
PAGES = "page_id bigint, site string, url string, folder int"


def _folder(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FOLDERS)).cast("int")


class AddressIndex:
    """Parts of ``GRAM`` letters of every address, how many pages hold each, and the addresses, each in hashed folders.

    A lookup asks the counts for the rarest parts of the wanted text, reads only the rows of these parts,
    and compares only the addresses of pages that hold all of them.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, pages: DataFrame) -> None:
        """Store the addresses of pages (page_id, site, url); pages of earlier calls stay. ``pages`` should be a stored table."""
        known = pages.where(F.col("url").isNotNull()).select("page_id", "site", "url")
        last = F.length("url") - (GRAM - 1)
        grams = F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring("url", i, GRAM))))
        parts = known.select(F.explode(grams).alias("part"), "page_id")
        counts = parts.groupBy("part").agg(F.count("*").alias("pages"))
        for rows, key, name in ((parts, "part", "parts"), (counts, "part", "counts"), (known, "page_id", "pages")):
            stored = rows.withColumn("folder", _folder(F.col(key))).hint("rebalance", "folder")
            stored.sortWithinPartitions("folder", key).write.mode("append").partitionBy("folder").parquet(f"{self.path}/{name}")

    def _rows(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _of_part(self, rows: DataFrame, part: str) -> DataFrame:
        return rows.where((F.col("folder") == _folder(F.lit(part))) & (F.col("part") == part))

    def rarest(self, wanted: str) -> list[str] | None:
        """The parts of a text that the fewest pages hold; None if it is too short to have parts, and [] if no page can hold it."""
        grams = sorted({wanted[i : i + GRAM] for i in range(len(wanted) - GRAM + 1)})
        if not grams:
            return None
        counts = self._rows("counts", COUNTS)
        asked = [self._of_part(counts, g) for g in grams]
        both = asked[0]
        for more in asked[1:]:
            both = both.unionByName(more)
        pages = {r["part"]: r["n"] for r in both.groupBy("part").agg(F.sum("pages").alias("n")).collect()}
        return sorted(grams, key=pages.__getitem__)[:LOOKED_UP] if len(pages) == len(grams) else []

    def holding(self, wanted: str) -> DataFrame:
        """(page_id, site, url) of the pages whose address contains ``wanted``."""
        pages = self._rows("pages", PAGES)
        grams = self.rarest(wanted)
        if grams is not None:
            if not grams:
                return pages.where("false").drop("folder")
            parts = self._rows("parts", PARTS)
            found = self._of_part(parts, grams[0]).select("page_id").distinct()
            for gram in grams[1:]:
                found = found.join(self._of_part(parts, gram).select("page_id"), "page_id", "left_semi")
            pages = pages.join(found.withColumn("folder", _folder(F.col("page_id"))), ["folder", "page_id"], "left_semi")
        return pages.where(F.col("url").contains(wanted)).drop("folder")

    def first_of_sites(self, wanted: str) -> DataFrame:
        """(site, page_id) of the first page of each site whose address contains ``wanted``."""
        return self.holding(wanted).groupBy("site").agg(F.min("page_id").alias("page_id"))
