"""Row numbers inside a group that may be very large."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftaudit.sources.shared import materialised

#: Rows that are numbered in one go, about.
BUCKET = 65536
#: Ranges at most; with more rows than these hold, ranges get longer. Spark's sample of keys is 100 for each range then.
MOST_RANGES = 10_000


def ranged(rows: DataFrame, group: str, order: list[str], bucket: int = BUCKET) -> DataFrame:
    """The stored rows with ``_range``, the number of their range in the order of the keys.

    Ranges are cut at quantiles that Spark samples from the keys themselves, group first, so
    far outliers, dense runs and hashed keys make ranges of like size, and a hot group has many.
    """
    parts = max(1, min(MOST_RANGES, -(-rows.count() // bucket)))
    dealt = rows.repartitionByRange(parts, group, *order) if parts > 1 else rows.coalesce(1)
    return materialised(dealt.withColumn("_range", F.spark_partition_id()))


def numbered(rows: DataFrame, group: str, order: str | list[str], name: str, bucket: int = BUCKET) -> DataFrame:
    """Add ``name``: the 1-based place of the row in its group by the columns ``order``.

    A plain window would sort a hot group in one task. Here all rows are cut into ranges of
    about ``bucket`` rows, which are stored; a range is numbered alone and shifted by the sizes
    of the group's ranges before it. Rows of equal keys get places in any order among themselves.
    """
    keys = [order] if isinstance(order, str) else order
    cut = ranged(rows, group, keys, bucket)
    sizes = cut.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        F.col(group).alias("_group"), F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift")
    )
    inside = Window.partitionBy(group, "_range").orderBy(*keys)
    joined = cut.join(shifts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_at")))
    return joined.withColumn(name, (F.row_number().over(inside) + F.col("_shift")).cast("bigint")).drop("_range", "_shift", "_group", "_at")
