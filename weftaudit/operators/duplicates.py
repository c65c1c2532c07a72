"""Pages or documents of a group that open with the same text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def opening_counts(rows: DataFrame, group: str, mark: str) -> DataFrame:
    """Rows per group and opening fingerprint (partial counts before the shuffle)."""
    return rows.groupBy(group, mark).agg(F.count("*").alias("n"))


def with_duplicate_flag(rows: DataFrame, group: str, mark: str) -> DataFrame:
    """Add ``duplicated``. Only repeated openings are joined back; the join is plain, so adaptive execution splits the rows of a hot one."""
    repeated = opening_counts(rows, group, mark).where("n > 1").select(
        group, mark, F.lit(True).alias("duplicated")
    )
    out = rows.join(repeated, [group, mark], "left")
    # Empty openings are left out here: a filter before the grouping would be pushed
    # down and have the fingerprint computed twice.
    return out.withColumn("duplicated", F.coalesce("duplicated", F.lit(False)) & (F.col(mark) != ""))
