"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unrolled(frame: DataFrame, keep: list, values: Column | str, name: str, pos: str = "_pos") -> DataFrame:
    """One row per array element, with its position when ``pos`` is named.

    The outer form is used on purpose: for the inner one the optimizer adds a
    "not empty" filter, pushes it below the projections that build the array,
    and so has a costly array built twice for every page.
    """
    rows = frame.select(*keep, F.posexplode_outer(values).alias(pos, name)).where(F.col(pos).isNotNull())
    return rows.drop("_pos") if pos == "_pos" else rows
