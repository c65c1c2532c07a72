"""Small Column helpers shared by the other builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space: the class works the same way in Java and in RE2.
WS = r"[\s\p{Z}]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A one-element ``transform`` keeps the optimizer from inlining a costly
    expression at each place (or inside each lambda) where it is used.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty(ddl: str) -> Column:
    """An empty array of the given element type."""
    return F.array().cast(f"array<{ddl}>")


def strip(text: Column) -> Column:
    """Remove white space at both ends (Unicode aware)."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def collapse(text: Column) -> Column:
    """Collapse each run of white space to one blank and trim the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WS, " "))


def round2(value: Column) -> Column:
    """Round to two decimals, ties to even."""
    return F.rint(value * 100.0) / 100.0


def fixed(value: Column, digits: int) -> Column:
    """A number with a fixed count of decimals, ties to even (Java alone would round up)."""
    scale = float(10**digits)
    return F.format_string(f"%.{digits}f", F.rint(value * scale) / scale)


def percent0(ratio: Column) -> Column:
    """A ratio as a whole percentage, such as ``45%``."""
    return F.concat(F.rint(ratio * 100.0).cast("bigint").cast("string"), F.lit("%"))


def say(*parts: Column | str) -> Column:
    """Concatenate literals and Columns into one string."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def messages(*rules: tuple[Column, Column | str]) -> Column:
    """Ordered array of the texts whose condition holds."""
    parts = [
        F.when(cond, F.lit(text) if isinstance(text, str) else text) for cond, text in rules
    ]
    return F.array_compact(F.array(*parts))


def points(*rules: tuple[Column, float]) -> Column:
    """Sum of the points whose condition holds."""
    total = F.lit(0.0)
    for cond, value in rules:
        total = total + F.when(cond, F.lit(float(value))).otherwise(F.lit(0.0))
    return total
