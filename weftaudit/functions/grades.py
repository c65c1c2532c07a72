"""Score arithmetic as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftaudit.functions.common import round2

# Pillar weights, grade and label steps.
PILLAR_WEIGHTS = {
    "on_page_seo": 0.25,
    "content_quality": 0.20,
    "technical_seo": 0.20,
    "authority": 0.15,
    "ux_design": 0.10,
    "links_architecture": 0.10,
}
GRADES = [(90, "A"), (80, "B"), (70, "C"), (60, "D")]
LABELS = [(90, "Excellent"), (80, "Good"), (70, "Fair"), (60, "Needs Work")]
LOWEST_GRADE, LOWEST_LABEL = "F", "Critical"


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))


def _step(score: Column, steps: list[tuple[int, str]], lowest: str) -> Column:
    out = F.lit(lowest)
    for least, name in reversed(steps):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out


def grade(score: Column) -> Column:
    return _step(clamp(score), GRADES, LOWEST_GRADE)


def label(score: Column) -> Column:
    return _step(clamp(score), LABELS, LOWEST_LABEL)


def normalised(raw: Column, most: float) -> Column:
    """Points as a percentage of the maximum, clamped, two decimals."""
    return round2(clamp(raw / F.lit(float(most)) * 100.0))


def pillar(raw: Column, most: float, issues: Column, passed: Column) -> Column:
    """``struct<score, grade, issues, passed>``."""
    score = normalised(raw, most)
    return F.struct(
        score.alias("score"),
        grade(score).alias("grade"),
        F.array_distinct(issues).alias("issues"),
        F.array_distinct(passed).alias("passed"),
    )


def weighted(scores: dict[str, Column]) -> Column:
    """Weighted overall score."""
    total = F.lit(0.0)
    for name, weight in PILLAR_WEIGHTS.items():
        total = total + clamp(scores[name]) * F.lit(weight)
    return round2(clamp(total))


def cents(score: Column) -> Column:
    """A two-decimal score as a whole number, so that sums do not depend on row order."""
    return F.rint(score * 100.0).cast("bigint")


def mean_of_cents(total: Column, n: Column) -> Column:
    return total.cast("double") / n.cast("double") / 100.0
