"""Platform (CMS) detection as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Per platform the generator pattern, script paths and class marks, in listing order.
CMS_PATTERNS = [
    ("wordpress", r"WordPress", ["/wp-content/", "/wp-includes/"], ["wp-", "wordpress"]),
    ("squarespace", r"Squarespace", ["/universal/scripts-compressed/"], ["sqs-", "squarespace"]),
    ("wix", r"Wix\.com", ["parastorage.com", "wixstatic.com"], ["wix-"]),
    ("shopify", r"Shopify", ["/cdn.shopify.com"], ["shopify-"]),
    ("joomla", r"Joomla", ["/media/system/js/"], ["joomla"]),
    ("drupal", r"Drupal", ["/misc/drupal.js"], ["drupal"]),
]


def platform_scores(generator: Column, script_sources: Column, html: Column) -> Column:
    """``array<struct<cms, score>>`` with a positive score, in listing order.

    Generator tag 3, script address 2, class mark in the raw page 1.
    """
    cells = []
    for name, pattern, script_parts, class_parts in CMS_PATTERNS:
        by_script = F.exists(script_sources, lambda s: _any_part(s, script_parts))
        score = (
            F.when(F.coalesce(generator, F.lit("")).rlike("(?i)" + pattern), 3).otherwise(0)
            + F.when(by_script, 2).otherwise(0)
            + F.when(_any_part(html, class_parts), 1).otherwise(0)
        )
        cells.append(F.struct(F.lit(name).alias("cms"), score.cast("bigint").alias("score")))
    return F.filter(F.array(*cells), lambda c: c["score"] > 0)


def _any_part(text: Column, needles: list[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


def probable(scores: Column) -> Column:
    """Highest score; the first listed platform wins a tie; null when none scored."""
    best = F.array_max(F.transform(scores, lambda c: c["score"]))
    return F.get(F.filter(scores, lambda c: c["score"] == best), F.lit(0))["cms"]


def detected(scores: Column) -> Column:
    """Platforms with three points or more."""
    return F.transform(F.filter(scores, lambda c: c["score"] >= 3), lambda c: c["cms"])
