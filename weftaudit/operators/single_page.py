"""The single-page profile: its own checks, keyword rules and 0-100 score."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftaudit.functions import html, text, urls
from weftaudit.functions.common import bind, fixed, messages, say
from weftaudit.operators.facts import present_levels, tokenised
from weftaudit.operators.rows import unrolled

# Closing lines of the single-page recommendations.
GENERAL_ADVICE = [
    "Ensure all pages have unique, descriptive title tags (50-60 characters).",
    "Use semantic HTML5 elements (header, nav, main, footer) for better structure.",
    "Maintain a clear heading hierarchy (H1-H6) without skipping levels.",
    "Optimize images with compression and appropriate formats (WebP when possible).",
    "Implement internal linking strategy to improve site navigation and SEO.",
]


def heading_issues(counts: Column) -> Column:
    """Missing or repeated H1 and gaps between the levels that occur."""
    h1 = F.get(counts, F.lit(0))
    first = messages(
        (h1 == 0, "Missing H1 heading"),
        (h1 > 1, say("Multiple H1 headings found (", h1, ")")),
    )
    gaps = bind(
        present_levels(counts),
        lambda lv: F.array_compact(
            F.transform(
                lv,
                lambda x, i: F.when(
                    F.get(lv, i + 1) - x > 1, say("Heading hierarchy skip: H", x, " to H", F.get(lv, i + 1))
                ),
            )
        ),
    )
    return F.concat(first, gaps)


def image_placement(parent: Column) -> Column:
    return (
        F.when(parent.isin("header", "nav"), F.lit("header"))
        .when(parent.isin("footer", "aside", "section"), parent)
        .otherwise(F.lit("body"))
    )


def seo_issues(found: Column, title: Column, description: Column) -> Column:
    """Title and description length issues; a null description means no tag."""
    n, d = F.length(title), F.length(description)
    return messages(
        (~found, "Missing title tag"),
        (found & (n == 0), "Empty title tag"),
        (found & n.between(1, 29), "Title tag too short (< 30 characters)"),
        (found & (n > 60), "Title tag too long (> 60 characters)"),
        (description.isNull(), "Missing meta description"),
        (d == 0, "Empty meta description"),
        (d.between(1, 119), "Meta description too short (< 120 characters)"),
        (d > 160, "Meta description too long (> 160 characters)"),
    )


def layout_issues(structure: Column) -> Column:
    return messages(
        *[(~structure[f"has_{t}"], f"Missing <{t}> element") for t in ("header", "nav", "main", "footer")]
    )


def plain_links(anchors: Column, host: Column) -> Column:
    """Anchors whose resolved address is http or https, with the internal flag."""
    return F.transform(
        F.filter(anchors, lambda a: urls.scheme(a["absolute_url"]).isin("http", "https")),
        lambda a: F.struct(
            a["pos"].alias("pos"),
            a["absolute_url"].alias("url"),
            a["text"].alias("text"),
            (a["text"] != "").alias("has_text"),
            urls.is_internal(a["absolute_url"], host).alias("internal"),
        ),
    )


@cache
def _body_columns() -> tuple[Column, ...]:
    toks = F.col("toks")
    return (
        html.text_outside(toks, ["nav", "footer", "header"]).alias("body_text"),
    )


def body_text(pages: DataFrame) -> DataFrame:
    """Page text without navigation, header and footer."""
    kept = [c for c in pages.columns if c != "html"]
    return tokenised(pages).select(*kept, *_body_columns())


@cache
def _keyword_columns() -> tuple[Column, ...]:
    return (
        F.size("plain").cast("bigint").alias("plain_word_count"),
        text.plain_keywords(F.col("plain")).alias("plain_keywords"),
    )


def body_keywords(pages: DataFrame) -> DataFrame:
    """Plain words of the body: count and the 20 most frequent with density."""
    body = body_text(pages)
    kept = [c for c in body.columns if c != "body_text"]
    return body.select(
        *kept, text.plain_keyword_tokens(text.words(F.col("body_text"))).alias("plain")
    ).select(*kept, *_keyword_columns())


def seo_score() -> Column:
    """100 minus penalties; reads facts columns and ``broken_count``."""
    title_n, desc_n = F.col("title_length"), F.length("first_description")
    described = F.coalesce("first_description", F.lit("")) != ""
    alt_ratio = (F.col("image_count") - F.col("missing_alt_count")).cast("double") / F.col("image_count")
    lost = (
        F.when(F.col("title") == "", 15).when((title_n < 30) | (title_n > 60), 5).otherwise(0)
        + F.when(~described, 15).when((desc_n < 120) | (desc_n > 160), 5).otherwise(0)
        + F.when(F.col("h1_count") == 0, 10).when(F.col("h1_count") > 1, 5).otherwise(0)
        + F.when(F.col("image_count") == 0, 0).when(alt_ratio < 0.5, 10).when(alt_ratio < 0.8, 5).otherwise(0)
        + F.least(F.col("broken_count") * 5, F.lit(20))
        + F.when(F.col("structure.has_main"), 0).otherwise(5)
    )
    return F.greatest(F.lit(0), 100 - lost).cast("bigint")


def heading_table(facts: DataFrame) -> DataFrame:
    """One row per heading."""
    return facts.transform(unrolled, ["page_id"], "headings", "h").select("page_id", "h.*")


def site_advice(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Recommendation lines per group of pages; failed pages only count as pages."""
    ok = F.col("fetched")
    agg = facts.groupBy(*keys).agg(
        F.count_if(ok & (F.col("h1_count") == 0)).alias("no_h1"),
        F.count_if(ok & (F.col("h1_count") > 1)).alias("many_h1"),
        F.sum(F.when(ok, F.col("image_count")).otherwise(0)).alias("images"),
        F.sum(F.when(ok, F.col("missing_alt_count")).otherwise(0)).alias("no_alt"),
        F.sum(F.when(ok, F.col("broken_count")).otherwise(0)).alias("broken"),
        F.count_if(ok & F.col("first_description").isNull()).alias("no_description"),
    )
    share = fixed(F.col("no_alt").cast("double") / F.col("images") * 100.0, 1)
    lines = messages(
        (F.col("no_h1") > 0, say("Add H1 headings to ", F.col("no_h1"), " page(s) for better SEO and accessibility.")),
        (F.col("many_h1") > 0, say("Reduce to one H1 heading per page on ", F.col("many_h1"), " page(s).")),
        (
            F.col("no_alt") > 0,
            say("Add alt text to ", F.col("no_alt"), " images (", share, "% of total) for accessibility and SEO."),
        ),
        (
            F.col("broken") > 0,
            say("Fix ", F.col("broken"), " broken link(s) to improve user experience and SEO."),
        ),
        (
            F.col("no_description") > 0,
            say(
                "Add meta descriptions to ",
                F.col("no_description"),
                " page(s) to improve search result click-through rates.",
            ),
        ),
    )
    return agg.select(*keys, F.concat(lines, F.array(*[F.lit(a) for a in GENERAL_ADVICE])).alias("lines"))


