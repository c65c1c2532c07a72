"""Site summaries, insights, comparisons and fallback scores."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftaudit.functions.common import messages, say
from weftaudit.operators.rows import unrolled

#: The facts that site summaries, insights, report heads and answers read; only these need to be stored.
SITE_FACTS = [
    "site", "page_id", "url", "fetched", "image_count", "missing_alt_count", "internal_count", "external_count", "word_count", "h1_count",
    "has_title", "has_meta_description", "semantic_elements", "accessibility", "cms_probable",
]


def site_summary(facts: DataFrame, count_broken: bool = False, include_failed: bool = False) -> DataFrame:
    """Seven figures per site. The platform reports no broken links here, the crawl tool sums them."""
    rows = facts if include_failed else facts.where("fetched")
    broken = F.sum("broken_count") if count_broken else F.lit(0)
    return rows.groupBy("site").agg(
        F.count("*").alias("total_pages_analyzed"),
        F.sum("image_count").alias("total_images"),
        F.sum("missing_alt_count").alias("images_without_alt"),
        F.sum("internal_count").alias("total_internal_links"),
        F.sum("external_count").alias("total_external_links"),
        broken.cast("bigint").alias("broken_links_found"),
        F.floor(F.sum("word_count").cast("double") / F.count("*").cast("double")).cast("bigint").alias("avg_word_count"),
    )


def site_counts(facts: DataFrame, include_failed: bool = False) -> DataFrame:
    """The counts the insight rules read: one pass, partial sums before the shuffle."""
    rows = facts if include_failed else facts.where("fetched")
    broken = F.sum("broken_count") if "broken_count" in facts.columns else F.lit(0)
    return rows.groupBy("site").agg(
        F.count("*").alias("pages"),
        F.count_if(~F.col("has_title")).alias("no_title"),
        F.count_if(~F.col("has_meta_description")).alias("no_description"),
        F.count_if(F.col("h1_count") > 1).alias("many_h1"),
        F.count_if(F.col("h1_count") == 0).alias("no_h1"),
        F.sum("image_count").alias("images"),
        F.sum("missing_alt_count").alias("no_alt"),
        broken.cast("bigint").alias("broken"),
        F.count_if(F.size("semantic_elements") < 3).alias("few_semantic"),
        F.sum("word_count").alias("words"),
        F.sum("external_count").alias("external"),
        F.count_if(F.col("accessibility.score") >= 80).alias("accessible"),
    )


@cache
def _platform_insights() -> tuple[Column, ...]:
    c = F.col
    mean = c("words").cast("double") / c("pages").cast("double")
    whole = F.floor(mean).cast("bigint")
    critical = messages(
        (
            c("no_title") > 0,
            say(c("no_title"), " page(s) missing title tags. Add unique, descriptive titles to all pages."),
        ),
    )
    warnings = messages(
        (
            c("no_description") > 0,
            say(
                c("no_description"),
                " page(s) missing meta descriptions. Add compelling descriptions (150-160 characters).",
            ),
        ),
        (c("many_h1") > 0, say(c("many_h1"), " page(s) have multiple H1 tags. Use only one H1 per page.")),
        (c("no_h1") > 0, say(c("no_h1"), " page(s) missing H1 tags. Add a primary H1 heading to each page.")),
        (
            c("no_alt") > 0,
            say(
                c("no_alt"), " out of ", c("images"),
                " images missing alt text. Add descriptive alt text for accessibility.",
            ),
        ),
    )
    advice = messages(
        (
            mean < 300,
            say("Average page word count is ", whole, ". Consider adding more quality content (aim for 300+ words)."),
        ),
    )
    positive = messages(
        (mean >= 300, say("Good content depth with average ", whole, " words per page.")),
        (
            c("accessible").cast("double") > c("pages").cast("double") * 0.8,
            say(c("accessible"), " out of ", c("pages"), " pages have good accessibility scores."),
        ),
    )
    return (
        critical.alias("critical"), warnings.alias("warnings"), advice.alias("recommendations"), positive.alias("positive"),
    )


@cache
def _crawl_insights() -> tuple[Column, ...]:
    c = F.col
    mean = c("words").cast("double") / c("pages").cast("double")
    whole = F.floor(mean).cast("bigint")
    critical = messages(
        (
            c("no_title") > 0,
            say(c("no_title"), " page(s) missing title tags. Add unique, descriptive titles to all pages."),
        ),
        (
            c("broken") > 0,
            say(
                "Found ", c("broken"),
                " potentially broken link(s). Fix or remove broken links to improve user experience and SEO.",
            ),
        ),
    )
    warnings = messages(
        (
            c("no_description") > 0,
            say(
                c("no_description"),
                " page(s) missing meta descriptions. Add compelling descriptions (150-160 characters) to improve"
                " click-through rates.",
            ),
        ),
        (
            c("many_h1") > 0,
            say(c("many_h1"), " page(s) have multiple H1 tags. Use only one H1 per page for better SEO."),
        ),
        (c("no_h1") > 0, say(c("no_h1"), " page(s) missing H1 tags. Add a primary H1 heading to each page.")),
        (
            c("no_alt") > 0,
            say(
                c("no_alt"), " out of ", c("images"),
                " images missing alt text. Add descriptive alt text for accessibility and SEO.",
            ),
        ),
    )
    advice = messages(
        (
            c("few_semantic") > 0,
            say(
                c("few_semantic"),
                " page(s) use limited semantic HTML5 elements. Use elements like <header>, <nav>, <main>, <article>"
                " for better structure.",
            ),
        ),
        (
            mean < 300,
            say(
                "Average page word count is ", whole,
                ". Consider adding more quality content (aim for 300+ words per page).",
            ),
        ),
        (
            c("external").cast("double") / c("pages").cast("double") < 2,
            "Consider adding more authoritative external links to improve content credibility.",
        ),
    )
    positive = messages((mean >= 300, say("Good content depth with average ", whole, " words per page.")))
    return (
        critical.alias("critical"), warnings.alias("warnings"), advice.alias("recommendations"), positive.alias("positive"),
    )


def site_insights(counts: DataFrame, profile: str = "platform") -> DataFrame:
    """Four message lists per site; at most eight messages, so one row per site is small."""
    lists = _crawl_insights() if profile == "crawl" else _platform_insights()
    return counts.select("site", *lists)


def insight_counts(insights: DataFrame) -> DataFrame:
    return insights.select(
        "site",
        *[
            F.size(k).cast("bigint").alias(f"{k}_count")
            for k in ("critical", "warnings", "recommendations", "positive")
        ],
    )


def suggestion_counts(facts: DataFrame) -> DataFrame:
    """Suggestions per page and priority."""
    return facts.select(
        "site",
        "page_id",
        *[
            F.size(F.filter("suggestions", lambda s: s["priority"] == p)).cast("bigint").alias(p)
            for p in ("critical", "high", "medium")
        ],
    )


def fallback_scores(summary: DataFrame, insights: DataFrame) -> DataFrame:
    """Five whole-number scores per site and their rounded mean, from summary and insights."""
    rows = summary.join(insights, "site", "left")
    n = lambda k: F.greatest(F.size(F.coalesce(k, F.array().cast("array<string>"))), F.lit(0))
    crit, warn, recs = n("critical"), n("warnings"), n("recommendations")
    words = F.col("avg_word_count")
    thin = F.when(words >= 300, 0).otherwise(F.least(F.lit(20), F.floor((300 - words) / 15)))
    images = F.greatest(F.col("total_images"), F.lit(1))
    alt_loss = F.floor(F.col("images_without_alt").cast("double") / images.cast("double") * 45.0)
    parts = {
        "seo": F.greatest(F.lit(0), 100 - crit * 15 - warn * 6 - thin),
        "accessibility": F.greatest(F.lit(0), 100 - alt_loss - F.when(warn > 0, 10).otherwise(0)),
        "content": F.greatest(
            F.lit(0), 100 - F.when(words < 300, 15).otherwise(0) - F.least(F.lit(25), recs * 5)
        ),
        "technical": F.greatest(F.lit(0), 100 - F.col("broken_links_found") * 12 - crit * 8),
        "authority": F.least(F.lit(100), 40 + F.col("total_external_links") * 3),
    }
    scored = rows.select("site", *[v.cast("bigint").alias(k) for k, v in parts.items()])
    total = F.col("seo") + F.col("accessibility") + F.col("content") + F.col("technical") + F.col("authority")
    return scored.select("*", F.rint(total.cast("double") / 5.0).cast("bigint").alias("overall"))


def site_comparison(pages: DataFrame) -> DataFrame:
    """Figures of the first page of each site side by side, ranked by score.

    ``pages`` holds ``seo_score``, ``word_count``, ``missing_alt_count`` and
    ``broken_count`` per page. The rank runs over one row per site.
    """
    first = pages.groupBy("site").agg(
        F.min_by(
            F.struct("url", "seo_score", "word_count", "missing_alt_count", "broken_count"), "page_id"
        ).alias("p")
    ).select("site", "p.*")
    # Rank from the number of sites per score: scores take 101 values, so this
    # table is tiny and no task has to sort all sites.
    per_score = first.groupBy("seo_score").agg(F.count("*").alias("n"))
    above = per_score.withColumn(
        "score_rank",
        F.coalesce(F.sum("n").over(Window.orderBy(F.desc("seo_score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1,
    ).select("seo_score", "score_rank")
    return first.join(F.broadcast(above), "seo_score")


def quality_gate(pages: DataFrame, min_score: int = 70) -> DataFrame:
    """Pass or fail per page with the failed checks in order."""
    failed = messages(
        (F.col("seo_score") < min_score, say("SEO score ", F.col("seo_score"), f" is below minimum {min_score}")),
        (F.col("broken_count") > 0, say(F.col("broken_count"), " broken link(s) found")),
        (F.col("title") == "", "Missing title tag"),
        (F.coalesce("first_description", F.lit("")) == "", "Missing meta description"),
        (F.col("h1_count") == 0, "Missing H1 heading"),
    )
    return pages.select("site", "page_id", failed.alias("failed")).select(
        "*", (F.size("failed") == 0).alias("passed")
    )


def fallback_recommendations(insights: DataFrame) -> DataFrame:
    """Insight texts as rows with priority and category."""
    kinds = [("critical", "critical", "technical"), ("warnings", "high", "seo"), ("recommendations", "medium", "content")]
    tagged = [
        F.transform(
            F.col(source),
            lambda m, i: F.struct(
                F.lit(rank).alias("kind_ord"), i.alias("i"), F.lit(priority).alias("priority"),
                F.lit(category).alias("category"), m.alias("recommendation"),
            ),
        )
        for rank, (source, priority, category) in enumerate(kinds)
    ]
    return insights.transform(unrolled, ["site"], F.concat(*tagged), "r", "ord").select(
        "site", F.col("ord").cast("bigint").alias("ord"), "r.priority", "r.category", "r.recommendation"
    )
