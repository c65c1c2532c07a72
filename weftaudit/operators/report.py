"""Reports as data: one bounded row per site, one row per page section.

The head of a report (figures and at most a dozen messages) is one row per
site. Page sections stay one row per page with their number, so that a site of
any size is written in parallel; sorted by number they follow the head.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftaudit.functions.common import say
from weftaudit.operators.numbering import numbered

KINDS = ["critical", "warnings", "recommendations", "positive"]
RULER, DASHES = "=" * 70, "-" * 70

# Section heads of the text and HTML reports.
TEXT_HEADS = {
    "critical": "🔴 CRITICAL ISSUES", "warnings": "⚠️  WARNINGS", "recommendations": "💡 RECOMMENDATIONS",
    "positive": "✅ POSITIVE FINDINGS",
}
HTML_HEADS = {
    "critical": "🔴 Critical Issues", "warnings": "⚠️ Warnings", "recommendations": "💡 Recommendations",
    "positive": "✅ Positive Findings",
}
HTML_ITEM_CLASS = {
    "critical": "critical", "warnings": "warning", "recommendations": "recommendation", "positive": "positive",
}
TEXT_STATS = [
    ("Pages Analyzed:         ", "total_pages_analyzed"), ("Total Images:           ", "total_images"),
    ("Images w/o Alt Text:    ", "images_without_alt"), ("Internal Links:         ", "total_internal_links"),
    ("External Links:         ", "total_external_links"), ("Broken Links Found:     ", "broken_links_found"),
    ("Average Word Count:     ", "avg_word_count"),
]
HTML_STATS = [
    ("Pages Analyzed", "total_pages_analyzed"), ("Total Images", "total_images"), ("Images w/o Alt", "images_without_alt"),
    ("Internal Links", "total_internal_links"), ("External Links", "total_external_links"),
    ("Broken Links", "broken_links_found"), ("Avg Word Count", "avg_word_count"),
]
# How many messages of each kind lead a summary, with their tags.
LEADING = [("critical", 3, "[CRITICAL] ", "🔴 Critical:"), ("warnings", 2, "[WARNING] ", "⚠️ Warning:"),
           ("recommendations", 2, "[RECOMMENDATION] ", "💡 Recommendation:")]


def assembled(summary: DataFrame, insights: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata, summary and insights of each site in one row."""
    return metadata.join(summary, "site", "left").join(insights, "site", "left")


def metadata(facts: DataFrame) -> DataFrame:
    """Address, domain and page count of each site."""
    return facts.groupBy("site").agg(
        F.min_by("url", "page_id").alias("base_url"),
        F.col("site").alias("domain"),
        F.count("*").alias("pages_crawled"),
    )


def _size(kind: str) -> Column:
    return F.greatest(F.size(F.col(kind)), F.lit(0))


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _numbered_list(items: Column, tag: str = "") -> Column:
    return F.transform(items, lambda m, i: F.concat((i + 1).cast("string"), F.lit(f". {tag}"), m))


# The texts between the figures.
@cache
def executive_summary() -> Column:
    """Counts and the leading messages, numbered through."""
    lead = F.concat(
        *[F.transform(F.slice(k, 1, n), lambda m: F.concat(F.lit(tag), m)) for k, n, tag, _ in LEADING]
    )
    items = F.when(F.size(lead) > 0, F.array_join(_numbered_list(lead), "\n")).otherwise(
        F.lit("✓ No critical issues found - site is in good health!")
    )
    return _lines(
        "SITE HEALTH OVERVIEW", DASHES, say("Total Issues Found: ", _size("critical") + _size("warnings")),
        say("  - Critical: ", _size("critical")), say("  - Warnings: ", _size("warnings")),
        say("  - Recommendations: ", _size("recommendations")), say("  - Positive Findings: ", _size("positive")),
        "", "TOP PRIORITY ACTION ITEMS", DASHES, items,
    )


# The texts between the figures.
@cache
def text_report() -> Column:
    """The plain-text report of a site without its page sections."""
    stats = _lines(*[say(name, F.col(c)) for name, c in TEXT_STATS])
    groups = [
        F.when(
            _size(k) > 0,
            F.concat(F.lit(f"{TEXT_HEADS[k]}\n{DASHES}\n"), F.array_join(_numbered_list(F.col(k)), "\n"), F.lit("\n")),
        )
        for k in KINDS
    ]
    found = F.array_compact(F.array(*groups))
    details = F.when(F.size(found) > 0, F.array_join(found, "\n")).otherwise(F.lit("No insights generated."))
    head = lambda title: [RULER, title, RULER, ""]
    return _lines(
        *head("WEBSITE ANALYSIS REPORT"), say("Domain: ", F.col("domain")), say("URL: ", F.col("base_url")),
        say("Analysis Date: ", F.col("analysis_date")), say("Pages Crawled: ", F.col("pages_crawled")), "",
        *head("EXECUTIVE SUMMARY"), executive_summary(), "", *head("KEY STATISTICS"), stats, "",
        *head("DETAILED INSIGHTS"), details, "", RULER, "END OF REPORT", RULER,
    )


# The texts between the figures.
@cache
def email_summary() -> Column:
    """A short message: counts and up to three critical issues and warnings."""

    def group(kind: str, title: str) -> Column:
        items = F.transform(F.slice(kind, 1, 3), lambda m: F.concat(F.lit("  • "), m))
        return F.when(_size(kind) > 0, F.concat(F.lit(f"{title}\n"), F.array_join(items, "\n"), F.lit("\n")))

    return _lines(
        say("Website Analysis Complete: ", F.col("domain")), "", "Quick Summary:",
        say("- ", F.col("total_pages_analyzed"), " pages analyzed"), say("- ", _size("critical"), " critical issues"),
        say("- ", _size("warnings"), " warnings"), "", group("critical", "Top Critical Issues:"),
        group("warnings", "Top Warnings:"), "View the full report for detailed analysis and recommendations.",
    )


def _priority_count(priority: str) -> Column:
    return F.size(F.filter("suggestions", lambda s: s["priority"] == priority))


# The texts between the figures.
@cache
def _text_section() -> Column:
    url = F.when(F.length("url") <= 65, F.col("url")).otherwise(F.concat(F.substring("url", 1, 62), F.lit("...")))
    crit, high = _priority_count("critical"), _priority_count("high")
    issues = F.when(
        (crit > 0) | (high > 0), say("  Issues: ", crit, " critical, ", high, " high priority")
    ).otherwise(F.lit("  Issues: None"))
    return _lines(
        say("Page ", F.col("number"), ": ", url), say("  Status: ", F.col("status_code")),
        say("  Title: ", F.substring("title", 1, 60)), say("  Word Count: ", F.col("word_count")), issues, "",
    )


#: The facts that page sections read; only these need to be stored.
TEXT_FACTS = ["site", "page_id", "url", "status_code", "title", "word_count", "suggestions"]
HTML_FACTS = [*TEXT_FACTS, "title_length", "title_optimal", "meta_description", "meta_description_length", "description_optimal", "cms_detected"]


def text_sections(facts: DataFrame) -> DataFrame:
    """Page summaries of the text report, one row per page with its number. ``facts`` should be a stored table of ``TEXT_FACTS``."""
    return numbered(facts, "site", "page_id", "number").select(
        "site", "number", "page_id", _text_section().alias("section")
    )


def escape(value: Column) -> Column:
    """Text made safe for HTML."""
    out = value
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


# The texts between the figures.
@cache
def html_report() -> Column:
    """The HTML report of a site up to its page sections; ``html_end`` closes it."""
    lead = F.concat(
        *[
            F.transform(
                F.slice(k, 1, n), lambda m: say(f"<li><strong>{tag}</strong> ", escape(m), "</li>")
            )
            for k, n, _, tag in LEADING
        ]
    )
    items = F.when(F.size(lead) > 0, F.array_join(lead, "")).otherwise(F.lit("<li>No issues found - great job!</li>"))
    cards = F.concat(
        *[
            say('<div class="stat-card"><div class="stat-value">', F.col(c), f'</div><div class="stat-label">{name}</div></div>')
            for name, c in HTML_STATS
        ]
    )
    groups = [
        F.when(
            _size(k) > 0,
            F.concat(
                F.lit(f'<div class="insight-group"><h3>{HTML_HEADS[k]}</h3>'),
                F.array_join(
                    F.transform(
                        F.col(k),
                        lambda m: say(f'<div class="insight-item {HTML_ITEM_CLASS[k]}">', escape(m), "</div>"),
                    ),
                    "",
                ),
                F.lit("</div>"),
            ),
        ).otherwise(F.lit(""))
        for k in KINDS
    ]
    domain = escape(F.col("domain"))
    return _lines(
        '<!DOCTYPE html>', '<html lang="en">', "<head>", '<meta charset="UTF-8">',
        '<meta name="viewport" content="width=device-width, initial-scale=1.0">',
        say("<title>Website Analysis Report - ", domain, "</title>"), "</head>", "<body>",
        say(
            '<div class="header"><h1>Website Analysis Report</h1><div class="subtitle">', domain, "</div><div>URL: ",
            escape(F.col("base_url")), "</div><div>Analysis Date: ", F.col("analysis_date"), "</div><div>Pages Crawled: ",
            F.col("pages_crawled"), "</div></div>",
        ),
        say('<div class="summary-box"><h2>Executive Summary</h2><h3>Prioritized Action Items</h3><ul>', items, "</ul></div>"),
        say('<div class="summary-box"><h2>Key Statistics</h2><div class="stats-grid">', cards, "</div></div>"),
        F.concat(F.lit('<div class="insights-section"><h2>Detailed Insights</h2>'), *groups, F.lit("</div>")),
    )


def html_end() -> str:
    return "</body>\n</html>"


# The texts between the figures.
@cache
def _html_section() -> Column:
    first = F.get("cms_detected", F.lit(0))
    badge = F.when(
        first.isNotNull(), say('<span class="cms-badge">', F.initcap(first), " Detected</span>")
    ).otherwise(F.lit(""))
    mark = lambda c: F.when(F.col(c), "✅").otherwise("⚠️")
    cell = lambda name, value: say(
        f'<div class="metadata-item"><div class="metadata-label">{name}</div><div class="metadata-value">', value, "</div></div>"
    )
    cards = F.concat(
        cell("Title", escape(F.col("title"))),
        cell("Title Length", say(F.col("title_length"), " chars ", mark("title_optimal"))),
        cell("Meta Description", escape(F.substring("meta_description", 1, 100))),
        cell("Description Length", say(F.col("meta_description_length"), " chars ", mark("description_optimal"))),
        cell("Word Count", F.col("word_count")),
    )
    advice = F.transform(
        "suggestions",
        lambda s: say(
            '<div class="insight-item ', s["priority"], '"><strong>', escape(s["issue"]), '</strong><span class="priority-badge priority-',
            s["priority"], '">', F.upper(s["priority"]), "</span><div>", escape(s["suggestion"]), "</div><div>",
            escape(s["plain_language"]), "</div>",
            F.when(
                s["platform_help"].isNotNull(),
                say('<div class="platform-help"><strong>How to fix:</strong> ', escape(s["platform_help"]), "</div>"),
            ).otherwise(F.lit("")),
            "</div>",
        ),
    )
    block = F.when(
        F.size("suggestions") > 0,
        F.concat(F.lit('<div class="section-title">Actionable Suggestions</div>'), F.array_join(advice, "")),
    ).otherwise(F.lit('<div class="section-title">✅ No issues found!</div>'))
    return say(
        '<div class="page-section"><div class="page-header"><h2>Page ', F.col("number"), '</h2><div class="page-url">',
        escape(F.col("url")), "</div><span>Status: ", F.col("status_code"), "</span>", badge,
        '</div><div class="section-title">SEO Overview</div><div class="metadata-grid">', cards, "</div>", block, "</div>",
    )


def html_sections(facts: DataFrame) -> DataFrame:
    """Page sections of the HTML report, one row per page with its number. ``facts`` should be a stored table of ``HTML_FACTS``."""
    return numbered(facts, "site", "page_id", "number").select(
        "site", "number", "page_id", _html_section().alias("section")
    )


#: The facts that page cards and the broken links on them read.
CARD_FACTS = [
    "site", "page_id", "url", "status_code", "word_count", "title", "title_length", "meta_description", "meta_description_length",
    "semantic_elements", "image_count", "missing_alt_count", "internal_count", "external_count", "links",
]


# The texts between the figures.
def page_card(broken_items: Column, broken_count: Column) -> Column:
    """The short description of one page; ``broken_items`` are its broken links as text."""
    broken = F.when(
        broken_count > 0,
        F.concat(F.lit("\nBroken Links: "), broken_count.cast("string"), F.lit("\n"),
                 F.array_join(F.transform(F.slice(broken_items, 1, 3), lambda b: F.concat(F.lit("  - "), b, F.lit("\n"))), "")),
    ).otherwise(F.lit(""))
    c = F.col
    return say(
        "PAGE ANALYSIS: ", c("url"), "\n\nStatus Code: ", c("status_code"), "\nWord Count: ", c("word_count"),
        "\n\nSEO:\n  Title: ", c("title"), " (", c("title_length"), " chars)\n  Meta Description: ",
        F.substring("meta_description", 1, 100), "... (", c("meta_description_length"),
        " chars)\n\nHTML Structure:\n  Semantic elements: ", F.array_join("semantic_elements", ", "), "\n\nImages: ",
        c("image_count"), " total, ", c("missing_alt_count"), " missing alt text\n\nLinks: ", c("internal_count"),
        " internal, ", c("external_count"), " external\n", broken,
    )


def broken_items(broken: DataFrame, shown: int = 3) -> DataFrame:
    """Per page the number of broken links and the first ``shown`` of them as text; only these are gathered."""
    place = Window.partitionBy("page_id").orderBy("rank")
    item = say(F.col("target"), " (Status: ", F.col("status_code"), ")")
    numbered_ = broken.withColumn("_place", F.row_number().over(place)).withColumn("_item", item)
    kept = F.when(F.col("_place") <= shown, F.struct("_place", "_item"))
    return numbered_.groupBy("page_id").agg(
        F.count("*").alias("broken_links"), F.transform(F.sort_array(F.collect_list(kept)), lambda x: x["_item"]).alias("broken_items")
    )
