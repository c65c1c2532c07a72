"""Page suggestions: seven rules as one ordered array of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftaudit.functions.common import fixed, say

# How-to texts by rule and platform.
PLATFORM_HELP = {
    "title": {
        "squarespace": "In Squarespace: Go to the page settings → SEO → Page Title",
        "wordpress": "In WordPress: Edit the page → look for SEO settings or use Yoast SEO plugin",
        "wix": "In Wix: Page Settings → SEO Basics → Page Title",
    },
    "description": {
        "squarespace": "In Squarespace: Page settings → SEO → Description",
        "wordpress": "In WordPress: Edit page → Meta Description field (usually in SEO plugin)",
        "wix": "In Wix: Page Settings → SEO Basics → Meta Description",
    },
    "alt": {
        "squarespace": "In Squarespace: Click image → Edit → Filename & Alt Text",
        "wordpress": "In WordPress: Click image → Alt Text field",
        "wix": "In Wix: Click image → Settings → Alt Text",
    },
}

# Priority, category, issue, suggestion and plain-language text by rule.
RULE_TEXTS = {
    "title": (
        "critical", "seo", "Missing page title",
        "Add a unique, descriptive title to this page (50-60 characters recommended)",
        "Your page needs a title that appears in search results and browser tabs.",
    ),
    "description": (
        "high", "seo", "Missing meta description",
        "Add a compelling meta description (150-160 characters) that summarizes the page",
        "This is the preview text people see in search results. Make it engaging!",
    ),
    "no_h1": (
        "high", "content", "Missing H1 heading",
        "Add a main heading (H1) that describes the page topic",
        "Every page should have one main heading - it helps both readers and search engines understand your page.",
    ),
    "many_h1": (
        "medium", "content", "Multiple H1 headings",
        "Use only one H1 heading per page; convert others to H2 or H3",
        "Having multiple main headings confuses search engines. Choose one main heading and make others subheadings.",
    ),
    "alt": (
        "high", "accessibility", " image(s) without alt text",
        "Add descriptive alt text to all images",
        "Alt text helps visually impaired users and improves SEO. Describe what the image shows.",
    ),
    "thin": (
        "medium", "content", "Thin content",
        "Current word count is {n}. Aim for at least 300 words of quality content",
        "Search engines prefer pages with substantial, helpful content. Add more valuable information for your visitors.",
    ),
    "slow": (
        "medium", "performance", "Slow page load time",
        "Page took {n} seconds to load. Optimize images and reduce file sizes",
        "Slow pages frustrate visitors and hurt search rankings. Compress images and minimize code.",
    ),
}


def _help(rule: str, platform: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, advice in PLATFORM_HELP.get(rule, {}).items():
        found = F.when(platform == name, F.lit(advice)).otherwise(found)
    return found


def _row(rule: str, platform: Column, issue: Column | None = None, number: Column | None = None) -> Column:
    priority, category, issue_text, suggestion, plain = RULE_TEXTS[rule]
    if number is not None:
        before, after = suggestion.split("{n}")
        advice = say(before, number, after)
    else:
        advice = F.lit(suggestion)
    return F.struct(
        F.lit(priority).alias("priority"),
        F.lit(category).alias("category"),
        (issue if issue is not None else F.lit(issue_text)).alias("issue"),
        advice.alias("suggestion"),
        F.lit(plain).alias("plain_language"),
        _help(rule, platform).alias("platform_help"),
    )


def suggestion_list(load_time: Column) -> Column:
    """Suggestions of a facts row, most basic rule first."""
    platform = F.col("cms_probable")
    missing = F.col("missing_alt_count")
    seconds = fixed(load_time, 2)
    rules = [
        (F.col("title") == "", _row("title", platform)),
        (F.col("meta_description") == "", _row("description", platform)),
        (F.col("h1_count") == 0, _row("no_h1", platform)),
        (F.col("h1_count") > 1, _row("many_h1", platform)),
        (missing > 0, _row("alt", platform, issue=say(missing, RULE_TEXTS["alt"][2]))),
        (F.col("word_count") < 300, _row("thin", platform, number=F.col("word_count"))),
        (F.coalesce(load_time, F.lit(0.0)) > 3, _row("slow", platform, number=seconds)),
    ]
    return F.array_compact(F.array(*[F.when(cond, row) for cond, row in rules]))
