"""Rule-based answers to stored messages, from the figures of the site."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftaudit.functions import text
from weftaudit.functions.common import messages, say, strip
from weftaudit.functions.cms import CMS_PATTERNS

# Words that ask for a plan, and the topic of each keyword in order.
PLAN_WORDS = ["action plan", "plan", "priorit", "roadmap", "next step"]
KEYWORD_TOPICS = [
    ("seo", "seo"), ("title", "title"), ("meta", "meta"), ("description", "meta"), ("h1", "heading"),
    ("heading", "heading"), ("image", "image"), ("alt", "image"), ("link", "link"), ("speed", "speed"),
    ("performance", "speed"), ("accessibility", "accessibility"), ("cms", "cms"), ("wordpress", "cms"),
    ("squarespace", "cms"), ("wix", "cms"), ("shopify", "cms"), ("content", "content"), ("schema", "schema"),
    ("structured", "schema"), ("canonical", "canonical"), ("robots", "robots"), ("mobile", "mobile"),
]
# Tips per topic; {x} stands for a figure of the site.
TIPS = {
    "seo": [
        "Make each page target a distinct search intent with a unique title, H1, and meta description.",
        "Expand thin pages; the current average word count is {avg_word_count}, so pages below ~300 words may need richer copy.",
        "Align page titles, headings, and internal anchor text around the same core topic to reinforce relevance.",
    ],
    "title": [
        "Write concise, unique title tags around 50-60 characters; {no_title} page(s) appear to be missing titles in this dataset.",
        "Lead with the primary topic or service, then add the brand at the end if space allows.",
    ],
    "meta": [
        "Create meta descriptions of roughly 150-160 characters; {no_description} page(s) appear to be missing them.",
        "Use benefit-driven language and a call to action so search snippets earn more clicks.",
    ],
    "heading": [
        "Ensure each page has exactly one descriptive H1; {no_h1} page(s) appear to be missing one.",
        "Use H2 and H3 headings to break up content into scannable sections that match user questions.",
    ],
    "image": [
        "Add specific alt text to the {images_without_alt} image(s) missing it so both accessibility and image SEO improve.",
        "Compress oversized images and serve modern formats like WebP where possible to reduce page weight.",
    ],
    "link": [
        "Fix or redirect the {broken_links_found} broken link(s) identified in the crawl.",
        "Strengthen internal linking between related service, product, and blog pages using descriptive anchor text.",
        "Add a few relevant external citations where helpful; the crawl found {total_external_links} external link(s).",
    ],
    "speed": [
        "Improve page speed by compressing images, deferring non-critical scripts, and reducing third-party embeds.",
        "Review templates for render-blocking CSS/JS and remove unused assets from the most important pages first.",
    ],
    "accessibility": [
        "Start with image alt text coverage; {images_without_alt} image(s) are missing alt text in the summary.",
        "Check heading order, form labels, color contrast, and keyboard navigation on the homepage and key conversion pages.",
    ],
    "cms": ["Apply changes in your CMS theme or page settings first so fixes stay consistent across similar pages."],
    "content": [
        "Pages with thin copy should be expanded with clearer benefits, FAQs, and proof points; current average word count is {avg_word_count}.",
        "Match content sections to buyer questions and use subheadings so important information is easy to scan.",
    ],
    "schema": [
        "Add or validate structured data for Organization, LocalBusiness, Product, Article, or FAQ content where relevant.",
        "Use schema only when the on-page content supports it, and keep fields like name, URL, and sameAs consistent site-wide.",
    ],
    "canonical": [
        "Set canonical URLs on pages with similar or duplicate content so search engines know which version to index.",
        "Check parameterized URLs, archive pages, and CMS-generated duplicates for conflicting canonical tags.",
    ],
    "robots": [
        "Confirm important pages are indexable and that robots directives are not accidentally blocking them.",
        "Use noindex sparingly for utility, duplicate, or low-value pages rather than key landing pages.",
    ],
    "mobile": [
        "Test the homepage and top landing pages on mobile for readable text, tap target spacing, and intrusive popups.",
        "Keep headings short and compress above-the-fold media so mobile users see the primary value quickly.",
    ],
    "general": [
        "Review the {total_pages_analyzed} analyzed page(s) and prioritize issues that affect many templates or high-traffic pages.",
        "There are {critical_count} critical issue(s) and {warnings_count} warning(s); fix repeated patterns before isolated edge cases.",
        "After each round of fixes, rerun the crawl to confirm titles, headings, images, and links improved as expected.",
    ],
}
CMS_TIPS = {
    "wordpress": "In WordPress, update titles/descriptions with your SEO plugin and audit theme templates for heading or schema issues.",
    "squarespace": "In Squarespace, check page SEO settings, image alt text fields, and summary block layouts that may create heading issues.",
    "wix": "In Wix, review SEO Basics per page, image settings, and strip out duplicate heading elements in the editor.",
    "shopify": "In Shopify, edit page SEO previews, collection/product templates, and theme sections that affect headings and structured data.",
}
PLAN_LAST = "Validate the fixes on the homepage and top conversion pages before rolling them out site-wide"
ANSWER_TIPS = 6


def fill(template: str) -> Column:
    """A template with the named figures of the row put in."""
    parts: list[Column | str] = []
    rest = template
    while "{" in rest:
        before, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        parts += [before, F.col(name)] if before else [F.col(name)]
    if rest:
        parts.append(rest)
    return say(*parts)


def normalised(rows: DataFrame) -> DataFrame:
    """Messages with a role and stripped text; blank ones are dropped."""
    return rows.withColumn("role", F.coalesce(F.nullif("role", F.lit("")), F.lit("user"))).withColumn(
        "text", strip(F.coalesce("text", F.lit("")))
    ).where(F.col("text") != "")


def topics_of(message: Column) -> Column:
    """Topics named by a message, each once, in the order of the keyword list."""
    low = F.lower(message)
    hits = [F.when(low.contains(word), F.lit(topic)) for word, topic in KEYWORD_TOPICS]
    return F.array_distinct(F.array_compact(F.array(*hits)))


def wants_plan(message: Column) -> Column:
    low = F.lower(message)
    found = F.lit(False)
    for word in PLAN_WORDS:
        found = found | low.contains(word)
    return found


def cms_named(message: Column, site_cms: Column) -> Column:
    """Platform named in the message, else the one detected on the site."""
    low = F.lower(message)
    named = F.coalesce(*[F.when(low.contains(name), F.lit(name)) for name, *_ in CMS_PATTERNS])
    return F.coalesce(named, site_cms)


# The texts between the figures.
@cache
def action_plan() -> Column:
    first = lambda k: F.get(F.col(k), F.lit(0))
    # The lines of the plan.
    return messages(
        (first("critical").isNotNull(), say("Phase 1: resolve critical issues such as ", first("critical"))),
        (first("warnings").isNotNull(), say("Phase 2: clean up warning-level items like ", first("warnings"))),
        (
            F.col("images_without_alt") > 0,
            say("Phase 3: add descriptive alt text to ", F.col("images_without_alt"), " image(s)"),
        ),
        (
            F.col("broken_links_found") > 0,
            say("Phase 4: repair or redirect ", F.col("broken_links_found"), " broken link(s)"),
        ),
        (F.col("total_pages_analyzed") > 0, PLAN_LAST),
    )


@cache
def tips() -> Column:
    """Tips for the topics of the row (columns ``topics``, ``cms`` and site figures)."""
    out = []
    for topic in dict.fromkeys(t for _, t in KEYWORD_TOPICS):
        lines = [fill(t) for t in TIPS[topic]]
        block = F.array(*lines)
        if topic == "cms":
            extra = F.coalesce(*[F.when(F.col("cms") == name, F.lit(t)) for name, t in CMS_TIPS.items()])
            block = F.array_compact(F.array(*lines, extra))
        out.append(
            F.struct(F.lit(topic).alias("topic"), block.alias("lines"))
        )
    known = F.array(*out)
    return F.flatten(
        F.transform(
            "topics", lambda t: F.get(F.filter(known, lambda k: k["topic"] == t), F.lit(0))["lines"]
        )
    )


def answers(questions: DataFrame) -> DataFrame:
    """Add ``answer``. The rows carry text, site figures, insight lists and ``site_cms``."""
    routed = questions.withColumn("topics", topics_of(F.col("text"))).withColumn(
        "cms", cms_named(F.col("text"), F.col("site_cms"))
    )
    planned = F.when(wants_plan(F.col("text")), action_plan()).otherwise(F.array().cast("array<string>"))
    routed = routed.withColumn("found", F.concat(planned, tips()))
    general = F.array(*[fill(t) for t in TIPS["general"]])
    base = F.when(F.size("found") > 0, F.col("found")).otherwise(general)
    urgent = F.when(
        F.size("critical") > 0, say("Address the highest-risk issue first: ", F.get("critical", F.lit(0)))
    ).when(F.size("warnings") > 0, say("Start with this warning: ", F.get("warnings", F.lit(0))))
    bullets = F.slice(
        text.dedupe_folded(F.concat(base, F.array_compact(F.array(urgent)))), 1, ANSWER_TIPS
    )
    return routed.withColumn(
        "answer",
        F.concat(
            F.lit("Here are practical audit recommendations for "), F.col("site"), F.lit(":\n- "),
            F.array_join(bullets, "\n- "),
        ),
    ).drop("found")


# The texts between the figures.
def short_answer() -> Column:
    """Score, fix list or overview, by the words of the message."""
    low = F.lower("text")
    picked = F.slice(
        F.concat(F.col("critical"), F.col("warnings"), F.col("recommendations")), 1, 3
    )
    scores = say(
        "Overall score: ", F.col("overall"), "/100. SEO ", F.col("seo"), ", accessibility ", F.col("accessibility"),
        ", content ", F.col("content"), ", technical ", F.col("technical"), ".",
    )
    fixes = F.when(F.size(picked) == 0, F.lit("No major recommendations are available yet.")).otherwise(
        F.concat(F.lit("Top priorities: "), F.array_join(picked, " | "))
    )
    overview = say(
        "The audit analyzed ", F.col("total_pages_analyzed"), " page(s). It found ", F.size("critical"),
        " critical issues and ", F.size("warnings"), " warnings. First action: ",
        F.coalesce(F.get(picked, F.lit(0)), F.lit("review the full report for next steps.")),
    )
    return F.when(low.contains("score"), scores).when(low.rlike("recommend|fix|priority"), fixes).otherwise(overview)


def with_extension(answered: DataFrame, answerer: Callable[[Column, Column], Column]) -> DataFrame:
    """Let a user's vectorised function replace answers; a null keeps the rule-based one."""
    return answered.withColumn("answer", F.coalesce(answerer(F.col("text"), F.col("answer")), F.col("answer")))


def conversation_state(rows: DataFrame) -> DataFrame:
    """Per conversation: last user message and the numbers of messages."""
    clean = normalised(rows)
    by_user = F.col("role") == "user"
    return clean.groupBy("conv_id").agg(
        F.max_by(F.when(by_user, F.col("text")), F.when(by_user, F.col("turn"))).alias("last_user_message"),
        F.count("*").alias("messages"),
        F.count_if(F.col("role") == "system").alias("system_messages"),
    )


def system_prompts(rows: DataFrame) -> DataFrame:
    """The system prompt of each conversation: its system messages in order, a blank line between them."""
    parts = normalised(rows).where(F.col("role") == "system")
    listed = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("parts"))
    return listed.select("conv_id", F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("system_prompt"))


def without_system(rows: DataFrame) -> DataFrame:
    """The messages of users and assistants."""
    return normalised(rows).where(F.col("role") != "system")


def prompt_line() -> Column:
    """A message as its part of a plain prompt."""
    return say(F.upper(F.substring("role", 1, 1)), F.lower(F.substring(F.col("role"), 2, 1000)), ": ", F.col("text"))


# The texts between the figures.
def site_prompt() -> Column:
    """Facts and findings of a site for a conversation, without its page lines."""
    c = F.col
    size = lambda k: F.greatest(F.size(c(k)), F.lit(0))
    detail = lambda k, head: F.when(
        size(k) > 0, F.concat(F.lit(f"- {head}: "), F.array_join(F.slice(k, 1, 3), " | "))
    )
    return F.concat_ws(
        "\n",
        F.lit("SITE OVERVIEW"), say("- Domain: ", c("domain")), say("- Base URL: ", c("base_url")),
        say("- Pages crawled: ", c("pages_crawled")), say("- Pages analyzed: ", c("total_pages_analyzed")),
        say("- Total images: ", c("total_images")), say("- Images without alt text: ", c("images_without_alt")),
        say("- Internal links: ", c("total_internal_links")), say("- External links: ", c("total_external_links")),
        say("- Broken links: ", c("broken_links_found")), say("- Average word count: ", c("avg_word_count")),
        F.when(c("site_cms").isNotNull(), say("- Likely CMS/platform: ", c("site_cms"))),
        F.lit("\nTOP FINDINGS"), say("- Critical issues: ", size("critical")), say("- Warnings: ", size("warnings")),
        say("- Recommendations: ", size("recommendations")), say("- Positive findings: ", size("positive")),
        detail("critical", "Critical details"), detail("warnings", "Warning details"),
        detail("recommendations", "Recommended improvements"),
    )


# The texts between the figures.
def page_line() -> Column:
    """One highlight line of a page."""
    c = F.col
    yes = lambda k: F.when(c(k), "yes").otherwise("no")
    return F.concat(
        say(
            "- URL: ", c("url"), "; status=", c("status_code"), "; title=", yes("has_title"), "; meta_description=",
            yes("has_meta_description"), "; h1_count=", c("h1_count"), "; missing_alt=", c("missing_alt_count"),
            "; internal_links=", c("internal_count"), "; external_links=", c("external_count"), "; word_count=", c("word_count"),
        ),
        F.coalesce(F.concat(F.lit("; error="), c("error")), F.lit("")),
    )


def site_platform(facts: DataFrame) -> DataFrame:
    """The platform most pages of a site point to (ties by name)."""
    per = facts.where(F.col("cms_probable").isNotNull()).groupBy("site", "cms_probable").agg(F.count("*").alias("n"))
    return per.groupBy("site").agg(
        F.max_by("cms_probable", F.struct(F.col("n"), F.col("cms_probable"))).alias("site_cms")
    )
