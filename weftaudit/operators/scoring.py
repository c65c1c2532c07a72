"""Page and site scores in six pillars.

Page pillars are expressions over one facts row. Site pillars are one grouped
aggregate per input. Messages of a pillar can differ on every page, so their
union over a site is a long table (``pillar_messages``), never one array.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftaudit.functions import text
from weftaudit.functions.common import bind, fixed, messages, percent0, points, round2, say, strip
from weftaudit.functions.grades import PILLAR_WEIGHTS, cents, clamp, grade, label, mean_of_cents, pillar, weighted
from weftaudit.operators import graph, links
from weftaudit.operators.authority import authority_scores
from weftaudit.operators.duplicates import with_duplicate_flag
from weftaudit.operators.facts import level_gap, pair_value
from weftaudit.operators.rows import unrolled
from weftaudit.operators.topics import page_text, primary_keyword
from weftaudit.sources.shared import materialised

# Fixed value: elements that count for the semantic share.
SEMANTIC_TARGETS = ["header", "main", "footer", "nav", "article", "section"]


#: The facts that pillars, site figures and the link graph read; the other half is not computed for scores.
SCORE_FACTS = [
    "page_id", "site", "url", "title", "meta_description", "canonical_url", "h1_count", "heading_counts", "headings", "images", "inline_color",
    "internal_count", "external_count", "json_ld", "links", "load_time", "open_graph", "semantic_elements", "structure", "text_content", "top_keywords",
    "twitter_card", "viewport", "word_count",
]


def valid_hierarchy(counts: Column) -> Column:
    """Some heading is there and no level between the present ones is missing."""
    return F.exists(counts, lambda n: n > 0) & ~level_gap(counts)


def lazy_images(images: Column) -> Column:
    """All images are loaded lazily; true without images."""
    return F.forall(images, lambda i: F.lower(i["loading"]) == "lazy")


# Points, limits and messages.
@cache
def _on_page() -> Column:
    title, meta, key = F.trim("title"), strip(F.col("meta_description")), F.col("keyword")
    h1_text = strip(
        F.array_join(F.transform(F.filter("headings", lambda h: h["level"] == 1), lambda h: h["text"]), " ")
    )
    n, d, h1 = F.length(title), F.length(meta), F.col("h1_count")
    known = key != ""
    in_title, in_meta, in_h1 = (text.contains_term(x, key) for x in (title, meta, h1_text))
    ordered = valid_hierarchy(F.col("heading_counts"))
    og = F.lit(True)
    for part in ("title", "description", "image"):
        og = og & (F.coalesce(pair_value(F.col("open_graph"), part), F.lit("")) != "")
    card = F.size("twitter_card") > 0
    densest = F.coalesce(F.array_max(F.transform("top_keywords", lambda k: k["density"])), F.lit(0.0))
    canonical, ld = F.col("canonical_url") != "", F.size("json_ld") > 0
    score = points(
        (n > 0, 10), (n.between(50, 60), 5), (known & in_title, 5), (d > 0, 10), (d.between(120, 160), 5),
        (known & in_meta, 5), (h1 >= 1, 10), (h1 == 1, 5), (known & in_h1, 5), (ordered, 10), (canonical, 5),
        (ld, 5), (og, 5), (card, 5), (densest <= 3.0, 5),
    )
    issues = messages(
        (n == 0, "Missing title tag"),
        ((n > 0) & ~n.between(50, 60), say("Title length is ", n, " characters; target 50-60")),
        (known & ~in_title, "Title does not include the primary keyword"),
        (d == 0, "Missing meta description"),
        ((d > 0) & ~d.between(120, 160), say("Meta description length is ", d, " characters; target 120-160")),
        (known & ~in_meta, "Meta description does not include the primary keyword"),
        (h1 == 0, "Missing H1 heading"),
        (h1 > 1, say("Page has ", h1, " H1 headings; use only one")),
        (known & ~in_h1, "H1 does not include the primary keyword"),
        (~ordered, "Heading hierarchy appears to skip levels"),
        (~canonical, "Canonical tag is missing"),
        (~ld, "Structured data / JSON-LD not detected"),
        (~og, "Open Graph tags are incomplete"),
        (~card, "Twitter card metadata is missing"),
        (
            densest > 3.0,
            say("Keyword density peaks at ", fixed(densest, 2), "%, which suggests stuffing"),
        ),
    )
    passed = messages(
        (n > 0, "Title tag is present"),
        (n.between(50, 60), "Title length is within the optimal 50-60 character range"),
        (known & in_title, say("Title includes the primary keyword '", key, "'")),
        (d > 0, "Meta description is present"),
        (d.between(120, 160), "Meta description length is within the optimal 120-160 character range"),
        (known & in_meta, "Meta description includes the primary keyword"),
        (h1 >= 1, "At least one H1 heading is present"),
        (h1 == 1, "Page uses a single H1 heading"),
        (known & in_h1, "H1 includes the primary keyword"),
        (ordered, "Heading hierarchy does not skip levels"),
        (canonical, "Canonical tag is present"),
        (ld, "Structured data / JSON-LD is present"),
        (og, "Open Graph title, description, and image are present"),
        (card, "Twitter card metadata is present"),
        (densest <= 3.0, "Keyword density does not indicate stuffing"),
    )
    return pillar(score, 85.0, issues, passed)


# Points, limits and messages.
@cache
def _content() -> Column:
    wc, ease, phrases = F.col("word_count"), F.col("flesch"), F.col("phrases")
    first = F.get("top_keywords", F.lit(0))
    own, density = F.coalesce(first["word"], F.lit("")), F.coalesce(first["density"], F.lit(0.0))
    balanced = (own != "") & density.between(0.5, 3.0)
    shown = fixed(ease, 1)
    dense = fixed(density, 2)
    very, good, fair = ease.between(70, 80), (ease >= 60) & (ease < 70), (ease >= 40) & (ease < 60)
    score = points(
        (wc >= 300, 15), (wc < 300, -15), (wc >= 600, 10), (wc >= 1200, 5), (very, 20), (good, 15), (fair, 10),
        (balanced, 10), (~balanced, -10), (F.size(phrases) > 0, 10), (F.col("duplicated"), -10),
    )
    issues = messages(
        (wc < 300, say("Thin content detected: ", wc, " words")),
        (~(very | good | fair), say("Readability is outside the preferred range (Flesch ", shown, ")")),
        (~balanced & (own != ""), say("Primary keyword density is ", dense, "% for '", own, "'")),
        (~balanced & (own == ""), "Primary keyword density could not be validated"),
        (F.size(phrases) == 0, "No repeated 2-4 word long-tail phrases were detected"),
        (F.col("duplicated"), "Opening content appears duplicated across multiple pages"),
    )
    passed = messages(
        (wc >= 300, "Content meets the 300-word minimum"),
        (wc >= 600, "Content exceeds 600 words"),
        (wc >= 1200, "Content exceeds 1,200 words"),
        (very, say("Readability is very good (Flesch ", shown, ")")),
        (good, say("Readability is good (Flesch ", shown, ")")),
        (fair, say("Readability is fair (Flesch ", shown, ")")),
        (balanced, say("Primary keyword density is balanced at ", dense, "%")),
        (F.size(phrases) > 0, say("Long-tail opportunities found: ", F.array_join(F.slice(phrases, 1, 3), ", "))),
        (~F.col("duplicated"), "Opening content appears unique across crawled pages"),
    )
    return pillar(score, 75.0, issues, passed)


# Points, limits and messages.
@cache
def _technical() -> Column:
    secure = F.coalesce("https", F.col("url").startswith("https://"))
    robots, sitemap = F.coalesce("has_robots", F.lit(False)), F.coalesce("has_sitemap", F.lit(False))
    broken = F.col("broken_count")
    seconds = F.coalesce(
        F.nullif("load_time", F.lit(0.0)), F.nullif("meta_load_time", F.lit(0.0)), F.lit(0.0)
    )
    shown = fixed(seconds, 2)
    timed = seconds != 0
    view, lazy = F.col("viewport") != "", lazy_images(F.col("images"))
    score = points(
        (secure, 15), (robots, 10), (sitemap, 10), (broken == 0, 15), (timed & (seconds < 3.0), 15),
        (timed & (seconds < 1.5), 5), (view, 15), (lazy, 10),
    )
    issues = messages(
        (~secure, "HTTPS is not enabled"),
        (~robots, "robots.txt presence not confirmed"),
        (~sitemap, "sitemap.xml presence not confirmed"),
        (broken > 0, say(broken, " broken link(s) were reported for this page")),
        (timed & (seconds >= 3.0), say("Load time is ", shown, "s; target under 3 seconds")),
        (~timed, "Load time data was not provided"),
        (~view, "Viewport meta tag is missing"),
        (~lazy, "Images are missing lazy loading"),
    )
    passed = messages(
        (secure, "HTTPS is enabled"),
        (robots, "robots.txt is present"),
        (sitemap, "sitemap.xml is present"),
        (broken == 0, "No broken links were reported for this page"),
        (timed & (seconds < 3.0), say("Load time is under 3 seconds (", shown, "s)")),
        (timed & (seconds < 1.5), "Load time is under 1.5 seconds"),
        (view, "Viewport meta tag is present"),
        (lazy, "Images use lazy loading"),
    )
    return pillar(score, 95.0, issues, passed)


# Points, limits and messages.
@cache
def _ux() -> Column:
    images = F.col("images")
    some = F.size(images) > 0
    all_alt = F.forall(images, lambda i: strip(i["alt"]) != "")
    file_alts = F.size(F.filter(images, lambda i: text.is_filename_alt(i["alt"])))
    short_alts = F.size(F.filter(images, lambda i: text.is_short_alt(i["alt"])))
    modern = F.exists(images, lambda i: F.regexp_extract(F.lower(i["src"]), r"^[^?]*", 0).rlike(r"\.(?:webp|avif)$"))
    share = F.size(
        F.array_intersect("semantic_elements", F.array(*[F.lit(e) for e in SEMANTIC_TARGETS]))
    ).cast("double") / F.lit(float(len(SEMANTIC_TARGETS)))
    view = F.col("viewport") != ""
    mobile = view & (
        F.col("structure.has_nav") | F.col("structure.has_main") | modern | lazy_images(images)
    )
    color = F.col("inline_color")
    score = points(
        (all_alt, 15), (file_alts == 0, 10), (short_alts == 0, 10), (~color, 5), (modern | ~some, 10), (view, 10),
        (mobile, 10),
    ) + share * 20.0
    issues = messages(
        (~all_alt, "Some images are missing alt text"),
        (file_alts > 0, say("Filename-like alt text found on ", file_alts, " image(s)")),
        (short_alts > 0, say("Alt text is too short on ", short_alts, " image(s)")),
        (color, "Inline color styles were found; review contrast carefully"),
        (share < 0.66, "Semantic HTML5 structure is limited"),
        (some & ~modern, "Modern image formats (.webp or .avif) were not detected"),
        (~view, "Viewport meta tag is missing"),
        (~mobile, "Few mobile-friendly implementation signals were detected"),
    )
    passed = messages(
        (some & all_alt, "All images have non-empty alt text"),
        (~some, "No images require alt text checks"),
        (file_alts == 0, "Image alt text avoids filename-like placeholders"),
        (short_alts == 0, "Image alt text is descriptive in length"),
        (~color, "Inline color styles were not detected"),
        (share >= 0.66, "Semantic HTML5 structure is strong"),
        (some & modern, "Modern image formats are in use"),
        (~some, "No legacy image assets were detected"),
        (view, "Viewport meta tag is present"),
        (mobile, "Page shows mobile-friendly implementation signals"),
    )
    return pillar(score, 90.0, issues, passed)


@cache
def _page_links() -> Column:
    texts = F.transform("links", lambda x: links.anchor_key(x["text"]))
    return bind(
        F.struct(
            links.bad_anchors().alias("bad"),
            links.unprotected().alias("open"),
            F.size(F.array_distinct(F.filter(texts, lambda t: t != ""))).alias("kinds"),
            F.size("links").alias("n"),
            F.col("internal_count").alias("inside"),
        ),
        _page_links_score,
    )


# Points, limits and messages.
def _page_links_score(s: Column) -> Column:
    bad, unsafe = s["bad"], s["open"]
    ratio = F.when(s["n"] > 0, s["kinds"].cast("double") / s["n"].cast("double")).otherwise(F.lit(1.0))
    varied = (ratio >= 0.5) & (s["kinds"] >= 2)
    score = 80.0 - 5.0 * bad + points((unsafe == 0, 10), (varied, 10))
    issues = messages(
        (bad > 0, say("Weak anchor text found on ", bad, " link(s)")),
        (unsafe > 0, say(unsafe, " external link(s) are missing rel protection")),
        (~varied, "Anchor text variety is limited"),
        (s["inside"] == 0, "Page has no internal links"),
    )
    passed = messages(
        (bad == 0, "Anchor text avoids generic phrases"),
        (unsafe == 0, "External links use rel protection"),
        (varied, "Anchor text variety is healthy"),
        (s["inside"] > 0, say("Page includes ", s["inside"], " internal link(s)")),
    )
    return pillar(score, 100.0, issues, passed)


@cache
def _text_columns() -> tuple[Column, ...]:
    """Text measures, made once per page before the pillars read them."""
    return (
        primary_keyword(F.col("primary_keyword")).alias("keyword"),
        text.flesch(F.col("page_text")).alias("flesch"),
        text.long_tail_phrases(F.col("page_text")).alias("phrases"),
        text.fingerprint(F.col("page_text")).alias("opening"),
    )


@cache
def _page_text_column() -> Column:
    return page_text(F.col("text_content")).alias("page_text")


def scoring_input(facts: DataFrame, site_meta: DataFrame, whole_site: bool = True) -> DataFrame:
    """Facts with site columns, text measures and the duplicate flag.

    ``facts`` must carry ``broken_count``. With ``whole_site`` false each page
    stands alone, so no opening counts as repeated.
    """
    meta = site_meta.select(
        "site", "primary_keyword", "https", "has_robots", "has_sitemap", F.col("load_time").alias("meta_load_time")
    )
    rows = facts.join(meta, ["site"], "left")
    measured = rows.select("*", _page_text_column()).select("*", *_text_columns()).drop("page_text", "text_content")
    if whole_site:
        return with_duplicate_flag(measured, "site", "opening")
    return measured.withColumn("duplicated", F.lit(False))


def page_pillars_either_way(scored_input: DataFrame) -> DataFrame:
    """The pillars of pages without a shared opening, ``content_if_shared``, the content pillar with one, and the opening."""
    shared = scored_input.withColumn("duplicated", F.lit(True)).withColumn("content_if_shared", _content())
    return page_pillars(shared.withColumn("duplicated", F.lit(False)), "content_if_shared", "opening")


def page_pillars(scored_input: DataFrame, *more: str) -> DataFrame:
    """The five pillars that read one page, and the columns named in ``more``."""
    return scored_input.select(
        "site",
        "page_id",
        "url",
        *more,
        _on_page().alias("on_page_seo"),
        _content().alias("content_quality"),
        _technical().alias("technical_seo"),
        _ux().alias("ux_design"),
        _page_links().alias("links_architecture"),
    )


def page_scores(pillars: DataFrame, authority: DataFrame) -> DataFrame:
    """Add the authority of the site and the weighted overall score."""
    rows = pillars.join(authority.select(F.col("domain").alias("site"), "authority"), ["site"], "left")
    overall = weighted({name: F.col(name)["score"] for name in PILLAR_WEIGHTS})
    return rows.withColumn("overall", overall).select(
        "*", grade(F.col("overall")).alias("grade"), label(F.col("overall")).alias("label")
    )


def site_technical(facts: DataFrame, site_meta: DataFrame) -> DataFrame:
    """Technical pillar of each site: one grouped aggregate over its pages."""
    load = F.rint(F.col("load_time") * 1000000.0).cast("bigint")
    agg = facts.groupBy("site").agg(
        F.count("*").alias("n"),
        F.bool_and((F.col("url") == "") | F.col("url").startswith("https://")).alias("all_https"),
        F.sum("broken_count").alias("broken"),
        F.sum(load).alias("load_sum"),
        F.count("load_time").alias("load_n"),
        F.count_if(F.col("viewport") != "").alias("view_n"),
        F.count_if(lazy_images(F.col("images"))).alias("lazy_n"),
    )
    rows = agg.join(
        site_meta.select("site", "https", "has_robots", "has_sitemap", F.col("load_time").alias("meta_load_time")),
        "site",
        "left",
    )
    mean = F.when(F.col("load_n") > 0, F.col("load_sum").cast("double") / F.col("load_n").cast("double") / 1000000.0)
    rows = rows.select(
        "site",
        F.coalesce("https", "all_https").alias("secure"),
        F.coalesce("has_robots", F.lit(False)).alias("robots"),
        F.coalesce("has_sitemap", F.lit(False)).alias("sitemap"),
        "broken",
        F.coalesce(F.nullif("meta_load_time", F.lit(0.0)), mean, F.lit(0.0)).alias("seconds"),
        (F.col("view_n").cast("double") / F.col("n").cast("double")).alias("view"),
        (F.col("lazy_n").cast("double") / F.col("n").cast("double")).alias("lazy"),
    )
    return rows.select("site", "seconds", "view", "lazy", _site_technical().alias("technical_seo"))


# Points, limits and messages.
@cache
def _site_technical() -> Column:
    secure, robots, sitemap, broken = (F.col(c) for c in ("secure", "robots", "sitemap", "broken"))
    seconds, view, lazy = F.col("seconds"), F.col("view"), F.col("lazy")
    shown = fixed(seconds, 2)
    score = points(
        (secure, 15), (robots, 10), (sitemap, 10), (broken == 0, 15), (seconds < 3.0, 15), (seconds < 1.5, 5)
    ) + view * 15.0 + lazy * 10.0
    issues = messages(
        (~secure, "HTTPS is not enabled across the site"),
        (~robots, "robots.txt was not detected"),
        (~sitemap, "sitemap.xml was not detected"),
        (broken > 0, say(broken, " broken link(s) were reported")),
        (seconds >= 3.0, say("Average load time is ", shown, "s; target under 3 seconds")),
        (
            (view > 0) & (view < 1),
            say("Viewport meta tag is missing on some pages (", percent0(view), " coverage)"),
        ),
        (view == 0, "Viewport meta tag is missing on all pages"),
        (
            (lazy > 0) & (lazy < 1),
            say("Lazy loading is inconsistent across pages (", percent0(lazy), " coverage)"),
        ),
        (lazy == 0, "Images are not using lazy loading"),
    )
    passed = messages(
        (secure, "HTTPS is enabled"),
        (robots, "robots.txt is present"),
        (sitemap, "sitemap.xml is present"),
        (broken == 0, "No broken links were reported"),
        (seconds < 3.0, say("Average load time is under 3 seconds (", shown, "s)")),
        (seconds < 1.5, "Average load time is under 1.5 seconds"),
        (view == 1, "Viewport meta tag is present on all scored pages"),
        (lazy == 1, "Images use lazy loading across all scored pages"),
    )
    return pillar(score, 95.0, issues, passed)


def site_link_inputs(facts: DataFrame, site_meta: DataFrame) -> DataFrame:
    """Graph counts and anchor statistics of each site.

    The score only asks for depths up to three, so three rounds of the search
    are enough whatever the depth of the site.
    """
    pages, pairs = materialised(links.nodes(facts)), materialised(links.edges(facts))
    homes = graph.homepages(facts, site_meta)
    depths = graph.click_depths(pages, pairs, homes, rounds=3)
    positions = graph.page_positions(depths, graph.in_degrees(pairs), homes)
    return (
        links.site_anchor_stats(facts)
        .join(graph.position_counts(positions), "site", "left")
        .join(homes, "site", "left")
    )


def site_links(inputs: DataFrame) -> DataFrame:
    return inputs.select("*", _site_links().alias("links_architecture"))


# Points, limits and messages.
@cache
def _site_links() -> Column:
    orphans, deep, bad, unsafe = (F.col(c) for c in ("orphans", "deep", "bad_anchors", "unprotected"))
    shallow = F.col("shallow").cast("double") / F.col("nodes").cast("double")
    kinds, total = F.col("distinct_anchors"), F.col("all_anchors")
    ratio = F.when(total > 0, kinds.cast("double") / total.cast("double")).otherwise(F.lit(1.0))
    varied = (ratio >= 0.5) & (kinds >= 3)
    score = (
        100.0 - 10.0 * orphans - 5.0 * deep - 5.0 * bad
        + points((shallow >= 0.8, 10), (unsafe == 0, 10), (varied, 10))
    )
    issues = messages(
        (orphans > 0, say("Orphan pages detected: ", orphans)),
        (shallow < 0.8, say("Only ", percent0(shallow), " of pages are within two clicks of the homepage")),
        (deep > 0, say("Deep pages detected beyond click depth 3: ", deep)),
        (bad > 0, say("Weak anchor text found on ", bad, " link(s)")),
        (unsafe > 0, say(unsafe, " external link(s) are missing rel protection")),
        (~varied, "Anchor text variety is limited"),
    )
    passed = messages(
        (orphans == 0, "No orphan pages were detected"),
        (shallow >= 0.8, "Most pages are reachable within two clicks of the homepage"),
        (deep == 0, "No pages exceed click depth 3"),
        (bad == 0, "Anchor text avoids generic phrases like 'click here'"),
        (unsafe == 0, "External links use safe rel attributes"),
        (varied, "Anchor text variety is healthy"),
    )
    return pillar(score, 100.0, issues, passed)


def pillar_means(scores: DataFrame) -> DataFrame:
    """Mean page score of each pillar per site."""
    names = [n for n in PILLAR_WEIGHTS if n != "authority"]
    agg = scores.groupBy("site").agg(
        F.count("*").alias("n"), *[F.sum(cents(F.col(n)["score"])).alias(n) for n in names]
    )
    return agg.select("site", "n", *[mean_of_cents(F.col(n), F.col("n")).alias(n) for n in names])


def pillar_messages(scores: DataFrame) -> DataFrame:
    """Distinct messages of the page pillars per site, with first place and page count."""
    names = ["on_page_seo", "content_quality", "ux_design"]
    lists = [_tagged(n, kind) for n in names for kind in ("issues", "passed")]
    rows = scores.transform(unrolled, ["site", "page_id"], F.concat(*lists), "m").select("site", "page_id", "m.*")
    return rows.groupBy("site", "pillar", "kind", "message").agg(
        F.count("*").alias("pages"), F.min(F.struct("page_id", "i")).alias("first_place")
    )


def _tagged(name: str, kind: str) -> Column:
    return F.transform(
        F.col(name)[kind],
        lambda m, i: F.struct(
            F.lit(name).alias("pillar"), F.lit(kind).alias("kind"), m.alias("message"), i.alias("i")
        ),
    )


def blended(site_score: Column, page_mean: Column) -> Column:
    """Seven tenths of the site score, three tenths of the page mean."""
    return round2(clamp(site_score * 0.7 + page_mean * 0.3))


def site_scores(
    means: DataFrame, technical: DataFrame, site_link_scores: DataFrame, authority: DataFrame
) -> DataFrame:
    """Six pillar scores, the overall score, grade and label of each site."""
    rows = (
        means.join(technical.select("site", F.col("technical_seo.score").alias("site_technical")), "site")
        .join(site_link_scores.select("site", F.col("links_architecture.score").alias("site_links")), "site")
        .join(authority.select(F.col("domain").alias("site"), F.col("authority.score").alias("authority")), "site")
        .select(
            "site",
            F.col("n").alias("pages"),
            round2(F.col("on_page_seo")).alias("on_page_seo"),
            round2(F.col("content_quality")).alias("content_quality"),
            blended(F.col("site_technical"), F.col("technical_seo")).alias("technical_seo"),
            "authority",
            round2(F.col("ux_design")).alias("ux_design"),
            blended(F.col("site_links"), F.col("links_architecture")).alias("links_architecture"),
        )
    )
    overall = weighted({n: F.col(n) for n in PILLAR_WEIGHTS})
    return rows.withColumn("overall", overall).select(
        "*", grade(F.col("overall")).alias("grade"), label(F.col("overall")).alias("label")
    )
