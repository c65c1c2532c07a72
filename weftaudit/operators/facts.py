"""Page facts: one wide row per page, computed inside the row.

``tokenised`` adds the token array, ``page_facts`` derives everything else
from it in a few projections. There is no exchange in the plan, and a reader
that selects a few facts pays only for those (column pruning).
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftaudit.functions import cms, html, text, urls
from weftaudit.functions.common import bind, messages, say, strip
from weftaudit.functions.suggest import suggestion_list

HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
COUNTED_TAGS = ["nav", "article", "section", "div", "form", "table"]
FLAG_TAGS = ["header", "footer", "nav", "main", "article", "aside"]


def tokenised(pages: DataFrame) -> DataFrame:
    """Add ``host``, ``base`` (split page URL) and ``toks`` (token array)."""
    return pages.select("*", *_token_columns())


@cache
def _token_columns() -> tuple[Column, ...]:
    return (
        (F.coalesce(F.col("html"), F.lit("")) != "").alias("fetched"),
        urls.netloc(F.col("url")).alias("host"),
        urls.parts(F.col("url")).alias("base"),
        html.tokens(F.col("html")).alias("toks"),
    )


def _open(tag: str) -> Column:
    return F.filter(F.col("toks"), lambda t: (t["kind"] == "open") & (t["tag"] == tag))


def _first_attr(tag: str, name: str) -> Column:
    return html.attr_or(html.attributes(F.get(_open(tag), F.lit(0))["v"]), name)


def _last_meta(name: str) -> Column:
    hits = F.filter(F.col("metas"), lambda m: F.lower(html.attr_or(m, "name")) == name)
    return F.coalesce(html.attr(F.get(hits, F.size(hits) - 1), "content"), F.lit(""))


def first_meta(name: str) -> Column:
    """Content of the first meta tag of that exact name; null when there is none."""
    hits = F.filter(F.col("metas"), lambda m: html.attr(m, "name") == name)
    return F.when(F.size(hits) > 0, html.attr_or(F.get(hits, F.lit(0)), "content"))


def _last_wins(entries: Column) -> Column:
    """Sorted ``array<struct<key, value>>``; of equal keys the last entry stays: one sort, then the last of each run."""
    numbered = F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["value"].alias("value")))
    return bind(
        F.sort_array(numbered),
        lambda es: F.transform(
            F.filter(es, lambda e, i: ~F.coalesce(F.get(es, i + 1)["key"] == e["key"], F.lit(False))),
            lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")),
        ),
    )


def _entries(metas: Column, key) -> Column:
    return F.filter(
        F.transform(
            metas, lambda m: F.struct(key(m).alias("key"), html.attr_or(m, "content").alias("value"))
        ),
        lambda e: e["key"].isNotNull() & (e["key"] != ""),
    )


def _meta_key(m: Column) -> Column:
    return F.coalesce(
        F.nullif(F.lower(html.attr_or(m, "name")), F.lit("")), F.lower(html.attr_or(m, "property"))
    )


def _prefixed(attribute: str, prefix: str, keep_prefix: bool):
    def key(m: Column) -> Column:
        value = html.attr_or(m, attribute)
        shown = value if keep_prefix else F.replace(value, F.lit(prefix), F.lit(""))
        return F.when(value.startswith(prefix), shown)

    return key


def social_tags(metas: Column, attribute: str, prefix: str, keep_prefix: bool = False) -> Column:
    """Open Graph or card tags as sorted key/value pairs (an empty key can occur)."""
    pairs = F.transform(
        F.filter(metas, lambda m: html.attr_or(m, attribute).startswith(prefix)),
        lambda m: F.struct(
            _prefixed(attribute, prefix, keep_prefix)(m).alias("key"),
            html.attr_or(m, "content").alias("value"),
        ),
    )
    return _last_wins(pairs)


def pair_value(pairs: Column, key: str) -> Column:
    """Value of a key in ``array<struct<key, value>>``; null when absent."""
    return F.get(F.filter(pairs, lambda p: p["key"] == key), F.lit(0))["value"]


def _headings() -> Column:
    return F.transform(
        html.elements_with_text(F.col("toks"), HEADING_TAGS),
        lambda h: bind(
            html.attributes(h["v"]),
            lambda a: F.struct(
                F.substring(h["tag"], 2, 1).cast("int").alias("level"),
                h["pos"].alias("pos"),
                h["text"].alias("text"),
                html.attr_or(a, "id").alias("id"),
                html.class_list(a).alias("classes"),
            ),
        ),
    )


def _images() -> Column:
    def one(img: Column, i: Column) -> Column:
        def built(a: Column) -> Column:
            src = html.attr_or(a, "src")
            absolute = F.when(src == "", F.lit("")).otherwise(
                bind(urls.parts(src), lambda r: urls.resolve_parts(F.col("base"), src, r))
            )
            return F.struct(
                i.alias("index"),
                src.alias("src"),
                absolute.alias("absolute_src"),
                html.attr_or(a, "alt").alias("alt"),
                (html.attr_or(a, "alt") != "").alias("has_alt"),
                html.attr_or(a, "title").alias("title"),
                html.attr_or(a, "width").alias("width"),
                html.attr_or(a, "height").alias("height"),
                img["place"]["parent"].alias("placement_parent"),
                img["place"]["in_header"].alias("in_header"),
                img["place"]["in_footer"].alias("in_footer"),
                img["place"]["in_nav"].alias("in_nav"),
                img["place"]["in_article"].alias("in_article"),
                html.attr_or(a, "loading").alias("loading"),
                html.class_list(a).alias("classes"),
            )

        return bind(html.attributes(img["v"]), built)

    return F.transform(html.images_in_context(F.col("toks")), one)


def _anchors() -> Column:
    """Every anchor with its attributes and resolved address, skipped targets included."""
    read = F.transform(
        html.elements_with_text(F.col("toks"), ["a"]),
        lambda x: F.struct(
            x["pos"].alias("pos"), x["text"].alias("text"), html.attributes(x["v"]).alias("a")
        ),
    )
    with_href = F.transform(
        F.filter(read, lambda x: html.attr(x["a"], "href").isNotNull()),
        lambda x: F.struct(
            x["pos"].alias("pos"),
            x["text"].alias("text"),
            strip(html.attr(x["a"], "href")).alias("href"),
            html.attr_or(x["a"], "title").alias("title"),
            html.class_list(x["a"], "rel").alias("rel"),
            html.attr_or(x["a"], "target").alias("target"),
        ),
    )

    def resolved(x: Column) -> Column:
        target = F.when(x["href"] == "", F.col("url")).otherwise(
            bind(urls.parts(x["href"]), lambda r: urls.resolve_parts(F.col("base"), x["href"], r))
        )
        return bind(
            target,
            lambda u: F.struct(
                x["pos"].alias("pos"),
                x["text"].alias("text"),
                x["href"].alias("href"),
                u.alias("absolute_url"),
                x["title"].alias("title"),
                x["rel"].alias("rel"),
                x["target"].alias("target"),
                urls.is_internal(u, F.col("host")).alias("internal"),
            ),
        )

    return F.transform(with_href, resolved)


def _structure() -> Column:
    tags = F.col("tags")
    has = [F.array_contains(tags, t).alias(f"has_{t}") for t in FLAG_TAGS]
    counts = [
        F.size(F.filter(tags, lambda x: x == t)).cast("bigint").alias(f"{t}_count") for t in COUNTED_TAGS
    ]
    lists = F.size(F.filter(tags, lambda x: x.isin("ul", "ol"))).cast("bigint").alias("list_count")
    return F.struct(*has, *counts, lists)


def _json_ld() -> Column:
    scripts = F.filter(
        F.col("toks"), lambda t: (t["tag"] == "script") & t["kind"].isin("raw", "open")
    )
    typed = F.filter(
        scripts, lambda s: html.attr(html.attributes(s["v"]), "type") == "application/ld+json"
    )
    bodies = F.transform(
        typed,
        lambda s: strip(
            F.regexp_replace(
                F.regexp_replace(s["v"], html.OPEN_TAG_RE, ""), r"(?i)</script\s*>$", ""
            )
        ),
    )
    parsed = F.transform(
        bodies, lambda b: F.struct(b.alias("json"), F.try_parse_json(b).alias("data"))
    )
    return F.transform(
        F.filter(parsed, lambda p: p["data"].isNotNull()),
        lambda p: F.struct(
            F.try_variant_get(p["data"], "$['@type']", "string").alias("type"),
            F.try_variant_get(p["data"], "$.name", "string").alias("name"),
            p["json"].alias("json"),
        ),
    )


def _accessibility() -> Column:
    """Issues, warnings, good practices and score of the accessibility check."""
    missing = F.col("missing_alt_count")
    bare_forms = F.size(
        F.filter(
            F.col("form_ids"),
            lambda ids: F.exists(ids, lambda i: ~F.array_contains(F.col("label_for"), i)),
        )
    )
    landmarks = (F.array_contains(F.col("tags"), "main") | F.array_contains(F.col("roles"), "main")) & (
        F.array_contains(F.col("tags"), "nav") | F.array_contains(F.col("roles"), "navigation")
    )
    issues = messages((missing > 0, say(missing, " image(s) missing alt text")))
    warnings = F.concat(
        F.array_repeat(F.lit("Form input without associated label"), bare_forms),
        messages(
            (level_gap(F.col("heading_counts")), "Heading hierarchy skips levels"),
            (~landmarks, "Consider using semantic landmarks (main, nav)"),
        ),
    )
    good = messages(
        ((missing == 0) & (F.col("image_count") > 0), "All images have alt text"),
        (landmarks, "Page uses semantic landmarks"),
    )
    return bind(
        F.struct(issues.alias("issues"), warnings.alias("warnings"), good.alias("good_practices")),
        lambda a: F.struct(
            a["issues"].alias("issues"),
            a["warnings"].alias("warnings"),
            a["good_practices"].alias("good_practices"),
            F.greatest(
                F.lit(0), 100 - 20 * F.size(a["issues"]) - 10 * F.size(a["warnings"])
            ).cast("bigint").alias("score"),
        ),
    )


def present_levels(counts: Column) -> Column:
    """Heading levels that occur, ascending."""
    return F.filter(
        F.transform(counts, lambda n, i: F.when(n > 0, i + 1)), lambda x: x.isNotNull()
    )


def level_gap(counts: Column) -> Column:
    """True when two neighbouring present levels are more than one apart."""
    return bind(
        present_levels(counts),
        lambda lv: F.exists(
            F.transform(lv, lambda x, i: F.coalesce(F.get(lv, i + 1), x) - x), lambda d: d > 1
        ),
    )


# Building a large Column costs many calls into the JVM, so each list is made once
# per process; the Columns refer to their inputs by name only.


@cache
def _scan_columns() -> tuple[Column, ...]:
    """From tokens to raw parts."""
    toks = F.col("toks")
    return (
        html.visible_text(toks).alias("text_content"),
        F.transform(_open("meta"), lambda t: html.attributes(t["v"])).alias("metas"),
        F.get(html.elements_with_text(toks, ["title"]), F.lit(0))["text"].alias("title_text"),
        _headings().alias("headings"),
        _images().alias("images"),
        F.transform(_open("img"), lambda t: html.attr_or(html.attributes(t["v"]), "alt")).alias("image_alts"),
        _anchors().alias("anchors"),
        F.transform(F.filter(toks, lambda t: t["kind"] == "open"), lambda t: t["tag"]).alias("tags"),
        F.filter(
            F.transform(
                F.filter(toks, lambda t: (t["kind"] == "open") & t["v"].contains("role")),
                lambda t: html.attr_or(html.attributes(t["v"]), "role"),
            ),
            lambda r: r != "",
        ).alias("roles"),
        F.filter(
            F.transform(
                F.filter(toks, lambda t: (t["tag"] == "script") & t["kind"].isin("raw", "open")),
                lambda t: html.attr(html.attributes(t["v"]), "src"),
            ),
            lambda s: s.isNotNull(),
        ).alias("script_sources"),
        _json_ld().alias("json_ld"),
        _first_attr("html", "lang").alias("language"),
        F.coalesce(
            html.attr(
                F.get(
                    F.filter(
                        F.transform(_open("link"), lambda t: html.attributes(t["v"])),
                        lambda a: F.array_contains(html.class_list(a, "rel"), "canonical"),
                    ),
                    F.lit(0),
                ),
                "href",
            ),
            F.lit(""),
        ).alias("canonical_url"),
        html.form_inputs(toks).alias("form_ids"),
        F.transform(_open("label"), lambda t: html.attr_or(html.attributes(t["v"]), "for")).alias("label_for"),
    )


@cache
def _described_columns() -> tuple[Column, ...]:
    """From raw parts to described parts."""
    return (
        F.length("text_content").cast("bigint").alias("text_length"),
        F.coalesce("title_text", F.lit("")).alias("title"),
        F.col("title_text").isNotNull().alias("title_tag_found"),
        _last_meta("description").alias("meta_description"),
        _last_meta("keywords").alias("meta_keywords"),
        _last_meta("robots").alias("meta_robots"),
        _last_wins(_entries(F.col("metas"), _meta_key)).alias("meta_tags"),
        social_tags(F.col("metas"), "property", "og:").alias("open_graph"),
        social_tags(F.col("metas"), "name", "twitter:").alias("twitter_card"),
        text.words(F.col("text_content")).alias("words"),
        F.filter("anchors", lambda a: urls.is_link_href(a["href"])).alias("links"),
        F.transform(
            F.sequence(F.lit(1), F.lit(6)),
            lambda lv: F.size(F.filter("headings", lambda h: h["level"] == lv)).cast("bigint"),
        ).alias("heading_counts"),
        F.size("image_alts").cast("bigint").alias("image_count"),
        F.size(F.filter("image_alts", lambda a: a == "")).cast("bigint").alias("missing_alt_count"),
        _structure().alias("structure"),
        F.filter(
            F.array(*[F.lit(e) for e in html.SEMANTIC_ELEMENTS]),
            lambda e: F.array_contains(F.col("tags"), e),
        ).alias("semantic_elements"),
        cms.platform_scores(first_meta("generator"), F.col("script_sources"), F.col("html")).alias("cms_scores"),
        F.col("html").rlike(html.INLINE_COLOR_RE).alias("inline_color"),
    )


@cache
def _counted_columns() -> tuple[Column, ...]:
    """Lengths, counts and checks."""
    return (
        first_meta("description").alias("first_description"),
        F.length("title").cast("bigint").alias("title_length"),
        F.length("meta_description").cast("bigint").alias("meta_description_length"),
        F.size("words").cast("bigint").alias("word_count"),
        text.top_keywords(F.col("words")).alias("top_keywords"),
        F.get("heading_counts", F.lit(0)).alias("h1_count"),
        F.size(F.filter("links", lambda x: x["internal"])).cast("bigint").alias("internal_count"),
        F.size(F.filter("links", lambda x: ~x["internal"])).cast("bigint").alias("external_count"),
        _accessibility().alias("accessibility"),
        cms.detected(F.col("cms_scores")).alias("cms_detected"),
        cms.probable(F.col("cms_scores")).alias("cms_probable"),
    )


@cache
def _final_columns(timed: bool) -> tuple[Column, ...]:
    """Flags and suggestions."""
    load_time = F.col("load_time") if timed else F.lit(None).cast("double")
    return (
        (F.col("title") != "").alias("has_title"),
        (F.col("meta_description") != "").alias("has_meta_description"),
        F.col("title_length").between(50, 60).alias("title_optimal"),
        F.col("meta_description_length").between(150, 160).alias("description_optimal"),
        F.coalesce(pair_value(F.col("meta_tags"), "viewport"), F.lit("")).alias("viewport"),
        pair_value(F.col("meta_tags"), "viewport").isNotNull().alias("viewport_tag"),
        suggestion_list(load_time).alias("suggestions"),
    )


SCANNED_KEPT = [
    "fetched", "host", "html", "text_content", "metas", "headings", "images", "tags", "roles", "json_ld",
    "language", "canonical_url", "form_ids", "label_for", "anchors",
]
DESCRIBED_KEPT = [
    "fetched", "host", "text_content", "text_length", "title", "title_tag_found", "meta_description",
    "meta_keywords", "meta_robots", "meta_tags", "open_graph", "twitter_card", "headings",
    "heading_counts", "images", "image_count", "missing_alt_count", "links", "structure",
    "semantic_elements", "json_ld", "language", "canonical_url", "inline_color", "cms_scores",
    "anchors",
]


def page_facts(pages: DataFrame) -> DataFrame:
    """All page facts. Empty pages come out in full shape with zeros and empties."""
    kept = [c for c in pages.columns if c != "html"]
    scanned = tokenised(pages).select(*kept, "fetched", "html", "host", "base", *_scan_columns())
    described = scanned.select(*kept, *SCANNED_KEPT, *_described_columns())
    counted = described.select(*kept, *DESCRIBED_KEPT, *_counted_columns())
    return counted.select("*", *_final_columns("load_time" in kept))
