"""Registered queries: page extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftaudit.functions import html
from weftaudit.operators import single_page as sp
from weftaudit.operators.facts import page_facts, social_tags, tokenised
from weftaudit.operators.rows import unrolled
from weftaudit.sources.tables import derived


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return page_facts(derived(spark, sf, "pages_raw"))


def joined(column: str):
    return F.array_join(column, "|")


def html_tokens(spark, sf):
    return (
        tokenised(derived(spark, sf, "pages_raw"))
        .transform(unrolled, ["page_id"], "toks", "t")
        .select("page_id", F.col("t.pos").cast("bigint").alias("pos"), "t.kind", "t.tag", F.col("t.v").alias("value"))
    )


def html_ancestors(spark, sf):
    return (
        facts(spark, sf)
        .transform(unrolled, ["page_id"], "images", "i")
        .select(
            "page_id", F.col("i.index").cast("bigint").alias("index"), "i.placement_parent",
            "i.in_header", "i.in_footer", "i.in_nav", "i.in_article",
        )
    )


def html_visible_text(spark, sf):
    return facts(spark, sf).select("page_id", "text_content", "text_length")


def html_body_text(spark, sf):
    return sp.body_text(derived(spark, sf, "pages_raw")).select("page_id", "body_text")


def html_title(spark, sf):
    return facts(spark, sf).select("page_id", "title", "title_length", "title_tag_found")


def html_meta_tags(spark, sf):
    return facts(spark, sf).transform(unrolled, ["page_id"], "meta_tags", "m").select("page_id", "m.key", "m.value")


def html_named_metas(spark, sf):
    return facts(spark, sf).select(
        "page_id", "meta_description", "meta_description_length", "meta_keywords", "meta_robots", "first_description"
    )


def html_open_graph(spark, sf):
    return facts(spark, sf).transform(unrolled, ["page_id"], "open_graph", "m").select("page_id", "m.key", "m.value")


def html_twitter_card(spark, sf):
    """Card tags with the prefix kept, as the single-page profile reports them."""
    metas = tokenised(derived(spark, sf, "pages_raw")).select(
        "page_id",
        F.transform(
            F.filter("toks", lambda t: (t["kind"] == "open") & (t["tag"] == "meta")),
            lambda t: html.attributes(t["v"]),
        ).alias("metas"),
    )
    tags = metas.transform(unrolled, ["page_id"], social_tags(F.col("metas"), "name", "twitter:", keep_prefix=True), "m")
    return tags.select("page_id", "m.key", "m.value")


def html_canonical_language(spark, sf):
    return facts(spark, sf).select("page_id", "canonical_url", "language")


def html_headings(spark, sf):
    return sp.heading_table(facts(spark, sf)).select(
        "page_id", F.col("level").cast("bigint").alias("level"), F.col("pos").cast("bigint").alias("pos"),
        "text", "id", joined("classes").alias("classes"),
    )


def html_heading_counts(spark, sf):
    n = F.col("heading_counts")
    return facts(spark, sf).select(
        "page_id",
        *[F.get(n, F.lit(i)).alias(f"h{i + 1}") for i in range(6)],
        (F.col("h1_count") > 1).alias("has_multiple_h1"),
    )


def html_heading_issues(spark, sf):
    return facts(spark, sf).select(
        "page_id", F.array_join(sp.heading_issues(F.col("heading_counts")), "|").alias("issues")
    )


def html_images(spark, sf):
    return (
        facts(spark, sf)
        .transform(unrolled, ["page_id"], "images", "i")
        .select(
            "page_id", F.col("i.index").cast("bigint").alias("index"), "i.src", "i.absolute_src", "i.alt",
            "i.has_alt", "i.title", "i.width", "i.height", "i.placement_parent", "i.loading",
            F.array_join("i.classes", " ").alias("class"),
        )
    )


def html_missing_alt(spark, sf):
    return facts(spark, sf).select("page_id", "image_count", "missing_alt_count")


def html_image_placement(spark, sf):
    return (
        facts(spark, sf)
        .transform(unrolled, ["page_id"], "images", "i")
        .select(
            "page_id", (F.col("i.index") + 1).cast("bigint").alias("position"), F.col("i.absolute_src").alias("src"),
            sp.image_placement(F.col("i.placement_parent")).alias("placement"),
        )
    )


def html_links(spark, sf):
    return (
        facts(spark, sf)
        .transform(unrolled, ["page_id"], "links", "l")
        .select(
            "page_id", F.col("l.pos").cast("bigint").alias("pos"), "l.text", "l.href", "l.absolute_url",
            "l.title", F.array_join("l.rel", " ").alias("rel"), "l.target", "l.internal",
        )
    )


def html_plain_links(spark, sf):
    return (
        facts(spark, sf)
        .transform(unrolled, ["page_id"], sp.plain_links(F.col("anchors"), F.col("host")), "l")
        .select("page_id", F.col("l.pos").cast("bigint").alias("pos"), "l.url", "l.text", "l.has_text", "l.internal")
    )


def html_structure(spark, sf):
    return facts(spark, sf).select("page_id", "structure.*", joined("semantic_elements").alias("semantic_elements"))


def html_layout_issues(spark, sf):
    return facts(spark, sf).select("page_id", F.array_join(sp.layout_issues(F.col("structure")), "|").alias("issues"))


def html_json_ld(spark, sf):
    return (
        facts(spark, sf)
        .transform(unrolled, ["page_id"], "json_ld", "j", "ord")
        .select("page_id", F.col("ord").cast("bigint").alias("ord"), "j.type", "j.name", "j.json")
    )


def html_cms(spark, sf):
    return facts(spark, sf).select(
        "page_id", "cms_probable", joined("cms_detected").alias("cms_detected"),
        F.array_join(F.transform("cms_scores", lambda c: F.concat(c["cms"], F.lit("="), c["score"].cast("string"))), "|").alias("scores"),
    )


def html_accessibility(spark, sf):
    return facts(spark, sf).select(
        "page_id", joined("accessibility.issues").alias("issues"), joined("accessibility.warnings").alias("warnings"),
        joined("accessibility.good_practices").alias("good_practices"), F.col("accessibility.score").alias("score"),
    )


def html_seo_issues(spark, sf):
    return facts(spark, sf).select(
        "page_id",
        F.array_join(sp.seo_issues(F.col("title_tag_found"), F.col("title"), F.col("first_description")), "|").alias("issues"),
    )


def html_optimal_flags(spark, sf):
    return facts(spark, sf).select("page_id", "has_title", "has_meta_description", "title_optimal", "description_optimal")


def html_failed_defaults(spark, sf):
    return facts(spark, sf).where(~F.col("fetched")).select(
        "page_id", "url", "error", "status_code", "text_length", "word_count", "title", "meta_description",
        "image_count", "internal_count", "external_count", "h1_count", "has_title",
        joined("semantic_elements").alias("semantic_elements"),
    )


def html_inline_color(spark, sf):
    return facts(spark, sf).select("page_id", "inline_color")


def html_page_analysis(spark, sf):
    return facts(spark, sf).select(
        "page_id", "url", "status_code", "depth", "load_time", "text_length", "title", "title_length",
        "meta_description_length", "canonical_url", "language", "word_count", "h1_count", "image_count",
        "missing_alt_count", "internal_count", "external_count", "cms_probable",
        F.col("accessibility.score").alias("accessibility_score"),
        F.get(F.col("top_keywords"), F.lit(0))["word"].alias("first_keyword"),
        F.size("suggestions").cast("bigint").alias("suggestion_count"),
    )


QUERIES = {name: fn for name, fn in list(globals().items()) if name.startswith("html_")}
