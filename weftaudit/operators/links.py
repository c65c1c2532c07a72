"""Link tables, broken links, edges and anchor statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftaudit.functions import urls
from weftaudit.functions.common import strip
from weftaudit.operators.rows import unrolled

# Anchor texts that count as weak, and rel values that protect a link.
BAD_ANCHORS = ["click here", "here", "read more", "learn more", "more", ""]
SAFE_RELS = ["nofollow", "noopener", "noreferrer"]


def ordered_links() -> Column:
    """Internal links first, then external ones, each in document order."""
    return F.concat(F.filter("links", lambda x: x["internal"]), F.filter("links", lambda x: ~x["internal"]))


def link_table(facts: DataFrame, sample: int | None = None) -> DataFrame:
    """One row per link; ``sample`` keeps the first links of each page only."""
    links = ordered_links() if sample is None else F.slice(ordered_links(), 1, sample)
    return facts.transform(unrolled, ["site", "page_id", "url"], links, "l", "rank").select(
        "site", "page_id", "url", F.col("rank").cast("bigint").alias("rank"), "l.*"
    )


def request_url(url: Column) -> Column:
    """The address a request would ask for: no fragment."""
    return F.regexp_replace(url, r"(?s)#.*$", "")


def broken_links(
    facts: DataFrame, link_status: DataFrame, sample: int | None = None, once: bool = False
) -> DataFrame:
    """Links with status 400 and above, or 0 for an unreachable target.

    ``once`` checks each address of a page one time only. A target linked from
    everywhere is a hot key; the join is plain, so adaptive execution splits its rows.
    """
    table = link_table(facts, sample).select(
        "site", "page_id", "url", "rank", "text", request_url(F.col("absolute_url")).alias("target")
    )
    if once:
        table = table.groupBy("site", "page_id", "url", "target").agg(
            F.min("rank").alias("rank"), F.min_by("text", "rank").alias("text")
        )
    status = link_status.groupBy(F.col("url").alias("target")).agg(F.max("status_code").alias("status_code"))
    hit = table.join(status, "target")
    return hit.where((F.col("status_code") >= 400) | (F.col("status_code") == 0))


def with_broken_count(facts: DataFrame, broken: DataFrame) -> DataFrame:
    counts = broken.groupBy("page_id").agg(F.count("*").alias("broken_count"))
    return facts.join(counts, "page_id", "left").withColumn(
        "broken_count", F.coalesce("broken_count", F.lit(0).cast("bigint"))
    )


def nodes(facts: DataFrame) -> DataFrame:
    """Distinct graph keys of the stored pages."""
    return facts.where(F.col("url") != "").select("site", urls.graph_key(F.col("url")).alias("node")).distinct()


def edges(facts: DataFrame) -> DataFrame:
    """Distinct links between stored pages of a site, without self loops.

    Targets are made distinct inside each page first. A homepage may be the target of most
    links; the semi-join is plain, so adaptive execution splits its rows.
    """
    targets = F.array_distinct(
        F.transform(F.filter("links", lambda x: x["internal"]), lambda x: urls.graph_key(x["absolute_url"]))
    )
    pairs = (
        facts.where(F.col("url") != "")
        .transform(unrolled, ["site", urls.graph_key(F.col("url")).alias("src")], targets, "node")
        .where((F.col("src") != F.col("node")) & (F.col("src") != ""))
    )
    inside = pairs.join(nodes(facts), ["site", "node"], "left_semi")
    return inside.select("site", "src", F.col("node").alias("dst")).distinct()


def anchor_key(text: Column) -> Column:
    return F.lower(strip(text))


def unprotected() -> Column:
    """Number of external links of a page without a protecting rel value."""
    return F.size(
        F.filter(
            "links",
            lambda x: ~x["internal"]
            & ~F.arrays_overlap(
                F.transform(x["rel"], lambda r: F.lower(r)), F.array(*[F.lit(r) for r in SAFE_RELS])
            ),
        )
    ).cast("bigint")


def bad_anchors() -> Column:
    """Number of links of a page with a weak or empty text."""
    return F.size(F.filter("links", lambda x: anchor_key(x["text"]).isin(BAD_ANCHORS))).cast("bigint")


def page_anchor_stats(facts: DataFrame) -> DataFrame:
    """Per page: weak anchors, unprotected links, distinct non-empty and all anchor texts."""
    texts = F.transform("links", lambda x: anchor_key(x["text"]))
    return facts.select(
        "site",
        "page_id",
        bad_anchors().alias("bad_anchors"),
        unprotected().alias("unprotected"),
        F.size(F.array_distinct(F.filter(texts, lambda t: t != ""))).cast("bigint").alias("distinct_anchors"),
        F.size("links").cast("bigint").alias("all_anchors"),
        "external_count",
    )


def site_anchor_stats(facts: DataFrame) -> DataFrame:
    """Per site the same, with distinct texts counted over all pages.

    Texts are counted per page, then per (site, text), so a large site is
    spread over many tasks before its one result row is made.
    """
    texts = F.filter(F.transform("links", lambda x: anchor_key(x["text"])), lambda t: t != "")
    per_text = (
        facts.transform(unrolled, ["site"], texts, "anchor").groupBy("site", "anchor").agg(F.count("*").alias("n"))
    )
    variety = per_text.groupBy("site").agg(
        F.count("*").alias("distinct_anchors"), F.sum("n").alias("all_anchors")
    )
    sums = page_anchor_stats(facts).groupBy("site").agg(
        F.sum("bad_anchors").alias("bad_anchors"),
        F.sum("unprotected").alias("unprotected"),
        F.sum("external_count").alias("external_links"),
    )
    return sums.join(variety, "site", "left").select(
        "site",
        "bad_anchors",
        "unprotected",
        "external_links",
        F.coalesce("distinct_anchors", F.lit(0).cast("bigint")).alias("distinct_anchors"),
        F.coalesce("all_anchors", F.lit(0).cast("bigint")).alias("all_anchors"),
    )
