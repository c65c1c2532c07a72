"""Registered queries: links, graph, scores and site roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftaudit.functions import urls
from weftaudit.functions.common import round2
from weftaudit.functions.grades import PILLAR_WEIGHTS, grade, label, normalised, weighted
from weftaudit.operators import authority, graph, links, robots, rollup, scoring
from weftaudit.operators import single_page as sp
from weftaudit.operators.rows import unrolled
from weftaudit.plans.queries_html import facts, joined
from weftaudit.sources.shared import materialised
from weftaudit.sources.tables import derived


def _meta(spark, sf):
    return derived(spark, sf, "site_meta")


def _status(spark, sf):
    return derived(spark, sf, "link_status")


def counted_facts(spark, sf, sample=None, once=False, columns=None):
    """Stored facts (all, or the named ones) with the number of broken links of each page."""
    f = facts(spark, sf)
    f = materialised(f if columns is None else f.select(*columns))
    return links.with_broken_count(f, links.broken_links(f, _status(spark, sf), sample, once))


def _metrics(spark, sf):
    return derived(spark, sf, "authority_metrics")


def _authority(spark, sf, f):
    return authority.authority_scores(f.select(F.col("site").alias("domain")).distinct(), _metrics(spark, sf))


def join_broken_links(spark, sf):
    b = links.broken_links(facts(spark, sf), _status(spark, sf))
    return b.select("page_id", "rank", "target", "status_code", "text")


def join_broken_links_sampled(spark, sf):
    """The sampling profiles: the first 10 links, and the first 50 with each address once."""
    f = materialised(facts(spark, sf))
    first10 = links.broken_links(f, _status(spark, sf), sample=10).select("page_id", "target", "rank", F.lit("ten").alias("profile"))
    first50 = links.broken_links(f, _status(spark, sf), sample=50, once=True).select("page_id", "target", "rank", F.lit("fifty").alias("profile"))
    return first10.unionByName(first50)


def join_edges(spark, sf):
    return links.edges(facts(spark, sf))


def join_alias_metrics(spark, sf):
    r = authority.resolved_metrics(_metrics(spark, sf))
    return r.select("domain", "provider", "label", "value")


def join_provider_choice(spark, sf):
    sites = derived(spark, sf, "pages_raw").select(F.col("site").alias("domain")).distinct()
    c = sites.join(authority.provider_choice(_metrics(spark, sf)), "domain", "left")
    return c.select("domain", "provider", F.col("provider").isNull().alias("educational_mode"), F.greatest(F.size("found"), F.lit(0)).cast("bigint").alias("metrics"))


def join_form_labels(spark, sf):
    """Form inputs with an id and no label."""
    f = facts_forms(spark, sf)
    return f.transform(unrolled, ["page_id"], "ids", "input_id")


def facts_forms(spark, sf):
    from weftaudit.functions import html
    from weftaudit.operators.facts import tokenised

    toks = tokenised(derived(spark, sf, "pages_raw"))
    labels = F.transform(
        F.filter("toks", lambda t: (t["kind"] == "open") & (t["tag"] == "label")),
        lambda t: html.attr_or(html.attributes(t["v"]), "for"),
    )
    ids = toks.select("page_id", F.flatten(html.form_inputs(F.col("toks"))).alias("i"), labels.alias("l"))
    return ids.select("page_id", F.array_except("i", "l").alias("ids"))


def agg_site_summary(spark, sf):
    return rollup.site_summary(facts(spark, sf))


def agg_site_summary_crawl(spark, sf):
    return rollup.site_summary(counted_facts(spark, sf, sample=10), count_broken=True, include_failed=True)


def _lists(df):
    return df.select("site", *[joined(k).alias(k) for k in ("critical", "warnings", "recommendations", "positive")])


def agg_insights(spark, sf):
    return _lists(rollup.site_insights(rollup.site_counts(facts(spark, sf))))


def agg_insights_crawl(spark, sf):
    counts = rollup.site_counts(counted_facts(spark, sf, sample=10), include_failed=True)
    return _lists(rollup.site_insights(counts, "crawl"))


def agg_insight_counts(spark, sf):
    return rollup.insight_counts(rollup.site_insights(rollup.site_counts(facts(spark, sf))))


def agg_suggestion_counts(spark, sf):
    return rollup.suggestion_counts(facts(spark, sf)).select("page_id", "critical", "high", "medium")


def agg_single_page_advice(spark, sf):
    advice = sp.site_advice(counted_facts(spark, sf, sample=50, once=True), ["site"])
    return advice.select("site", joined("lines").alias("lines"))


def _single_pages(spark, sf):
    f = counted_facts(spark, sf, sample=50, once=True)
    words = sp.body_keywords(derived(spark, sf, "pages_raw").select("page_id", "url", "html")).select("page_id", "plain_word_count")
    return f.join(words, "page_id").withColumn("seo_score", sp.seo_score())


def agg_single_page_summary(spark, sf):
    return _single_pages(spark, sf).where("fetched").select(
        "page_id", "url", "image_count", "missing_alt_count", "internal_count", "external_count", "broken_count",
        F.col("plain_word_count").alias("word_count"), "seo_score",
    )


def agg_page_ratios(spark, sf):
    """Share of pages with viewport and lazy images, and the average load time."""
    t = scoring.site_technical(facts(spark, sf).withColumn("broken_count", F.lit(0).cast("bigint")), _meta(spark, sf))
    return t.select("site", "seconds", "view", "lazy")


def agg_anchor_stats(spark, sf):
    s = links.site_anchor_stats(facts(spark, sf))
    return s.withColumn("variety", round2(F.col("distinct_anchors").cast("double") / F.col("all_anchors").cast("double")))


def agg_page_anchor_stats(spark, sf):
    return links.page_anchor_stats(facts(spark, sf)).drop("site")


def agg_fallback_scores(spark, sf):
    f = materialised(facts(spark, sf))
    return rollup.fallback_scores(rollup.site_summary(f), rollup.site_insights(rollup.site_counts(f)))


def agg_site_comparison(spark, sf):
    return rollup.site_comparison(_single_pages(spark, sf))


def agg_pillar_messages(spark, sf):
    p = _pillars(spark, sf)
    return scoring.pillar_messages(p).select(
        "site", "pillar", "kind", "message", "pages", F.col("first_place.page_id").alias("first_page"),
        F.col("first_place.i").cast("bigint").alias("first_pos"),
    )


def _pillars(spark, sf, whole_site=True):
    f = counted_facts(spark, sf, columns=scoring.SCORE_FACTS)
    return scoring.page_pillars(scoring.scoring_input(f, _meta(spark, sf), whole_site))


def _pillar_query(name):
    def run(spark, sf):
        p = _pillars(spark, sf).select("page_id", F.col(name).alias("p"))
        return p.select("page_id", "p.score", "p.grade", joined("p.issues").alias("issues"), joined("p.passed").alias("passed"))

    run.__name__ = f"scr_{name}"
    return run


scr_on_page_seo = _pillar_query("on_page_seo")
scr_content_quality = _pillar_query("content_quality")
scr_page_technical = _pillar_query("technical_seo")
scr_ux_design = _pillar_query("ux_design")
scr_page_links = _pillar_query("links_architecture")


def scr_grades(spark, sf):
    """Grades and labels over the values of all events."""
    v = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("value").alias("raw"))
    score = normalised(F.col("raw"), 85.0)
    return v.select("event_id", score.alias("score")).select("*", grade(F.col("score")).alias("grade"), label(F.col("score")).alias("label"))


def scr_weighted(spark, sf):
    """Weighted overall score of six figures made from each event."""
    v = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value", "user_id")
    parts = {n: F.col("value") + F.col("user_id") % (10 + i) for i, n in enumerate(PILLAR_WEIGHTS)}
    return v.select("event_id", weighted(parts).alias("overall"))


def scr_site_technical(spark, sf):
    t = scoring.site_technical(counted_facts(spark, sf), _meta(spark, sf)).select("site", F.col("technical_seo").alias("p"))
    return t.select("site", "p.score", "p.grade", joined("p.issues").alias("issues"), joined("p.passed").alias("passed"))


def scr_authority(spark, sf):
    sites = derived(spark, sf, "pages_raw").select(F.col("site").alias("domain")).distinct()
    a = authority.authority_scores(sites, _metrics(spark, sf))
    return a.select(
        "domain", "provider", "educational_mode", "authority.score", "authority.grade",
        joined("authority.issues").alias("issues"), joined("authority.passed").alias("passed"),
    )


def scr_authority_metrics(spark, sf):
    r = authority.resolved_metrics(_metrics(spark, sf))
    return r.select(
        "domain", "provider", "label", round2(authority.normalise_metric(F.col("value"), F.col("scale"))).alias("normalised")
    )


def scr_site_links(spark, sf):
    f = materialised(facts(spark, sf))
    p = scoring.site_links(scoring.site_link_inputs(f, _meta(spark, sf))).select("site", F.col("links_architecture").alias("p"))
    return p.select("site", "p.score", "p.grade", joined("p.issues").alias("issues"), joined("p.passed").alias("passed"))


def scr_checks(spark, sf):
    """Heading order and lazy images as single checks."""
    return facts(spark, sf).select(
        "page_id", scoring.valid_hierarchy(F.col("heading_counts")).alias("valid_hierarchy"),
        scoring.lazy_images(F.col("images")).alias("lazy"),
    )


def scr_page_scores(spark, sf):
    p = _pillars(spark, sf)
    s = scoring.page_scores(p, _authority(spark, sf, derived(spark, sf, "pages_raw")))
    return s.select("page_id", "overall", "grade", "label", *[F.col(f"{n}.score").alias(n) for n in PILLAR_WEIGHTS])


def scr_single_page(spark, sf):
    """Each page scored alone: no other page can repeat its opening."""
    p = _pillars(spark, sf, whole_site=False)
    s = scoring.page_scores(p, _authority(spark, sf, derived(spark, sf, "pages_raw")))
    return s.select("page_id", "overall", "grade", F.col("content_quality.score").alias("content_quality"))


def scr_site_scores(spark, sf):
    f = counted_facts(spark, sf, columns=scoring.SCORE_FACTS)
    meta = _meta(spark, sf)
    pages = scoring.page_pillars(scoring.scoring_input(f, meta))
    return scoring.site_scores(
        scoring.pillar_means(pages), scoring.site_technical(f, meta),
        scoring.site_links(scoring.site_link_inputs(f, meta)), _authority(spark, sf, f),
    )


def scr_seo_score(spark, sf):
    return counted_facts(spark, sf, sample=50, once=True).select("page_id", sp.seo_score().alias("seo_score"))


def scr_quality_gate(spark, sf):
    """Pass or fail of each page; all its links are checked, each address once."""
    pages = counted_facts(spark, sf, once=True).withColumn("seo_score", sp.seo_score())
    return rollup.quality_gate(pages).select("page_id", "passed", joined("failed").alias("failed"))


def graph_in_degree(spark, sf):
    return graph.in_degrees(links.edges(facts(spark, sf)))


def graph_homepage(spark, sf):
    return graph.homepages(facts(spark, sf), _meta(spark, sf))


def _graph(spark, sf):
    f = materialised(facts(spark, sf).select("site", "page_id", "url", "links"))
    return materialised(links.nodes(f)), materialised(links.edges(f)), graph.homepages(f, _meta(spark, sf))


def graph_click_depth(spark, sf):
    return graph.click_depths(*_graph(spark, sf))


def graph_positions(spark, sf):
    pages, pairs, homes = _graph(spark, sf)
    depths = graph.click_depths(pages, pairs, homes)
    return graph.page_positions(depths, graph.in_degrees(pairs), homes)


def graph_position_counts(spark, sf):
    return graph.position_counts(graph_positions(spark, sf))


def graph_crawl_order(spark, sf):
    f = materialised(facts(spark, sf).select("site", "page_id", "url", "links", "fetched"))
    rules = materialised(robots.active_rules(derived(spark, sf, "robots_rules"), "auditor"))
    seeds = f.select("site").distinct().select("site", F.concat(F.lit("https://"), "site", F.lit("/p/0")).alias("url"))
    stored = f.where("fetched").select("site", urls.crawl_key(F.col("url")).alias("url"))
    return graph.crawl_order(materialised(graph.crawl_links(f)), stored, seeds, rules, max_pages=50, max_depth=3)


QUERIES = {
    name: fn for name, fn in list(globals().items()) if name.startswith(("join_", "agg_", "scr_", "graph_"))
}
