"""Registered queries: recommendations, reports, answers, jobs, sources and sets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftaudit.functions import urls
from weftaudit.operators import addresses, authority, links, ops, qa, recommend, report, rollup, scoring
from weftaudit.operators.facts import page_facts
from weftaudit.operators.numbering import numbered
from weftaudit.operators.rows import unrolled
from weftaudit.plans.queries_html import facts, joined
from weftaudit.plans.queries_site import counted_facts
from weftaudit.sources import pages as src
from weftaudit.sources import shared
from weftaudit.sources.shared import materialised
from weftaudit.sources.tables import derived, table


def _meta(spark, sf):
    return derived(spark, sf, "site_meta")


# Recommendations


def rec_suggestions(spark, sf):
    return facts(spark, sf).transform(unrolled, ["page_id"], "suggestions", "s", "ord").select(
        "page_id", F.col("ord").cast("bigint").alias("ord"), "s.*"
    )


def _rule_rows(spark, sf, prefixes):
    rows = recommend.page_rules(facts(spark, sf), _meta(spark, sf))
    keep = F.lit(False)
    for p in prefixes:
        keep = keep | F.col("rule").startswith(p)
    fix = recommend.exact_fix(F.col("rule"), F.col("draft")).alias("exact_fix")
    return rows.where(keep).select("page_id", "rule", "severity", "current_state", fix)


def _scores(spark, sf, f, broken):
    """The score of every page in stored facts whose rules read one: those with a long title.

    Pillars are worked out only for pages of the same addresses, and those of whole sites only if
    a page has none of its own. Shared openings are looked for among all pages.
    """
    meta, metrics = _meta(spark, sf), derived(spark, sf, "authority_metrics")
    asked = materialised(recommend.score_readers(f).select("site", "page_id", "url"))
    if asked.isEmpty():
        return asked.select("site", "page_id", F.lit(recommend.UNSCORED).alias("overall"))
    counted = links.with_broken_count(f.select(*scoring.SCORE_FACTS), broken)
    found = authority.authority_scores(f.select(F.col("site").alias("domain")).distinct(), metrics)
    rows = scoring.scoring_input(counted, meta)
    key = urls.lookup_key(F.col("url"))
    keys = asked.select("site", key.alias("key")).distinct()
    some = rows.withColumn("key", key).join(keys, ["site", "key"], "left_semi")

    def of_sites():
        inputs = scoring.site_links(scoring.site_link_inputs(counted, meta))
        return scoring.site_scores(scoring.pillar_means(scoring.page_pillars(rows)), scoring.site_technical(counted, meta), inputs, found)

    scores = scoring.page_scores(scoring.page_pillars(some), found).select("site", "page_id", "url", "overall")
    return recommend.resolved_scores(asked, scores, of_sites)


def rec_titles(spark, sf):
    """Title rules; the severity of a long title reads the score of the page."""
    f = materialised(facts(spark, sf))
    scores = _scores(spark, sf, f, links.broken_links(f, derived(spark, sf, "link_status")))
    rows = recommend.page_rules(f, _meta(spark, sf), scores).where(F.col("rule").startswith("title_"))
    return rows.select("page_id", "rule", "severity", "current_state", recommend.exact_fix(F.col("rule"), F.col("draft")).alias("exact_fix"))


def rec_descriptions(spark, sf):
    return _rule_rows(spark, sf, ["meta_"])


def rec_h1(spark, sf):
    return _rule_rows(spark, sf, ["h1_"])


def rec_images(spark, sf):
    return _rule_rows(spark, sf, ["image_"])


def rec_content(spark, sf):
    return _rule_rows(spark, sf, ["thin_", "viewport", "stuffing"])


def rec_anchors(spark, sf):
    return recommend.anchor_rules(materialised(facts(spark, sf))).select(
        "page_id", "ord", "severity", "current_state", F.col("draft").alias("exact_fix")
    )


def rec_broken(spark, sf):
    b = links.broken_links(facts(spark, sf), derived(spark, sf, "link_status"))
    return recommend.broken_rules(b).select("page_id", "severity", "current_state")


def rec_site(spark, sf):
    rows = recommend.site_rules(facts(spark, sf), _meta(spark, sf))
    return rows.select("site", "page_url", "rule", "severity", "current_state", F.col("draft").alias("exact_fix"))


def _all_rows(spark, sf):
    f = materialised(facts(spark, sf))
    broken = materialised(links.broken_links(f, derived(spark, sf, "link_status")))
    scores = _scores(spark, sf, f, broken)
    return recommend.recommendations(f, _meta(spark, sf), broken, scores)


def rec_all(spark, sf):
    return _all_rows(spark, sf).select("site", "page_id", "page_url", "rule", "severity", "current_state", "exact_fix")


def rec_merged(spark, sf):
    return recommend.merged(_all_rows(spark, sf)).drop("rec_id")


def rec_merged_urls(spark, sf):
    return recommend.merged_urls(_all_rows(spark, sf)).drop("rec_id")


def rec_merged_states(spark, sf):
    """The states of each merged recommendation, which of them are kept, and their places in the joined state."""
    return recommend.kept_states(recommend.merged_states(_all_rows(spark, sf))).select(
        "site", "rule", "severity", "exact_fix", "current_state", F.col("place.page_id").alias("first_page"), "kept", "ord"
    )


def rec_joined_states(spark, sf):
    """The kept states of each merged recommendation as one text."""
    return recommend.joined_states(recommend.kept_states(recommend.merged_states(_all_rows(spark, sf)))).drop("rec_id")


def rec_ordered(spark, sf):
    """Merged recommendations with pillar, element, texts and rank of severity."""
    done = recommend.ordered(recommend.merged(_all_rows(spark, sf)), recommend.rule_table(spark))
    return done.select(
        "site", "pillar", "severity", "element", "why_it_matters", "exact_fix", "placement_instructions", "estimated_impact",
        "n_pages", "first_url", recommend.severity_rank(F.col("severity")).cast("bigint").alias("severity_rank"),
    )


def rec_platform_steps(spark, sf):
    """The steps per platform for each rule that fired on a site."""
    fired = _all_rows(spark, sf).groupBy("site", "rule").agg(F.count("*").alias("n_rows"))
    full = fired.join(F.broadcast(recommend.rule_table(spark)), "rule")
    return full.select("site", "rule", "n_rows", F.explode("platform_steps").alias("platform", "steps"))


def rec_fallback(spark, sf):
    return rollup.fallback_recommendations(rollup.site_insights(rollup.site_counts(facts(spark, sf))))


# Reports


def _assembled(spark, sf, f):
    rows = report.assembled(
        rollup.site_summary(f), rollup.site_insights(rollup.site_counts(f)), report.metadata(f)
    )
    return rows.withColumn("analysis_date", F.lit("2024-01-31 00:00:00"))


def _site_facts(spark, sf):
    return materialised(facts(spark, sf).select(*rollup.SITE_FACTS))


def _report(spark, sf, column):
    f = _site_facts(spark, sf)
    return _assembled(spark, sf, f).select("site", column.alias("report"))


def rpt_text(spark, sf):
    return _report(spark, sf, report.text_report())


def rpt_executive_summary(spark, sf):
    return _report(spark, sf, report.executive_summary())


def rpt_email(spark, sf):
    return _report(spark, sf, report.email_summary())


def rpt_html(spark, sf):
    return _report(spark, sf, report.html_report())


def rpt_text_pages(spark, sf):
    return report.text_sections(materialised(facts(spark, sf).select(*report.TEXT_FACTS))).drop("page_id")


def rpt_html_pages(spark, sf):
    return report.html_sections(materialised(facts(spark, sf).select(*report.HTML_FACTS))).drop("page_id")


def rpt_assembly(spark, sf):
    rows = _assembled(spark, sf, _site_facts(spark, sf))
    return rows.select(
        "site", "base_url", "domain", "pages_crawled", "total_pages_analyzed", "avg_word_count",
        *[joined(k).alias(k) for k in report.KINDS],
    )


def rpt_page_lookup(spark, sf):
    """The card of the first page of each site with that address, its first broken links included; found by an index of addresses."""
    pages = derived(spark, sf, "pages_raw")
    index = addresses.AddressIndex(spark, shared.fresh_path(spark, "addresses"))
    index.add(materialised(pages.select("page_id", "site", "url")))
    wanted = materialised(index.first_of_sites("/p/2"))
    found = materialised(page_facts(pages.join(wanted, ["site", "page_id"], "left_semi")).select(*report.CARD_FACTS))
    shown = report.broken_items(links.broken_links(found, derived(spark, sf, "link_status")))
    rows = found.join(shown, "page_id", "left")
    return rows.select("site", "page_id", report.page_card(F.col("broken_items"), F.coalesce("broken_links", F.lit(0))).alias("card"))


# Answers


def _site_figures(spark, sf):
    f = _site_facts(spark, sf)
    counts = rollup.site_counts(f)
    insights = rollup.site_insights(counts)
    rows = (
        report.assembled(rollup.site_summary(f), insights, report.metadata(f))
        .join(counts.select("site", "no_title", "no_description", "no_h1"), "site", "left")
        .join(rollup.insight_counts(insights), "site", "left")
        .join(rollup.fallback_scores(rollup.site_summary(f), insights), "site", "left")
        .join(qa.site_platform(f), "site", "left")
    )
    return materialised(rows)


def _questions(spark, sf):
    asked = qa.normalised(derived(spark, sf, "chat_messages")).where(F.col("role") == "user")
    return asked.join(_site_figures(spark, sf), ["site"], "left")


def qa_topics(spark, sf):
    asked = qa.normalised(derived(spark, sf, "chat_messages")).where(F.col("role") == "user")
    return asked.select(
        "conv_id", "turn", F.array_join(qa.topics_of(F.col("text")), "|").alias("topics"), qa.wants_plan(F.col("text")).alias("plan")
    )


def qa_answers(spark, sf):
    return qa.answers(_questions(spark, sf)).select("conv_id", "turn", "answer")


def qa_short_answers(spark, sf):
    return _questions(spark, sf).select("conv_id", "turn", qa.short_answer().alias("answer"))


def qa_cms(spark, sf):
    return _questions(spark, sf).select("conv_id", "turn", qa.cms_named(F.col("text"), F.col("site_cms")).alias("cms"))


def qa_site_prompt(spark, sf):
    return _site_figures(spark, sf).select("site", qa.site_prompt().alias("prompt"))


def qa_page_lines(spark, sf):
    """The first five pages of each site as highlight lines."""
    first = Window.partitionBy("site").orderBy("page_id")
    rows = facts(spark, sf).select("site", "page_id", qa.page_line().alias("line"))
    ranked = rows.withColumn("place", F.row_number().over(first)).where("place <= 5")
    return ranked.select("site", F.col("place").cast("bigint").alias("place"), "line")


def qa_conversations(spark, sf):
    return qa.conversation_state(derived(spark, sf, "chat_messages"))


def qa_system_prompts(spark, sf):
    """The system prompt of each conversation that has one."""
    return qa.system_prompts(derived(spark, sf, "chat_messages"))


def qa_messages_without_system(spark, sf):
    """The other messages with their line of the prompt."""
    rows = qa.without_system(derived(spark, sf, "chat_messages"))
    return rows.select("conv_id", "turn", "role", "text", qa.prompt_line().alias("line"))


def qa_extended_answers(spark, sf):
    """Answers of a stand-in for a user's function, which repeats long questions and leaves the others to the rules."""

    def reply(text: pd.Series, answer: pd.Series) -> pd.Series:
        return ("You asked: " + text.str.slice(0, 40)).where(text.str.len() > 30, None)

    return qa.with_extension(qa.answers(_questions(spark, sf)), F.pandas_udf(reply, "string")).select("conv_id", "turn", "answer")


def rec_rewritten(spark, sf):
    """Titles rewritten by a stand-in for a user's model, which repeats the draft with a word before it."""

    def reply(prompt: pd.Series) -> pd.Series:
        return "Guide: " + prompt.str.replace(r"(?s)^.*Draft: ", "", regex=True)

    rows = recommend.page_rules(facts(spark, sf), _meta(spark, sf))
    done = recommend.rewritten(rows, recommend.guarded(reply))
    return done.where(F.col("rule").startswith("title_")).select("page_id", "rule", F.col("draft").alias("title"))


# Jobs, logs and monitoring


def ops_latest_status(spark, sf):
    return ops.latest_status(table(spark, sf, "events"), "user_id", "event_type", "ts", "event_id")


def ops_pending(spark, sf):
    """Jobs still waiting: the newest status of a job is view."""
    return ops_latest_status(spark, sf).where(F.col("status") == "view").select("user_id", "changed_at")


def ops_funnel(spark, sf):
    return ops.status_funnel(derived(spark, sf, "jobs"))


def ops_audit_rollup(spark, sf):
    return ops.audit_rollup(table(spark, sf, "events"), "user_id", "event_type", "ts")


def ops_progress(spark, sf):
    stage = (
        F.when(F.col("event_type") == "view", "crawl").when(F.col("event_type") == "click", "analyze")
        .when(F.col("event_type") == "signup", "score").when(F.col("event_type") == "purchase", "finish").otherwise("done")
    )
    return table(spark, sf, "events").select("event_id", ops.progress(stage, F.col("value") / 50.0).alias("progress"))


def ops_monthly_usage(spark, sf):
    return ops.monthly_usage(table(spark, sf, "events"), "user_id", "ts", 60)


def join_tier_limits(spark, sf):
    return ops.clamped_requests(derived(spark, sf, "jobs")).select("job_id", "tier", "pages_allowed", "depth_allowed")


def sort_jobs(spark, sf):
    return ops.list_jobs(derived(spark, sf, "jobs"), limit=100, offset=20).select("job_id", "owner", "status", "created_at")


def sort_owner_jobs(spark, sf):
    return ops.list_jobs(derived(spark, sf, "jobs"), owner=7, limit=10, offset=2).select("job_id", "owner", "created_at")


def win_audit_changes(spark, sf):
    return ops.audit_changes(derived(spark, sf, "audit_history"))


def win_history(spark, sf):
    return ops.last_messages(table(spark, sf, "conversations"), 20).select("conv_id", "turn", "role", "text", "back")


def win_latest_conversation(spark, sf):
    """The newest conversation of each site, replayed in order."""
    rows = derived(spark, sf, "chat_messages")
    newest = rows.groupBy("site").agg(F.max("conv_id").alias("conv_id"))
    return rows.join(newest, ["site", "conv_id"], "left_semi").select("site", "conv_id", "turn", "role", "text")


def win_page_numbers(spark, sf):
    """Place of each page in its site, from key ranges numbered apart."""
    rows = derived(spark, sf, "pages_raw").select("site", "page_id")
    return numbered(rows, "site", "page_id", "number", bucket=16)


# Sources, sinks and sets


def src_snapshots(spark, sf):
    """The given pages as snapshots: site, status and depth filled in."""
    s = src.page_snapshots(table(spark, sf, "pages"))
    return s.select("page_id", "site", "url", F.length("html").cast("bigint").alias("html_length"), "status_code", "depth", "load_time", "error")


def src_page_dumps(spark, sf):
    """All pages written as dump files and read back."""
    path = shared.fresh_path(spark, "dumps")
    src.write_page_dumps(derived(spark, sf, "pages_raw"), path, pages_per_file=100)
    back = src.read_page_dumps(spark, path)
    return back.select("page_id", "site", "url", F.md5("html").alias("html_md5"), "status_code", "depth", "load_time", "error")


def src_site_meta(spark, sf):
    """Site facts as a loader gives them: names trimmed and in lower case, one row per site."""
    rows = derived(spark, sf, "site_meta")
    mixed = rows.withColumn("site", F.concat(F.upper("site"), F.lit(" ")))
    return src.read_site_meta(spark, _stored(spark, mixed.unionByName(mixed), "json"), "json")


def _stored(spark, rows, file_format):
    path = shared.fresh_path(spark, file_format)
    rows.write.format(file_format).save(path)
    return path


def src_link_status(spark, sf):
    """Checks of links, some repeated with another result, written as JSON and loaded again."""
    rows = derived(spark, sf, "link_status")
    again = rows.where("status_code = 200").select(F.concat(F.lit(" "), "url").alias("url"), F.lit(None).cast("bigint").alias("status_code"))
    return src.read_link_status(spark, _stored(spark, rows.unionByName(again), "json"), "json")


def src_authority_metrics(spark, sf):
    rows = derived(spark, sf, "authority_metrics").select("domain", "provider", "priority", "metric", "value")
    mixed = rows.withColumn("domain", F.concat(F.lit("  "), F.upper("domain")))
    return src.read_authority_metrics(spark, _stored(spark, mixed, "orc"), "orc")


def src_saved_reports(spark, sf):
    """Saved report documents, one for each page here, loaded with one row per page."""
    documents = facts(spark, sf).select(
        F.to_json(
            F.struct(
                F.struct(F.col("url").alias("base_url"), F.col("site").alias("domain"), F.lit(1).cast("bigint").alias("pages_crawled")).alias("metadata"),
                F.struct(F.col("image_count").alias("total_images"), F.col("word_count").alias("avg_word_count")).alias("summary"),
                F.array(F.struct("url", "status_code", "error", "text_length")).alias("pages"),
            )
        ).alias("value")
    )
    loaded = src.load_report(spark, _stored(spark, documents, "text"), lines=True)
    return loaded.select("page.url", "page.status_code", "page.error", "page.text_length", "metadata.domain", "summary.total_images")


def snk_log(spark, sf):
    """A log appended twice by day and read back."""
    path = shared.fresh_path(spark, "log")
    log = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    for part in (0, 1):
        src.append_log(log.where(F.col("event_id") % 2 == part), path, "ts")
    return spark.read.schema("event_id bigint, user_id bigint, event_type string, ts timestamp_ntz, day date").parquet(path)


def snk_job_updates(spark, sf):
    """Stored jobs after two rounds of updates, of which the first comes again afterwards and changes nothing."""
    jobs = ops.job_table(spark, shared.fresh_path(spark, "jobs"))
    ops.create_jobs(jobs, "create", derived(spark, sf, "jobs"))
    updates = derived(spark, sf, "job_updates")
    for part in (0, 1, 0):
        ops.update_jobs(jobs, f"round {part}", updates.where(F.col("part") == part))
    return jobs.rows()


def src_page_payload(spark, sf):
    """Stored JSON over row columns."""
    rows = derived(spark, sf, "pages_raw").select(
        "page_id", "url", "status_code", "depth", "load_time",
        F.to_json(
            F.struct(
                F.when(F.col("page_id") % 2 == 0, F.concat(F.col("url"), F.lit("?stored"))).alias("url"),
                F.when(F.col("page_id") % 3 == 0, F.lit(301)).alias("status_code"),
            )
        ).alias("payload"),
    )
    return src.page_payload(rows, "payload", ["url", "status_code", "depth", "load_time"])


def src_stored_results(spark, sf):
    """Results written by site and read back for one site."""
    path = shared.fresh_path(spark, "results")
    src.write_results(facts(spark, sf).drop("suggestions"), path)
    return src.read_results(spark, path, "site1.example.org").select("page_id", "site", "title", "word_count", "image_count")


def src_report_lines(spark, sf):
    """JSON report lines written per site and read back page by page."""
    path = shared.fresh_path(spark, "report")
    f = materialised(facts(spark, sf))
    src.write_report(src.report_heads(_assembled(spark, sf, f)), src.report_pages(f), path)
    lines = spark.read.schema("site string, page string").json(f"{path}/pages")
    page = lines.select("site", F.from_json("page", src.REPORT_PAGE).alias("p"))
    return page.select("site", "p.url", "p.status_code", "p.title", "p.word_count", "p.image_count", "p.load_time")


def set_all_links(spark, sf):
    """Internal and external links as one table."""
    side = F.when(F.col("internal"), "internal").otherwise("external")
    return links.link_table(facts(spark, sf)).select("page_id", "absolute_url", side.alias("side"))


def set_distinct_targets(spark, sf):
    return links.link_table(facts(spark, sf)).select("site", "absolute_url").distinct()


def set_semantic_overlap(spark, sf):
    targets = F.array(*[F.lit(e) for e in scoring.SEMANTIC_TARGETS])
    return facts(spark, sf).select(
        "page_id", F.size(F.array_intersect("semantic_elements", targets)).cast("bigint").alias("shared"),
        F.array_join(F.array_sort(F.array_intersect("semantic_elements", targets)), "|").alias("names"),
    )


def join_assembly(spark, sf):
    """Site, page and message rows of one assembly, in reading order."""
    raw = derived(spark, sf, "pages_raw")
    chat = derived(spark, sf, "chat_messages")
    site_rows = raw.groupBy("site").agg(F.count("*").alias("n")).select(
        "site", F.lit(0).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("ord1"), F.lit(0).cast("bigint").alias("ord2"),
        F.concat(F.lit("pages="), F.col("n").cast("string")).alias("payload"),
    )
    page_rows = raw.select("site", F.lit(1).cast("bigint").alias("part"), F.col("page_id").alias("ord1"), F.lit(0).cast("bigint").alias("ord2"), F.col("url").alias("payload"))
    chat_rows = chat.select("site", F.lit(2).cast("bigint").alias("part"), F.col("conv_id").alias("ord1"), F.col("turn").alias("ord2"), F.concat_ws(": ", "role", "text").alias("payload"))
    return site_rows.unionByName(page_rows).unionByName(chat_rows)


QUERIES = {
    name: fn
    for name, fn in list(globals().items())
    if name.startswith(("rec_", "rpt_", "qa_", "ops_", "sort_", "win_", "src_", "set_", "join_", "snk_")) and callable(fn)
}
