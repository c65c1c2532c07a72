"""Registered queries: addresses and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftaudit.functions import text, urls
from weftaudit.functions.common import collapse
from weftaudit.operators import robots
from weftaudit.operators import single_page as sp
from weftaudit.operators.duplicates import opening_counts, with_duplicate_flag
from weftaudit.operators.topics import page_text, primary_keyword, topics
from weftaudit.operators.recommend import stuffing_rows
from weftaudit.operators.rows import unrolled
from weftaudit.plans.queries_html import facts
from weftaudit.sources.tables import derived, table


def url_validity(spark, sf):
    u = F.col("url")
    return derived(spark, sf, "url_samples").select(
        "page_id", "n", urls.valid_lenient(u).alias("lenient"), urls.valid_strict(u).alias("strict"),
        urls.normalize_input(u).alias("app_input"), urls.normalize_input(u, "http").alias("tool_input"),
    )


def url_resolve(spark, sf):
    return derived(spark, sf, "url_samples").select(
        "page_id", "n", urls.resolve(F.col("base_url"), F.col("url")).alias("absolute_url")
    )


def url_keys(spark, sf):
    u = F.col("url")
    return derived(spark, sf, "url_samples").select(
        "page_id", "n", urls.crawl_key(u).alias("crawl_key"), urls.page_key(u, F.col("base_url")).alias("page_key"),
        urls.graph_key(u).alias("graph_key"), urls.lookup_key(u).alias("lookup_key"),
    )


def url_domain(spark, sf):
    u = F.col("url")
    return derived(spark, sf, "url_samples").select(
        "page_id", "n", urls.domain_key(u).alias("domain"), urls.domain_key(u).isNull().alias("quarantined")
    )


def url_classes(spark, sf):
    u = F.col("url")
    return derived(spark, sf, "url_samples").select(
        "page_id", "n", urls.is_internal(u, urls.netloc(F.col("base_url"))).alias("internal"),
        urls.is_crawlable(u).alias("crawlable"), urls.is_link_href(u).alias("link_href"),
        urls.scheme(urls.resolve(F.col("base_url"), u)).isin("http", "https").alias("plain_href"),
    )


def url_robots(spark, sf):
    rules = robots.active_rules(derived(spark, sf, "robots_rules"), "auditor")
    pages = derived(spark, sf, "pages_raw").select("page_id", "site", "url")
    return robots.with_allowed(pages, rules).select("page_id", "url", "allowed")


def url_slugs(spark, sf):
    u = F.col("url")
    return derived(spark, sf, "url_samples").select(
        "page_id", "n", urls.slug_topic(u).alias("slug"), urls.file_words(u).alias("file_words"),
        urls.site_name(F.when(F.col("n") == 1, "Given  Name"), F.lit(None).cast("string"), u).alias("site_name"),
    )


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", "text")


def _doc_words(spark, sf):
    return _docs(spark, sf).select("doc_id", text.words(F.col("text")).alias("ws"))


def txt_words(spark, sf):
    return _doc_words(spark, sf).select(
        "doc_id", F.size("ws").cast("bigint").alias("word_count"), F.array_join("ws", " ").alias("words")
    )


def txt_top_keywords(spark, sf):
    top = _doc_words(spark, sf).transform(unrolled, ["doc_id"], text.top_keywords(F.col("ws")), "k", "i")
    return top.select("doc_id", (F.col("i") + 1).cast("bigint").alias("rank"), "k.word", "k.n", "k.density")


def txt_plain_keywords(spark, sf):
    plain = _doc_words(spark, sf).select("doc_id", text.plain_keyword_tokens(F.col("ws")).alias("ws"))
    top = plain.transform(unrolled, ["doc_id"], text.plain_keywords(F.col("ws")), "k", "i")
    return top.select("doc_id", (F.col("i") + 1).cast("bigint").alias("rank"), "k.word", "k.n", "k.density")


def txt_body_keywords(spark, sf):
    """Keywords of page bodies in the single-page profile, with the ten-word list."""
    body = sp.body_keywords(derived(spark, sf, "pages_raw"))
    return body.select(
        "page_id", "plain_word_count",
        F.array_join(F.transform(F.slice("plain_keywords", 1, 10), lambda k: k["word"]), "|").alias("top_ten"),
    )


def txt_primary_keyword(spark, sf):
    meta = derived(spark, sf, "site_meta").select("site", "primary_keyword")
    rows = facts(spark, sf).join(meta, ["site"], "left")
    return rows.select("page_id", primary_keyword(F.col("primary_keyword")).alias("keyword"))


def txt_contains_term(spark, sf):
    key = primary_keyword(F.lit(None).cast("string"))
    return facts(spark, sf).select(
        "page_id", text.contains_term(F.col("title"), key).alias("in_title"),
        text.contains_term(F.col("text_content"), F.lit("plans")).alias("has_plans"),
    )


def txt_flesch(spark, sf):
    return _docs(spark, sf).select("doc_id", F.round(text.flesch(F.col("text")), 6).alias("flesch"))


def txt_syllables(spark, sf):
    ws = _docs(spark, sf).select("doc_id", text.plain_words(F.col("text")).alias("ws"), text.sentence_count(F.col("text")).alias("sc"))
    return ws.select(
        "doc_id", F.size("ws").cast("bigint").alias("plain_words"), F.col("sc").cast("bigint").alias("sentences"),
        text.syllable_total(F.col("ws")).alias("syllables"),
    )


def txt_long_tail(spark, sf):
    return (
        _docs(spark, sf)
        .transform(unrolled, ["doc_id"], text.long_tail_phrases(F.col("text")), "phrase", "i")
        .select("doc_id", (F.col("i") + 1).cast("bigint").alias("rank"), "phrase")
    )


def txt_collapse(spark, sf):
    return _docs(spark, sf).select("doc_id", collapse(F.col("text")).alias("clean"))


def txt_fingerprint(spark, sf):
    return _docs(spark, sf).select("doc_id", text.fingerprint(F.col("text")).alias("opening"))


def txt_duplicates(spark, sf):
    marked = _docs(spark, sf).select("doc_id", "source", text.fingerprint(F.col("text")).alias("opening"))
    return with_duplicate_flag(marked, "source", "opening").select("doc_id", "source", "duplicated")


def txt_duplicate_counts(spark, sf):
    marked = _docs(spark, sf).select("doc_id", "source", text.fingerprint(F.col("text")).alias("opening"))
    return opening_counts(marked, "source", "opening").where(F.col("opening") != "")


def txt_page_text(spark, sf):
    """Stored text of each page, and the text put together from title, headings, alts and anchors where there is none."""
    f = facts(spark, sf)
    return f.select("page_id", page_text(F.col("text_content")).alias("page_text"), page_text(F.lit("")).alias("made_text"))


def txt_sentences(spark, sf):
    return (
        _docs(spark, sf)
        .transform(unrolled, ["doc_id"], text.sentences(F.col("text")), "sentence", "i")
        .select("doc_id", (F.col("i") + 1).cast("bigint").alias("ord"), "sentence")
    )


def txt_topic_summary(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", text.topic_summary(text.sentences(F.col("text")), F.col("source")).alias("summary")
    )


def txt_title_case(spark, sf):
    return _docs(spark, sf).select("doc_id", text.title_case(F.col("text")).alias("titled"))


def txt_limit_length(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", text.limit_length(F.col("text"), 60).alias("cut60"), text.limit_length(F.col("text"), 125).alias("cut125")
    )


def txt_stuffing(spark, sf):
    return stuffing_rows(facts(spark, sf)).select("page_id", "keyword", "density", "examples")


def txt_topics(spark, sf):
    t = facts(spark, sf).select("page_id", topics().alias("t"))
    return t.select("page_id", "t.topic", "t.keyword", "t.first_h1", "t.h1_text")


def txt_dedupe(spark, sf):
    """Distinct words of a document in order: exact, and ignoring case."""
    ws = _docs(spark, sf).select("doc_id", F.regexp_extract_all("text", F.lit(text.WORD_RE), F.lit(0)).alias("ws"))
    ws = ws.select("doc_id", F.array_distinct("ws").alias("once"))
    return ws.select(
        "doc_id", F.array_join("once", "|").alias("exact"), F.array_join(text.dedupe_folded(F.col("once")), "|").alias("folded")
    )


def txt_alt_checks(spark, sf):
    return (
        facts(spark, sf)
        .transform(unrolled, ["page_id"], "images", "i")
        .select(
            "page_id", F.col("i.index").cast("bigint").alias("index"),
            text.is_filename_alt(F.concat("i.alt", F.when(F.col("page_id") % 2 == 0, ".jpg").otherwise(""))).alias("filename_alt"),
            text.is_short_alt(F.col("i.alt")).alias("short_alt"),
        )
    )


def txt_flatten(spark, sf):
    """Message contents stored as plain text, a list of parts, or an object."""
    t = F.col("text")
    content = (
        F.when(F.col("turn") % 4 == 0, F.to_json(F.struct(t.alias("text"))))
        .when(F.col("turn") % 4 == 1, F.to_json(F.array(F.struct(t.alias("text")), F.struct(F.col("role").alias("text")))))
        .when(F.col("turn") % 4 == 2, F.to_json(F.array(t, F.lit(""), F.col("role"))))
        .otherwise(F.to_json(F.struct(F.lit("").alias("text"), t.alias("content"))))
    )
    parsed = table(spark, sf, "conversations").select("conv_id", "turn", F.parse_json(content).alias("v"))
    return parsed.select("conv_id", "turn", text.flatten_content(F.col("v")).alias("content"))


QUERIES = {name: fn for name, fn in list(globals().items()) if name.startswith(("url_", "txt_"))}
