"""Recommendations: rules as rows, merged and ordered.

Rules that need only the page are an array per row and one explode; anchor
texts need the title of the target page (a join), broken links their status.
A merged recommendation can cover millions of pages of one site, so its pages
and states stay long tables keyed by ``rec_id`` instead of one array per row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftaudit.functions import advice, text, urls
from weftaudit.functions.common import bind, collapse, say
from weftaudit.operators.numbering import numbered
from weftaudit.operators.rows import unrolled
from weftaudit.operators.topics import topics
from weftaudit.sources.shared import materialised



def title_text(keyword: Column, site_name: Column, location: Column) -> Column:
    """Keyword, site name and place as a title of at most 60 characters."""
    cased = text.title_case(keyword)
    head = text.limit_length(cased, 42)
    named = F.concat_ws(" - ", F.nullif(head, F.lit("")), F.nullif(site_name, F.lit("")))
    placed = F.when(location == "", named).when(named == "", location).otherwise(
        F.concat(named, F.lit(" | "), location)
    )
    return text.limit_length(F.when(placed == "", cased).otherwise(placed), 60)


def short_title(title: Column, keyword: Column, site_name: Column) -> Column:
    """A title that fits: rebuilt from the keyword, or whole words of the old one."""

    def fit(candidate: Column) -> Column:
        words = F.regexp_extract(F.substring(candidate, 1, 58), r"^(.{0,57})(?: |$)", 1)
        kept = F.when(F.trim(words) != "", F.trim(words)).otherwise(F.rtrim(F.substring(candidate, 1, 57)))
        cut = F.concat(F.regexp_replace(kept, r"[ \-|]+$", ""), F.lit("..."))
        return F.when(F.length(candidate) <= 60, candidate).otherwise(cut)

    rebuilt = title_text(keyword, site_name, F.lit(""))
    return bind(F.when(keyword != "", rebuilt).otherwise(title), fit)


def fit_description(value: Column) -> Column:
    """Between 150 and 160 characters: cut at a word, or filled up."""
    filler = advice.META_FILLER

    def fit(t: Column) -> Column:
        n = F.length(t)
        cut = F.regexp_replace(F.regexp_replace(F.substring(t, 1, 157), r"(?s) [^ ]*$", ""), r"[ ,.;:]+$", "")
        times = F.ceil((F.lit(150) - n) / F.lit(float(len(filler)))).cast("int")
        filled = F.regexp_replace(
            F.substring(F.concat(t, F.repeat(F.lit(filler), F.greatest(times, F.lit(0)))), 1, 160), r"[ ,.;:]+$", ""
        )
        ended = F.when(filled.rlike(r"[.!?]$"), filled).otherwise(F.concat(filled, F.lit(".")))
        return (
            F.when(n > 160, F.concat(cut, F.lit("...")))
            .when(n < 150, F.substring(ended, 1, 160))
            .otherwise(t)
        )

    return bind(collapse(value), fit)


def description_text(summary: Column, topic: Column, domain: Column, call: Column) -> Column:
    """Summary, call to action and address, fitted to 150-160 characters."""
    opening = F.regexp_replace(
        collapse(F.when(summary != "", summary).otherwise(F.concat(F.lit("Learn about "), topic))), r"[. ]+$", ""
    )
    action = F.coalesce(F.nullif(call, F.lit("")), F.lit(advice.DEFAULT_CALL))
    place = F.when(domain != "", domain).otherwise(F.lit("your website"))
    base = say(opening, ". ", action, ". Learn more at ", place, ".")
    longer = lambda b: F.replace(
        F.concat(
            F.regexp_replace(b, r"\.+$", ""),
            F.lit(". Get practical details about "),
            F.lower(topic),
            F.lit(" and next steps."),
        ),
        F.lit(".."),
        F.lit("."),
    )
    return fit_description(bind(base, lambda b: F.when(F.length(b) < 150, longer(b)).otherwise(b)))


def alt_text(src: Column, topic: Column, context: Column) -> Column:
    """Alt text from the file name (or topic) and the first sentence of the page."""

    def made(name: Column) -> Column:
        generic = name.rlike(r"(?i)^(?:img\d+|image\d*|photo\d*|pic\d*)$")
        return F.when((name != "") & ~generic, text.title_case(name)).otherwise(F.concat(topic, F.lit(" image")))

    def extended(base: Column) -> Column:
        tail = F.regexp_replace(F.substring(context, 1, 50), r"[ ,.;:]+$", "")
        new = (context != "") & ~F.lower(base).contains(F.lower(context))
        return F.when(new, say(base, " - ", tail)).otherwise(base)

    return text.limit_length(bind(bind(urls.file_words(src), made), extended), 125)


def stuffing(sentences: Column) -> Column:
    """``array<struct<keyword, density, examples>>`` of words denser than 3 %."""

    def found(k: Column) -> Column:
        pattern = F.concat(F.lit(r"(?U)(?i)\b\Q"), k["word"], F.lit(r"\E\b"))
        hits = F.slice(F.filter(sentences, lambda s: F.regexp_like(s, pattern)), 1, 3)
        shown = F.when(F.size(hits) > 0, F.array_join(hits, " | ")).otherwise(
            F.concat(F.lit("Repeated keyword found: "), k["word"])
        )
        return F.struct(k["word"].alias("keyword"), k["density"].alias("density"), shown.alias("examples"))

    dense = F.filter("top_keywords", lambda k: (k["density"] > 3) & (F.length(k["word"]) >= 4))
    return F.transform(dense, found)


@cache
def _sentence_columns() -> tuple[Column, ...]:
    return (text.sentences(F.col("text_content")).alias("sents"),)


def stuffing_rows(facts: DataFrame) -> DataFrame:
    """One row per page and overused keyword."""
    return (
        facts.select("page_id", "top_keywords", *_sentence_columns())
        .transform(unrolled, ["page_id"], stuffing(F.col("sents")), "s")
        .select("page_id", "s.*")
    )


def _row(rule: str, severity: Column | str, state: Column | str, draft: Column | str) -> Column:
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(
        F.lit(rule).alias("rule"),
        as_col(severity).alias("severity"),
        as_col(state).alias("current_state"),
        as_col(draft).alias("draft"),
    )


@cache
def _context_columns() -> tuple[Column, ...]:
    """Topic, names and summary of a page, made once for all rules."""
    no_domain = F.lit(None).cast("string")
    return (
        F.col("t.topic").alias("topic"),
        F.col("t.keyword").alias("keyword"),
        F.col("t.h1_text").alias("h1_text"),
        urls.site_name(F.col("site_name"), no_domain, F.col("url")).alias("name"),
        urls.site_domain(no_domain, F.col("url")).alias("domain_name"),
        collapse(F.col("location")).alias("place"),
        text.topic_summary(F.col("sents"), F.col("t.topic")).alias("summary"),
        F.coalesce(F.get("sents", F.lit(0)), F.lit("")).alias("context"),
        collapse(F.col("title")).alias("clean_title"),
        collapse(F.col("meta_description")).alias("clean_meta"),
    )


@cache
def _rule_columns() -> tuple[Column, ...]:
    title, meta, n_h1 = F.col("clean_title"), F.col("clean_meta"), F.col("h1_count")
    keyword, name = F.col("keyword"), F.col("name")
    built = title_text(keyword, name, F.col("place"))
    described = description_text(F.col("summary"), F.col("topic"), F.col("domain_name"), F.col("call_to_action"))
    h1_texts = F.filter(
        F.transform(F.filter("headings", lambda h: h["level"] == 1), lambda h: collapse(h["text"])), lambda t: t != ""
    )
    h1_shown = F.when(F.size(h1_texts) > 0, F.array_join(h1_texts, ", ")).otherwise(F.lit("multiple H1 elements"))
    n, d = F.length(title), F.length(meta)

    title_rule = (
        F.when(title == "", _row("title_missing", "Critical", "No <title> tag found.", built))
        .when(
            n > TITLE_FITS,
            _row(
                "title_long",
                F.when(F.coalesce("overall", F.lit(UNSCORED)) >= 40, F.lit("Medium")).otherwise(F.lit("High")),
                say("Current title is ", n, " characters: ", title),
                short_title(title, keyword, name),
            ),
        )
        .when(
            n < 10,
            _row("title_short", "Medium", say("Current title is too short (", n, " characters): ", title), built),
        )
        .when(
            (keyword != "") & ~F.lower(title).contains(F.lower(keyword)),
            _row(
                "title_keyword",
                "Medium",
                say("Current title does not include the main topic keyword: ", title),
                short_title(built, keyword, name),
            ),
        )
    )
    meta_rule = F.when(
        meta == "", _row("meta_missing", "High", "No meta description found.", described)
    ).when(
        ~d.between(150, 160),
        _row("meta_length", "Medium", say("Current meta description is ", d, " characters: ", meta), described),
    )
    h1_rule = F.when(
        n_h1 == 0,
        _row("h1_missing", "Critical", "No <h1> heading found on the page.", say("<h1>", F.col("h1_text"), "</h1>")),
    ).when(n_h1 > 1, _row("h1_many", "High", say("Found ", n_h1, " H1 tags: ", h1_shown), advice.H1_MANY_FIX))
    thin_rule = F.when(
        F.col("word_count") < 300,
        _row(
            "thin_content",
            "Medium",
            say("Current word count is ", F.col("word_count"), " words."),
            say("Add at least ", 300 - F.col("word_count"), " more words about ", F.col("topic"), ". ", advice.THIN_FIX_TAIL),
        ),
    )
    view_rule = F.when(
        ~F.col("viewport_tag"), _row("viewport", "Medium", "No viewport meta tag found.", advice.VIEWPORT_FIX)
    )
    alts = F.transform(
        F.filter("images", lambda i: ~i["has_alt"]),
        lambda i: _row(
            "image_alt",
            "Medium",
            say("Image ", F.when(i["src"] != "", i["src"]).otherwise(F.lit("#")), " is missing alt text."),
            say('alt="', alt_text(i["src"], F.col("topic"), F.col("context")), '"'),
        ),
    )
    stuffed = F.transform(
        stuffing(F.col("sents")),
        lambda s: _row(
            "stuffing",
            "Medium",
            say('Keyword "', s["keyword"], '" appears at ', s["density"], "% density. Sentences to review: ", s["examples"]),
            say('Reduce repeated uses of "', s["keyword"], '" in these sentences: ', s["examples"], advice.STUFFING_FIX_TAIL),
        ),
    )
    single = F.array_compact(F.array(title_rule, meta_rule, h1_rule, thin_rule, view_rule))
    return (F.concat(single, alts, stuffed).alias("recs"),)


#: Letters of a title that is not too long; the rule of longer ones is the only one that reads a score.
TITLE_FITS = 60


def score_readers(facts: DataFrame) -> DataFrame:
    """The pages whose rules read their score."""
    return facts.where(F.length(collapse(F.col("title"))) > TITLE_FITS)


# Fixed value: the score of a page that neither has one itself nor through its site.
UNSCORED = 80.0


def resolved_scores(pages: DataFrame, page_scores: DataFrame, site_scores: Callable[[], DataFrame] | None = None) -> DataFrame:
    """(site, page_id, overall): the score of each page by its address, that of its site, or ``UNSCORED``.

    ``page_scores`` has site, page_id, url and overall. Addresses are compared without slashes
    at their ends; of several scores for one address that of the plain address counts, then that of
    the smallest page id. ``site_scores`` gives (site, overall), where 0 counts as none; it is only called
    if a page has no score by its address. ``pages`` should be a stored table.
    """
    key = urls.lookup_key(F.col("url")).alias("key")
    found = page_scores.where("overall IS NOT NULL").select("site", key, "overall", F.struct(F.col("url") != key, "page_id").alias("place"))
    by_key = found.groupBy("site", "key").agg(F.min_by("overall", "place").alias("overall"))
    rows = materialised(pages.select("site", "page_id", key).join(by_key, ["site", "key"], "left").drop("key"))
    if site_scores is not None and not rows.where("overall IS NULL").isEmpty():
        whole = site_scores().select("site", F.nullif("overall", F.lit(0.0)).alias("site_overall"))
        rows = rows.join(whole, "site", "left").withColumn("overall", F.coalesce("overall", "site_overall")).drop("site_overall")
    return rows.withColumn("overall", F.coalesce("overall", F.lit(UNSCORED)))


def page_rules(facts: DataFrame, site_meta: DataFrame, page_scores: DataFrame | None = None) -> DataFrame:
    """Rules that read one page (with its site's names and, if given, its score by page_id as ``resolved_scores`` has it)."""
    meta = site_meta.select("site", "site_name", "location", "call_to_action")
    rows = facts.join(meta, ["site"], "left")
    if page_scores is None:
        rows = rows.withColumn("overall", F.lit(None).cast("double"))
    else:
        rows = rows.join(page_scores.select("page_id", "overall"), "page_id", "left")
    base = [
        "page_id", "site", "url", "overall", "headings", "images", "top_keywords", "word_count", "h1_count",
        "viewport_tag", "call_to_action",
    ]
    with_text = rows.select(
        *base, "title", "meta_description", "site_name", "location", topics().alias("t"), *_sentence_columns()
    )
    context = with_text.select(*base, "sents", *_context_columns())
    return context.transform(unrolled, ["site", "page_id", "url"], _rule_columns()[0], "r", "ord").select(
        "site", "page_id", F.col("url").alias("page_url"), F.col("ord").cast("bigint").alias("ord"), "r.*"
    )


def anchor_rules(facts: DataFrame) -> DataFrame:
    """Vague or empty anchors, with the title of the target page as better text."""
    weak = (
        facts.transform(unrolled, ["site", "page_id", "url"], "links", "l")
        .withColumn("shown", collapse(F.col("l.text")))
        .where(F.lower("shown").isin(advice.VAGUE_ANCHORS) | (F.col("shown") == ""))
        .select("site", "page_id", "url", "l.pos", "shown", "l.absolute_url", urls.lookup_key(F.col("l.absolute_url")).alias("key"))
    )
    names = facts.select(
        "site", "page_id", urls.lookup_key(F.col("url")).alias("key"), collapse(F.col("title")).alias("title"),
        topics().alias("t"),
    ).select(
        "site", "key", "page_id",
        F.coalesce(F.nullif("title", F.lit("")), F.nullif("t.first_h1", F.lit("")), "t.topic").alias("name"),
    )
    titles = names.groupBy("site", "key").agg(F.max_by("name", "page_id").alias("target_title"))
    hit = weak.join(titles, ["site", "key"], "left")
    better = F.coalesce(F.nullif("target_title", F.lit("")), text.title_case(urls.slug_topic(F.col("key"))))
    prefix = F.when(F.col("shown") == "", F.lit("Empty anchor text")).otherwise(
        say('Current anchor text is "', F.col("shown"), '"')
    )
    return hit.select(
        "site", "page_id", F.col("url").alias("page_url"), (F.col("pos") + 1000).cast("bigint").alias("ord"),
        F.lit("anchor_text").alias("rule"),
        F.when(F.col("shown") == "", F.lit("High")).otherwise(F.lit("Medium")).alias("severity"),
        say(prefix, " for link ", F.col("absolute_url"), ".").alias("current_state"),
        better.alias("draft"),
    )


def broken_rules(broken: DataFrame) -> DataFrame:
    """One row per page with broken links; the first five are listed.

    ``broken`` holds site, page_id, url, pos, target, status_code and text.
    """
    item = say(
        F.when(collapse(F.col("text")) != "", collapse(F.col("text"))).otherwise(F.lit("this link")),
        " → ", F.col("target"), " (", F.col("status_code"), ")",
    )
    place = F.row_number().over(Window.partitionBy("site", "page_id", "url").orderBy("rank"))
    first = broken.withColumn("_place", place).where("_place <= 5")  # the others are dropped before their texts are gathered
    per_page = first.groupBy("site", "page_id", "url").agg(
        F.sort_array(F.collect_list(F.struct("_place", item.alias("item")))).alias("items")
    )
    listed = F.array_join(F.transform("items", lambda i: i["item"]), "; ")
    return per_page.select(
        "site", "page_id", F.col("url").alias("page_url"), F.lit(100000).cast("bigint").alias("ord"),
        F.lit("broken_links").alias("rule"), F.lit("High").alias("severity"),
        F.concat(F.lit("Broken links found: "), listed).alias("current_state"),
        F.lit(advice.BROKEN_FIX).alias("draft"),
    )


def site_rules(facts: DataFrame, site_meta: DataFrame) -> DataFrame:
    """HTTPS, robots.txt and sitemap rows; only an explicit false counts for the last two."""
    first = facts.groupBy("site").agg(F.min_by("url", "page_id").alias("first_url"))
    sites = first.join(site_meta.select("site", "base_url", "https", "has_robots", "has_sitemap"), "site", "left")
    base = collapse(F.coalesce(F.nullif("base_url", F.lit("")), "first_url"))
    sites = sites.select("site", "https", "has_robots", "has_sitemap", base.alias("base"))
    domain = urls.netloc(F.col("base"))
    secure = F.coalesce("https", urls.scheme(F.col("base")) == "https")
    robots = F.when(
        domain != "", say("User-agent: *\nAllow: /\n\nSitemap: https://", domain, "/sitemap.xml")
    ).otherwise(F.lit("User-agent: *\nAllow: /"))
    sitemap = F.when(
        domain != "", say("Create an XML sitemap and publish it at https://", domain, "/sitemap.xml")
    ).otherwise(F.lit("Create an XML sitemap and publish it at /sitemap.xml"))
    rows = F.array_compact(
        F.array(
            F.when(~secure, _row("https", "Critical", "The site is loading without HTTPS enabled.", advice.HTTPS_FIX)),
            F.when(~F.col("has_robots"), _row("robots", "High", "No robots.txt file was found.", robots)),
            F.when(~F.col("has_sitemap"), _row("sitemap", "High", "No XML sitemap was found.", sitemap)),
        )
    )
    return sites.transform(unrolled, ["site", "base"], rows, "r", "ord").select(
        "site", F.lit(-1).cast("bigint").alias("page_id"), F.col("base").alias("page_url"),
        F.col("ord").cast("bigint").alias("ord"), "r.*",
    )


def exact_fix(rule: Column, draft: Column) -> Column:
    """The text to paste, made from the draft of the rule."""
    return (
        F.when(rule == "title_missing", say("Add this title tag to your <head>: <title>", draft, "</title>"))
        .when(rule.startswith("title_"), say("Replace the current title tag with: <title>", draft, "</title>"))
        .when(rule.startswith("meta_"), say('<meta name="description" content="', draft, '">'))
        .otherwise(draft)
    )


def guarded(reply: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """A user's function on prompts as a vectorised one that leaves the drafts where it fails."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(prompts), index=prompts.index, dtype=object)
        asked = prompts[prompts != ""]
        try:
            out[asked.index] = reply(asked)
        except Exception:  # noqa: BLE001 - whatever the user's function raises, the rule-based drafts stay
            out[:] = None
        return out

    return run


def rewritten(rows: DataFrame, rewrite: Callable[[Column], Column]) -> DataFrame:
    """Let a user's vectorised function rewrite titles and descriptions.

    ``rewrite`` maps a prompt Column to a reply Column (a pandas UDF). A reply
    is cleaned and fitted; a null, blank or too short one leaves the draft. Other
    rows ask nothing: their prompt is empty.
    """
    is_title, is_meta = F.col("rule").startswith("title_"), F.col("rule").startswith("meta_")
    prompt = F.when(
        is_title,
        say("Rewrite this HTML title so it is natural, specific, and 50-60 characters long. Return only the title text. Draft: ", F.col("draft")),
    ).otherwise(
        say("Rewrite this meta description so it is compelling, accurate, and 150-160 characters long. Return only the meta description text. Draft: ", F.col("draft"))
    )
    asked = rows.withColumn("reply", collapse(rewrite(F.when(is_title | is_meta, prompt).otherwise(""))))
    fitted = F.when(is_meta, fit_description(F.col("reply"))).otherwise(text.limit_length(F.col("reply"), 60))
    usable = (is_title | is_meta) & (F.col("reply") != "") & (~is_meta | (F.length(fitted) >= 150))
    return asked.withColumn("draft", F.when(usable, fitted).otherwise(F.col("draft"))).drop("reply")


def rule_table(spark: SparkSession) -> DataFrame:
    """The fixed table of rule texts with the platform steps as a map."""
    rows = [
        (rule, r["pillar"], r["element"], r["why"], r["place"], r["impact"], r["steps"])
        for rule, r in advice.RULES.items()
    ]
    return spark.createDataFrame(
        rows,
        "rule string, pillar string, element string, why_it_matters string, placement_instructions string, "
        "estimated_impact string, platform_steps map<string,string>",
    )


def recommendations(
    facts: DataFrame,
    site_meta: DataFrame,
    broken: DataFrame | None = None,
    page_scores: DataFrame | None = None,
    rewrite: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """All recommendation rows, unmerged: page, anchor, broken-link and site rules."""
    rows = page_rules(facts, site_meta, page_scores).unionByName(anchor_rules(facts))
    if broken is not None:
        rows = rows.unionByName(broken_rules(broken))
    rows = rows.unionByName(site_rules(facts, site_meta))
    if rewrite is not None:
        rows = rewritten(rows, rewrite)
    fix = exact_fix(F.col("rule"), F.col("draft"))
    return rows.select(
        "site", "page_id", "ord", "page_url", "rule", "severity", "current_state", fix.alias("exact_fix")
    ).withColumn("rec_id", F.sha2(F.concat_ws("\x1f", "site", "rule", "severity", "exact_fix"), 256))


def severity_rank(severity: Column) -> Column:
    rank = F.lit(99)
    for i, name in enumerate(advice.SEVERITIES):
        rank = F.when(severity == name, F.lit(i)).otherwise(rank)
    return rank


#: What makes two recommendations the same.
MERGE_KEYS = ["rec_id", "site", "rule", "severity", "exact_fix"]


def merged(rows: DataFrame) -> DataFrame:
    """One row per distinct recommendation of a site; counts and first state only.

    Grouping first by page keeps the page count exact without a distinct
    aggregate, and both steps combine before the shuffle.
    """
    place = F.struct("page_id", "ord")
    per_page = rows.groupBy(*MERGE_KEYS, "page_url").agg(
        F.min_by("current_state", place).alias("state"), F.min(place).alias("place"), F.count("*").alias("rows")
    )
    return per_page.groupBy(*MERGE_KEYS).agg(
        F.count("*").alias("n_pages"),
        F.sum("rows").alias("n_rows"),
        F.min("page_url").alias("first_url"),
        F.min_by("state", "place").alias("first_state"),
    )


def merged_urls(rows: DataFrame) -> DataFrame:
    """The distinct pages of each merged recommendation."""
    return rows.where(F.col("page_url") != "").select(*MERGE_KEYS, "page_url").distinct()


def merged_states(rows: DataFrame) -> DataFrame:
    """The distinct states of each merged recommendation, with their first place."""
    return rows.groupBy(*MERGE_KEYS, "current_state").agg(F.min(F.struct("page_id", "ord")).alias("place"))


#: Letters of the parts by which states are looked up in one another.
GRAM = 12


def kept_states(states: DataFrame, gram: int = GRAM) -> DataFrame:
    """Distinct states with ``kept`` and ``ord``, the 1-based place among the kept ones.

    States come in the order of their first places. One that is empty, or part of an earlier
    state of its recommendation, is not kept. (What is part of a state that is not kept is part
    of a kept one too, so states need not be looked at one after the other.)

    A state is not compared with all others: of the parts of ``gram`` letters that it has (all
    of it, if it is shorter), the one that the fewest states hold is looked up in an index of the parts
    of all states; only those that hold it are searched for the whole state. The index has
    numbers of states and hashes of parts only. It is stored in far fewer bytes than it takes in
    memory, so its joins are merge joins by hint: none of it goes through the driver.
    """
    stored = materialised(states)
    rows = stored.where("current_state <> ''")
    several = rows.groupBy("rec_id").agg(F.count("*").alias("n")).where("n > 1").select("rec_id")
    own = rows.join(several, "rec_id", "left_semi").select(
        F.monotonically_increasing_id().alias("id"), "rec_id", F.col("current_state").alias("state"), "place", F.least(F.length("current_state"), F.lit(gram)).alias("asked_g")
    )
    own = materialised(own)
    lengths = own.select("rec_id", F.col("asked_g").alias("g")).distinct()
    whole = own.join(lengths.hint("merge"), "rec_id").where(F.length("state") >= F.col("g"))
    whole = whole.select("id", "state", "g", (F.col("g") == F.col("asked_g")).alias("asked"), F.xxhash64("rec_id", "g").alias("seed"))
    parts = F.transform(F.sequence(F.lit(1), F.length("state") - F.col("g") + 1), lambda i: F.xxhash64("seed", F.substring("state", i, F.col("g"))))
    index = materialised(whole.select("id", "asked", F.explode(F.array_distinct(parts)).alias("part")))
    held = index.groupBy("part").agg(F.count("*").alias("held"))
    rarest = index.where("asked").join(held.hint("merge"), "part").groupBy("id").agg(F.min(F.struct("held", "part")).alias("r"))
    looked = rarest.where("r.held > 1").select("id", F.col("r.part").alias("part"))
    pairs = looked.join(index.select("part", F.col("id").alias("other_id")).hint("merge"), "part").where("id <> other_id").select("id", "other_id")
    there = own.select(F.col("id").alias("other_id"), F.col("rec_id").alias("other_rec"), F.col("state").alias("other"), F.col("place").alias("before"))
    inside = (
        pairs.join(own.select("id", "rec_id", "state", "place").hint("merge"), "id")
        .join(there.hint("merge"), "other_id")
        .where((F.col("other_rec") == F.col("rec_id")) & (F.col("before") < F.col("place")) & F.col("other").contains(F.col("state")))
    )
    gone = inside.select("rec_id", F.col("state").alias("current_state")).distinct().withColumn("inside", F.lit(True))
    marked = materialised(stored.join(gone.hint("merge"), ["rec_id", "current_state"], "left"))
    kept = F.col("inside").isNull() & (F.col("current_state") != "")
    places = numbered(materialised(marked.where(kept).select("rec_id", "current_state", "place")), "rec_id", "place", "ord").drop("place")
    return marked.withColumn("kept", kept).drop("inside").join(places.hint("merge"), ["rec_id", "current_state"], "left")


def joined_states(kept: DataFrame, most: int | None = None) -> DataFrame:
    """The kept states of each recommendation, joined in order, and their number.

    All states are joined, however many there are; only a caller that sets ``most`` gets no text for
    a recommendation of more states. A row holds a whole text, so one beyond the memory of
    a task or Spark's limit for a string (2 GB) is an error. ``concat_ws`` makes a text of the known size;
    ``array_join`` would double its buffer as it goes.
    """
    held = F.col("ord").isNotNull() if most is None else F.col("ord") <= most  # the rest is dropped before it is gathered
    states = F.sort_array(F.collect_list(F.when(held, F.struct("ord", "current_state"))))
    text_ = F.concat_ws(" | ", F.transform(states, lambda x: x["current_state"]))
    rows = kept.groupBy(*MERGE_KEYS).agg(F.count("ord").alias("n_states"), text_.alias("joined_state"))
    return rows if most is None else rows.withColumn("joined_state", F.when(F.col("n_states") <= most, F.col("joined_state")))


def ordered(groups: DataFrame, rules: DataFrame) -> DataFrame:
    """Merged recommendations with their fixed texts, most severe first."""
    full = groups.join(F.broadcast(rules), "rule")
    return full.orderBy(severity_rank(F.col("severity")), "pillar", "element", "first_url", "rec_id")


