"""Literal cases for addresses, pages, scores and recommendations."""

from __future__ import annotations

import random
import re
from collections import Counter
from urllib.parse import urljoin, urlsplit

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftaudit.functions import grades, text, urls
from weftaudit.operators import authority, graph, links, numbering, recommend
from weftaudit.operators import single_page as sp
from weftaudit.operators.facts import page_facts


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def many(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def page(spark, html, url="https://example.com/a/page", **extra):
    row = {"page_id": 1, "site": "example.com", "url": url, "html": html, "status_code": 200, "depth": 0, **extra}
    return page_facts(spark.createDataFrame([row]))


def test_crawl_key(spark):
    given = ["https://example.com/page#section", "https://example.com/page/", "https://Example.COM/page", "https://example.com"]
    page_key = "https://example.com/page"
    assert many(spark, given, lambda v: urls.crawl_key(v)) == [page_key, page_key, page_key, "https://example.com/"]


def test_internal(spark):
    given = ["https://example.com/page", "/page", "https://other.com/page"]
    assert many(spark, given, lambda v: urls.is_internal(v, F.lit("example.com"))) == [True, True, False]


def test_crawlable(spark):
    given = ["https://example.com/page", "/page", "", "javascript:void(0)", "mailto:test@example.com",
             "https://example.com/image.jpg", "https://example.com/file.pdf"]
    assert many(spark, given, lambda v: urls.is_crawlable(v)) == [True, True, False, False, False, False, False]


def test_resolve_matches_the_standard_library(spark):
    bases = ["https://a.example.org/x/y/z.html?q=1#f", "http://b.example.org", "https://c.example.org/d//e/"]
    refs = ["g", "./g", "g/", "/g", "//h.example.org/i", "?y=2", "#s", "../g", "../../g", "../../../g", "g;x=1?y#s",
            ".", "..", "./", "../", "g?y/./x", "/a//b/../c", "https://other.example.com/q", "mailto:x@y.z", "g//h", "ftp://f/x"]
    pairs = [(b, r) for b in bases for r in refs]
    rows = spark.createDataFrame([(i, b, r) for i, (b, r) in enumerate(pairs)], "i int, b string, r string")
    got = [x["u"] for x in rows.select("i", urls.resolve(F.col("b"), F.col("r")).alias("u")).orderBy("i").collect()]
    wrong = [(p, g, urljoin(*p)) for p, g in zip(pairs, got) if g != urljoin(*p)]
    assert wrong == []


def test_split_matches_the_standard_library(spark):
    given = ["https://u@Host:80/p;a?b=c#d", "mailto:x@y", "//h/p", "/p?q", "", "a:b", "http://h?x#y"]
    got = many(spark, given, lambda v: urls.parts(v))
    for value, parts in zip(given, got):
        want = urlsplit(value)
        assert tuple(parts) == (want.scheme, want.netloc, want.path, want.query, want.fragment)


@pytest.mark.parametrize(
    "html, cms",
    [
        ('<head><meta name="generator" content="WordPress 6.0"><script src="/wp-content/x.js"></script></head><body class="wp-page">', "wordpress"),
        ('<head><meta name="generator" content="Squarespace"><script src="/universal/scripts-compressed/a.js"></script></head><body class="sqs-site">', "squarespace"),
    ],
)
def test_platform(spark, html, cms):
    row = page(spark, html).select("cms_probable", "cms_detected").first()
    assert (row["cms_probable"], row["cms_detected"]) == (cms, [cms])


def test_json_ld(spark):
    html = '<script type="application/ld+json">{"@type":"Organization","name":"Test Org"}</script><script type="application/ld+json">{no</script>'
    found = page(spark, html).first()["json_ld"]
    assert [(j["type"], j["name"]) for j in found] == [("Organization", "Test Org")]


def test_accessibility(spark):
    row = page(spark, '<main></main><nav></nav><img src="a.jpg" alt="A"><img src="b.jpg">').first()["accessibility"]
    assert row["issues"] == ["1 image(s) missing alt text"] and row["score"] == 80


def test_suggestions(spark):
    html = '<meta name="generator" content="Squarespace"><meta name="description" content="d"><p>' + "word " * 250
    got = {s["issue"]: s["platform_help"] for s in page(spark, html).first()["suggestions"]}
    assert "Missing H1 heading" in got and got["Missing page title"].startswith("In Squarespace")


RICH = """<!DOCTYPE html><html lang="en"><head><title> A <b>bold</b> &amp; true title </title>
<meta property="og:title" content="T"><meta name="Description" content="first"><meta name="description" content="last">
<link rel="alternate canonical" href="/c"></head><body><header><nav><a href="/one">One <i>item</i></a><img src="logo.png" alt="Logo"></nav></header>
<h1 class="big main" id="top">Head<span>line</span></h1><h2>Two</h2><h4>Four</h4>
<article><p>Para<p>Next <img src=pic.jpg><div data-x="a > b"><img alt='x.jpg' src="/i/x.avif?v=1" loading="lazy"></div></article>
<script>var t = "<a href='/no'>no</a>";</script><!-- <img src="no.png"> --><aside><img src="" alt=""></aside>
<a href="mailto:x@y">m</a><a href="  https://other.org/x  " rel="NoFollow noopener">Out</a><footer>&copy; 2024 &#x41;&#66; &unknown;</footer></body></html>"""


def test_rich_page(spark):
    r = page(spark, RICH).first()
    assert r["title"] == "A<b>bold</b>& true title" or r["title"] == "Abold& true title"
    assert r["meta_description"] == "last" and r["first_description"] == "last" and r["canonical_url"] == "/c"
    assert r["language"] == "en" and r["heading_counts"] == [1, 1, 0, 1, 0, 0]
    assert r["headings"][0]["text"] == "Headline" and r["headings"][0]["classes"] == ["big", "main"]
    assert [i["placement_parent"] for i in r["images"]] == ["nav", "p", "div", "aside"]
    assert [(i["in_nav"], i["in_header"], i["in_article"]) for i in r["images"]][:2] == [(True, True, False), (False, False, True)]
    assert r["images"][1]["absolute_src"] == "https://example.com/a/pic.jpg" and r["missing_alt_count"] == 2
    assert [(x["text"], x["href"], x["internal"]) for x in r["links"]] == [
        ("Oneitem", "/one", True), ("Out", "https://other.org/x", False),
    ]
    assert r["links"][1]["rel"] == ["NoFollow", "noopener"]
    assert "© 2024 AB &unknown;" in r["text_content"] and "var t" not in r["text_content"]


def test_single_page_rules(spark):
    r = page(spark, RICH).select(sp.heading_issues(F.col("heading_counts")).alias("h"), sp.layout_issues(F.col("structure")).alias("l")).first()
    assert r["h"] == ["Heading hierarchy skip: H2 to H4"] and r["l"] == ["Missing <main> element"]


def test_failed_page_has_full_shape(spark):
    r = page(spark, "").first()
    assert (r["fetched"], r["title"], r["word_count"], r["links"], r["images"], r["h1_count"]) == (False, "", 0, [], [], 0)


def test_long_tags_do_not_overflow(spark):
    html = "<div " + "a b " * 40000 + "><h1>x</h1>" + "<p>" * 2000
    assert page(spark, html).select("h1_count").first()["h1_count"] == 1


def test_keywords_match_a_counter(spark):
    rng = random.Random(3)
    body = " ".join(rng.choice(["the", "oak", "Shelf", "plan", "cost", "of", "ab", "wood1"]) for _ in range(500))
    got = one(spark, text.top_keywords(text.words(F.col("t"))), t=body)
    words = re.findall(r"\b\w+\b", body.lower())
    want = [(w, n) for w, n in Counter(words).most_common(20) if w not in text.KEYWORD_STOP_WORDS and len(w) > 2]
    assert [(k["word"], k["n"]) for k in got] == want


def test_words_with_accents(spark):
    got = one(spark, text.plain_words(F.col("t")), t="don't café's l'été naïve x_y 3rd 'quoted'")
    assert got == re.findall(r"\b[a-z0-9']+\b", "don't café's l'été naïve x_y 3rd 'quoted'", re.I)


def test_limit_and_case(spark):
    assert one(spark, text.limit_length(F.col("t"), 12), t="alpha beta gamma") == "alpha..."
    assert one(spark, text.title_case(F.col("t")), t="oak sHELF  plan") == "Oak SHELF Plan"
    assert one(spark, text.dedupe_folded(F.split("t", ",")), t="A,b, a ,B,,c") == ["A", "b", "c"]


@pytest.mark.parametrize("score, grade, label", [(95, "A", "Excellent"), (80, "B", "Good"), (60, "D", "Needs Work"), (12, "F", "Critical")])
def test_grades(spark, score, grade, label):
    assert one(spark, grades.grade(F.col("s")), s=float(score)) == grade
    assert one(spark, grades.label(F.col("s")), s=float(score)) == label


def test_description_fits(spark):
    texts = ["short.", "x" * 300, "word " * 60, "a" * 149, ""]
    got = many(spark, texts, lambda v: recommend.fit_description(v))
    assert all(150 <= len(g) <= 160 for g in got[:1] + got[2:4])
    assert all(len(g) <= 160 for g in got)


META = "site string, base_url string, homepage_url string, site_name string, location string, primary_keyword string, call_to_action string, https boolean, has_robots boolean, has_sitemap boolean, load_time double"


def test_recommendations_of_a_bare_page(spark):
    facts = page(spark, '<body><img src="a.png"><a href="/x">here</a>text</body>', url="http://example.com/")
    meta = spark.createDataFrame([("example.com", None, None, None, None, None, None, False, False, False, None)], META)
    rows = recommend.recommendations(facts, meta)
    done = recommend.ordered(recommend.merged(rows), recommend.rule_table(spark)).collect()
    assert {r["element"] for r in done} == {
        "title tag", "meta description", "H1", "image alt", "anchor text", "viewport meta", "HTTPS", "robots.txt",
        "XML sitemap", "body content",
    }
    assert [r["severity"] for r in done if r["element"] == "title tag"] == ["Critical"]
    ranks = [["Critical", "High", "Medium", "Low"].index(r["severity"]) for r in done]
    assert ranks == sorted(ranks) and done[0]["platform_steps"]["generic"]


def test_equal_recommendations_merge(spark):
    two = "<title>A title that is long enough for it</title><h1>A title that</h1><h1>Other</h1>"
    facts = page(spark, two, url="https://example.com/1").unionByName(
        page(spark, two, url="https://example.com/2").withColumn("page_id", F.lit(2).cast("bigint"))
    )
    meta = spark.createDataFrame([("example.com", None, None, None, None, None, None, None, None, None, None)], META)
    rows = recommend.recommendations(facts, meta)
    h1 = recommend.merged(rows).where("rule = 'h1_many'").collect()
    assert len(h1) == 1 and h1[0]["n_pages"] == 2
    assert recommend.merged_urls(rows.where("rule = 'h1_many'")).count() == 2


def test_rewrite_hook(spark):
    @F.pandas_udf("string")
    def rewrite(prompt: pd.Series) -> pd.Series:
        return prompt.map(lambda p: "A hand made title" if "HTML title" in p else None)

    facts = page(spark, "<p>x</p>")
    meta = spark.createDataFrame([("example.com", None, None, None, None, None, None, None, None, None, None)], META)
    got = {r["rule"]: r["exact_fix"] for r in recommend.recommendations(facts, meta, rewrite=rewrite).collect()}
    assert "A hand made title" in got["title_missing"] and got["meta_missing"].startswith('<meta name="description"')


def test_depths_in_a_cycle_with_an_island(spark):
    pairs = [("s", "a", "b"), ("s", "b", "c"), ("s", "c", "a"), ("s", "c", "d"), ("s", "x", "y")]
    nodes = spark.createDataFrame([("s", n) for n in "abcdxy"], "site string, node string")
    edges = spark.createDataFrame(pairs, "site string, src string, dst string")
    homes = spark.createDataFrame([("s", "a")], "site string, home string")
    got = {r["node"]: r["depth"] for r in graph.click_depths(nodes, edges, homes).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3, "x": None, "y": None}


def test_salted_edges_keep_a_hot_target(spark):
    pages = "<a href='/'>h</a><a href='/p/1'>one</a>"
    rows = [(i, "e.org", f"https://e.org/p/{i}", pages) for i in range(60)] + [(99, "e.org", "https://e.org/", pages)]
    facts = page_facts(spark.createDataFrame(rows, "page_id bigint, site string, url string, html string"))
    degrees = {r["node"]: r["in_degree"] for r in graph.in_degrees(links.edges(facts)).collect()}
    assert degrees == {"https://e.org/": 60, "https://e.org/p/1": 60}


def test_numbers_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).select(F.lit("s").alias("site"), (F.col("id") * 7 + 3).alias("page_id"))
    for parts in (1, 7):
        got = numbering.numbered(rows.repartition(parts), "site", "page_id", "n", bucket=50).orderBy("page_id").collect()
        assert [r["n"] for r in got] == list(range(1, 1001))


def test_authority_neutral_without_figures(spark):
    domains = spark.createDataFrame([("a.org",), ("b.org",)], "domain string")
    figures = spark.createDataFrame([("a.org", "p", 1, "da", 80.0), ("a.org", "p", 1, "domain_authority", None)],
                                    "domain string, provider string, priority bigint, metric string, value double")
    got = {r["domain"]: (r["authority"]["score"], r["educational_mode"]) for r in authority.authority_scores(domains, figures).collect()}
    assert got == {"a.org": (80.0, False), "b.org": (50.0, True)}


def test_scores_stay_in_range(spark):
    from weftaudit.plans.queries_site import _pillars

    rows = _pillars(spark, "/root/testdata/sf0.001").collect()
    for name in ("on_page_seo", "content_quality", "technical_seo", "ux_design", "links_architecture"):
        assert all(0 <= r[name]["score"] <= 100 for r in rows)



def test_a_failing_rewriter_leaves_the_drafts(spark):
    import pandas as pd

    from weftaudit.operators import recommend

    def away(prompts: pd.Series) -> pd.Series:
        raise RuntimeError("no model")

    rows = spark.createDataFrame([("title_long", "A draft"), ("h1_missing", "x")], "rule string, draft string")
    done = {r["rule"]: r["draft"] for r in recommend.rewritten(rows, recommend.guarded(away)).collect()}
    assert done == {"title_long": "A draft", "h1_missing": "x"}
    loud = recommend.rewritten(rows, recommend.guarded(lambda p: p.str.slice(0, 3)))
    assert {r["draft"] for r in loud.collect()} == {"Rew", "x"}


def test_loaders_mend_their_tables(spark, tmp_path):
    from weftaudit.sources import pages as src

    status = [(" https://a.b/ ", None), ("https://a.b/", 404), ("", 200), (None, 200)]
    spark.createDataFrame(status, src.LINK_STATUS).write.parquet(str(tmp_path / "s"))
    assert [tuple(r) for r in src.read_link_status(spark, str(tmp_path / "s")).collect()] == [("https://a.b/", 404)]
    spark.createDataFrame([(" A.org", "p", 1, "rank", 2.0), (None, "p", 1, "rank", 2.0)], src.AUTHORITY_METRICS).write.parquet(str(tmp_path / "a"))
    assert [r["domain"] for r in src.read_authority_metrics(spark, str(tmp_path / "a")).collect()] == ["a.org"]
