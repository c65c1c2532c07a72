"""Scores of two pages worked out by hand from the scoring rules, not taken from either engine."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftaudit.operators import scoring
from weftaudit.operators.facts import page_facts

META = "site string, primary_keyword string, https boolean, has_robots boolean, has_sitemap boolean, load_time double"

TITLE = "Storage plans for small kitchens with drawings and cost"  # 55 characters
DESCRIPTION = "Compare storage plans and prices for small kitchens, with measured drawings, cost notes and a short checklist for buyers here."  # 126
RICH = (
    f'<html><head><title>{TITLE}</title><meta name="description" content="{DESCRIPTION}"><meta name="viewport" content="width=device-width">'
    '<link rel="canonical" href="/c"><meta property="og:title" content="T"><meta property="og:description" content="D">'
    '<meta property="og:image" content="/i.png"><meta name="twitter:card" content="summary">'
    '<script type="application/ld+json">{"@type":"Article"}</script></head><body><header>Top</header><nav>Menu</nav><main><article><section>'
    '<h1>Storage plans</h1><h2>Why</h2><img src="/a.webp" alt="Oak shelf in a kitchen" loading="lazy">'
    '<a href="/p/1">First plan</a><a href="https://other.org/" rel="noopener">A source</a></section></article></main><footer>End</footer></body></html>'
)


@pytest.fixture(scope="module")
def pillars(spark):
    rows = [
        (1, "a.org", "https://a.org/x", "<p>x</p>", 200, 0, 0.5, None),
        (2, "b.org", "http://b.org/y", RICH, 200, 0, 2.0, None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, site string, url string, html string, status_code long, depth long, load_time double, error string")
    facts = page_facts(pages).withColumn("broken_count", F.col("page_id") - 1)
    meta = spark.createDataFrame([("a.org", None, None, None, None, None), ("b.org", "storage", None, True, True, None)], META)
    return {r["page_id"]: r for r in scoring.page_pillars(scoring.scoring_input(facts, meta)).collect()}


def test_on_page_seo(pillars):
    # bare: no stuffing 5, of 85; without headings there is no order to praise
    assert pillars[1]["on_page_seo"]["score"] == 5.88
    # rich: title 10 + 5 + 5, description 10 + 5 + 5, h1 10 + 5 + 5, order 10, canonical 5, data 5, cards 5 + 5 = 90,
    # above the maximum with or without the 5 points for density
    assert pillars[2]["on_page_seo"]["score"] == 100.0


def test_content_quality(pillars):
    # bare: -15 thin, reading ease 100 out of range 0, no keyword -10
    assert pillars[1]["content_quality"]["score"] == 0.0
    assert "Thin content detected: 1 words" in pillars[1]["content_quality"]["issues"]


def test_technical_seo(pillars):
    # bare: https 15, no broken links 15, under 3 s 15, under 1.5 s 5, no image to load late 10, of 95
    assert pillars[1]["technical_seo"]["score"] == 63.16
    # rich: robots 10, sitemap 10, under 3 s 15, viewport 15, lazy images 10; http and one broken link give nothing
    assert pillars[2]["technical_seo"]["score"] == 63.16


def test_ux_design(pillars):
    # rich: alts 15 + 10 + 10, no inline colour 5, six of six semantic elements 20, modern image 10, viewport 10, mobile 10, of 90
    assert pillars[2]["ux_design"]["score"] == 100.0
    # bare: no images 15 + 10 + 10 + 10, no inline colour 5
    assert pillars[1]["ux_design"]["score"] == 55.56


def test_links_architecture(pillars):
    # bare: 80 + 10 (no external link lacks rel); without anchors variety is limited
    assert pillars[1]["links_architecture"]["score"] == 90.0
    # rich: 80 + 10 + 10 (two different anchors)
    assert pillars[2]["links_architecture"]["score"] == 100.0
