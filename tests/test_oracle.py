"""A cross-section of the registered queries against DuckDB; all run by tests/compare.py."""

from __future__ import annotations

import duckdb
import pytest
from compare import compare

import __spark_entry__ as entry

SAMPLE = [
    "html_tokens", "html_images", "html_links", "html_page_analysis", "url_keys", "url_resolve", "txt_long_tail",
    "txt_flesch", "txt_duplicates", "join_edges", "join_broken_links", "agg_insights", "scr_site_scores",
    "graph_click_depth", "graph_crawl_order", "rec_merged", "rpt_text", "qa_answers", "win_audit_changes", "sort_jobs",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, sf, name):
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], sf) == []


def test_every_query_has_sql():
    assert set(entry.QUERIES) == set(entry.ORACLE)


def test_the_quality_gate_checks_all_links_of_a_page(spark, tmp_path):
    """Page 1 links to pages 11 (status 404, twice) and 26 (unreachable) after 55 addresses that nobody knows."""
    links = [f"/ok/{i}" for i in range(55)] + ["/p/2#a", "/p/2", "/p/5"]
    head = f'<html><head><title>Small kitchens and their plans</title><meta name="description" content="{"d" * 130}"></head><body><main><h1>Plans</h1>'
    many = head + "".join(f'<a href="{x}">to {x}</a>' for x in links) + "</main></body></html>"
    none = head + "</main></body></html>"
    spark.createDataFrame([(1, "u", many), (11, "u", none), (26, "u", none)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    name = "scr_quality_gate"
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path)) == []
    got = {r["page_id"]: (r["passed"], r["failed"]) for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    assert got == {1: (False, "2 broken link(s) found"), 11: (True, ""), 26: (True, "")}
