"""Cases that break designs which hold on small even tables only."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftaudit.functions import html, walk
from weftaudit.operators import graph, links
from weftaudit.operators.facts import page_facts
from weftaudit.operators.numbering import numbered, ranged
from weftaudit.sources import shared, tables

PAGE = "page_id long, url string, site string, html string, status_code long, depth long, load_time double, error string"


def pages(spark, bodies):
    return spark.createDataFrame([(i, f"https://e.org/p{i}", "e.org", b, 200, 0, 0.5, None) for i, b in enumerate(bodies)], PAGE)


def slow_places(marks):
    """The stack of open elements kept whole, as its definition has it."""
    up, out = [], []
    for mark in marks:
        tag = mark[1:]
        if mark == "+img":
            out.append({"parent": up[0] if up else "body", **{f"in_{p}": p in up for p in walk.PLACES}})
        if tag in html.VOID_TAGS:
            continue
        if mark[0] == "+":
            if not (tag in html.SELF_ENDING_TAGS and up and up[0] == tag):
                up = [tag, *up]
        elif tag in up:
            up = up[up.index(tag) + 1 :]
    return out


def test_image_places_match_the_whole_stack():
    rnd = random.Random(1)
    for _ in range(300):
        marks = [rnd.choice("++-") + rnd.choice(["img", "p", "div", "nav", "article", "header", "li", "br"]) for _ in range(rnd.randint(0, 40))]
        assert walk.image_places(marks, frozenset(html.VOID_TAGS), frozenset(html.SELF_ENDING_TAGS)) == slow_places(marks)


def test_unclosed_links_and_headings_end_at_the_next_one(spark):
    body = "<h1>One<h2>Two</h2> between <a href=/a>first <a href=/b>second</a> after <a href=/c>third"
    row = page_facts(pages(spark, [body])).select("headings.text", F.col("links.text").alias("shown")).first()
    assert list(row["text"]) == ["One", "Two"] and list(row["shown"]) == ["first", "second", "third"]


def test_output_of_a_long_broken_page_is_linear(spark):
    n = 4000
    body = "".join(f'<div><p>w{i} <a href="/x{i}">link {i}<img src="i{i}.png">' for i in range(n))
    row = page_facts(pages(spark, [body])).select(
        F.size("images").alias("images"), F.aggregate("links", F.lit(0), lambda a, x: a + F.length(x["text"])).alias("chars"), "missing_alt_count"
    ).first()
    assert row["images"] == row["missing_alt_count"] == n and row["chars"] < 20 * n


@pytest.mark.parametrize("reference", ["&#65;", "&#0000000065;", "&#x41;", "&#X0000041;"])
def test_leading_zeros_of_references(spark, reference):
    assert spark.range(1).select(html.decode_entities(F.lit(reference)).alias("t")).first()["t"] == "A"


def test_one_target_with_half_of_all_links(spark):
    bodies = [f'<a href="/p0">home</a><a href="/p{(i * 7) % 60}">x</a>' for i in range(60)]
    facts = page_facts(pages(spark, bodies))
    status = spark.createDataFrame([("https://e.org/p0", 404), ("https://e.org/p7", 200)], "url string, status_code long")
    broken = links.broken_links(facts, status)
    assert broken.count() == 61
    assert "_salt" not in broken._jdf.queryExecution().toString()
    degrees = {r["node"]: r["in_degree"] for r in graph.in_degrees(links.edges(facts)).collect()}
    assert max(degrees.values()) == 59


def test_numbers_of_hashed_ids_in_one_site(spark):
    ids = spark.range(20_000).select(F.lit("e.org").alias("site"), F.xxhash64("id").alias("page_id"))
    rows = numbered(ids, "site", "page_id", "number", bucket=500).orderBy("page_id").collect()
    assert [r["number"] for r in rows] == list(range(1, 20_001))


def test_ranges_of_outlier_keys_are_even(spark):
    """One key far away, dense runs, hashed keys and a hot group: no range above twice the target."""
    ids = [(f"s{i % 3}", i) for i in range(300)] + [(f"s{i}", i + 10**12) for i in range(3)] + [("hot", i) for i in range(2000)]
    ids += [("hot", 10**15), ("hashed", -(2**62)), ("hashed", 2**62), (None, 4), (None, 3)]
    rows = spark.createDataFrame(ids, "site string, page_id long").repartition(6)
    sizes = [r["count"] for r in ranged(rows, "site", ["page_id"], 16).groupBy("_range").count().collect()]
    assert sum(sizes) == len(ids) and max(sizes) <= 32
    got = {(r["site"], r["page_id"]): r["number"] for r in numbered(rows, "site", "page_id", "number", bucket=16).collect()}
    for site in {s for s, _ in ids}:
        assert [got[site, i] for i in sorted(i for s, i in ids if s == site)] == list(range(1, sum(s == site for s, _ in ids) + 1))
    assert numbered(rows.where("false"), "site", "page_id", "number").count() == 0


def plain_depths(n, edges):
    depths, level = {"n0": 0}, ["n0"]
    while level:
        nexts = [d for s, d in edges if s in set(level) and d not in depths]
        for d in nexts:
            depths[d] = depths[level[0]] + 1
        level = list(dict.fromkeys(nexts))
    return {f"n{i}": depths.get(f"n{i}") for i in range(n)}


def found_depths(spark, n, edges, **how):
    nodes = spark.createDataFrame([("s", f"n{i}") for i in range(n)], "site string, node string")
    frame = spark.createDataFrame([("s", *e) for e in edges], "site string, src string, dst string")
    homes = spark.createDataFrame([("s", "n0")], "site string, home string")
    return {r["node"]: r["depth"] for r in graph.click_depths(nodes, frame.distinct(), homes, **how).collect()}


def test_depth_of_a_chain_of_5000_pages(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "materialised", lambda frame: written.append(1) or shared.materialised(frame))
    n = 5000
    edges = [(f"n{i}", f"n{i + 1}") for i in range(n - 1)] + [("n4000", "n4500"), (f"n{n}", f"n{n + 1}"), (f"n{n + 1}", f"n{n}")]
    want = {f"n{i}": i if i < 4500 else min(i, i - 4500 + 4001) for i in range(n)} | {f"n{n}": None, f"n{n + 1}": None}
    assert found_depths(spark, n + 2, edges, small=0) == want
    assert len(written) < 60  # jobs grow with the logarithm of the depth
    near = found_depths(spark, n + 2, edges, rounds=3)
    assert near["n3"] == 3 and near["n4"] is None


def test_depth_of_a_chain_with_links_both_ways(spark):
    n = 1200
    edges = [(f"n{i}", f"n{j}") for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n]
    assert found_depths(spark, n, edges) == {f"n{i}": i for i in range(n)}


@pytest.mark.parametrize("small", [0, 10_000])
def test_depths_of_random_graphs(spark, small):
    for seed in (1, 2):
        rnd = random.Random(seed)
        n = 120
        edges = {(f"n{i}", f"n{max(0, min(n - 1, i + rnd.randint(-6, 2)))}") for i in range(n) for _ in range(rnd.choice((1, 1, 2)))}
        edges = sorted(e for e in edges if e[0] != e[1])
        assert found_depths(spark, n, edges, near=2, small=small) == plain_depths(n, edges)


def test_tables_can_be_removed(spark):
    stored = shared.materialised(spark.range(5))
    assert stored.count() == 5
    shared.remove_tables(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared.tables_dir(spark))
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_a_file_of_one_row_group_is_dealt_over_the_cores(spark, tmp_path):
    """Only one of the many splits of such a file has rows; so a single task worked on all of them."""
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    held = lambda frame: [r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        read = spark.read.parquet(str(tmp_path / "one"))
        assert read.rdd.getNumPartitions() > 8 and held(read) == [4000]
        dealt = tables.spread(read, "doc_id")
        assert max(held(dealt)) * spark.sparkContext.defaultParallelism <= 2 * 4000
        assert dealt.exceptAll(rows).isEmpty() and dealt.count() == 4000
        even = spark.range(4000, numPartitions=16)
        assert tables.spread(even, "id") is even and tables.spread(read.where("false"), "doc_id").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
