"""Robots rules and addresses as indexes, and tables that are updated by commits."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from weftaudit.operators import addresses, ops, robots
from weftaudit.sources.versioned import VersionedTable

RULE = "site string, agent string, ord long, allow boolean, prefix string"


def plain_allowed(rules, site, agent, path):
    own = [r for r in rules if r[0] == site and r[1] == agent] or [r for r in rules if r[0] == site and r[1] == "*"]
    for rule in sorted(own, key=lambda r: r[2]):
        if path.startswith(rule[4]):
            return rule[3]
    return True


def test_first_matching_rule_decides(spark):
    rnd = random.Random(4)
    some = lambda: "/" + "".join(rnd.choice("ab/?") for _ in range(rnd.randint(0, 5)))
    rules = [(s, rnd.choice(["*", "*", "me", "you"]) if s != "t" else "*", i, rnd.random() < 0.4, some()) for s in "rst" for i in range(25)]
    rules += [("u", "*", 1, False, ""), ("v", "you", 1, False, "/")]
    paths = [(s, some()) for s in "rstuvw" for _ in range(40)]
    pages = spark.createDataFrame([(s, f"https://{s}.org{p}", p) for s, p in paths] * 2, "site string, url string, path string")
    active = robots.active_rules(spark.createDataFrame(rules, RULE), "me")
    rows = robots.with_allowed(pages.where(~F.col("path").endswith("?")), active).collect()
    assert len(rows) == 2 * len([p for _, p in paths if not p.endswith("?")])
    for r in rows:
        assert r["allowed"] == plain_allowed(rules, r["site"], "me", r["path"]), r


def test_many_rules_of_one_site(spark):
    rules = spark.range(100_000).select(
        F.lit("s").alias("site"), F.lit("*").alias("agent"), F.col("id").alias("ord"), (F.col("id") % 2 == 0).alias("allow"),
        F.concat(F.lit("/p/"), F.col("id").cast("string"), F.lit("/")).alias("prefix"),
    )
    pages = spark.range(2000).select(F.lit("s").alias("site"), F.concat(F.lit("https://s.org/p/"), (F.col("id") * 7).cast("string"), F.lit("/x")).alias("url"), "id")
    found = robots.with_allowed(pages, robots.active_rules(rules, "me"))
    assert {r["id"]: r["allowed"] for r in found.collect()} == {i: i % 2 == 0 for i in range(2000)}


ROW = "id long, a string, b long"


def test_commits_replays_and_losers(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "id", ROW, buckets=4)
    read = lambda: sorted(map(tuple, table.rows().collect()))
    frame = lambda rows: spark.createDataFrame(rows, "id long, a string, b long, at long")
    assert read() == []
    assert table.insert("one", frame([(1, "x", 1, 0), (2, "y", 2, 0), (2, "z", 0, 0), (3, None, 3, 0)]).drop("at"))
    assert read() == [(1, "x", 1), (2, "y", 2), (3, None, 3)]
    changes = frame([(1, "first", 0, 1), (1, "last", None, 2), (9, "unknown", 0, 1)])
    assert table.update("two", changes, ["at"], ["a"]) and not table.update("two", changes, ["at"], ["a"])
    assert read() == [(1, "last", 1), (2, "y", 2), (3, None, 3)]
    assert not table.insert("one", frame([(7, "new", 7, 0)]).drop("at"))
    assert table.insert("three", frame([(1, "no", 9, 0), (7, "new", 7, 0)]).drop("at"))
    assert read() == [(1, "last", 1), (2, "y", 2), (3, None, 3), (7, "new", 7)]
    assert table.manifest()["version"] == 3 and table.manifest()["labels"] == ["one", "two", "three"]
    late = table.manifest()
    table.update("four", frame([(2, "four", 0, 1)]), ["at"], ["a"])
    with pytest.raises(RuntimeError, match="another writer"):  # a writer that read before the last commit
        table._publish({**late, "version": late["version"] + 1})
    assert read()[1] == (2, "four", 2)
    assert table.update("five", frame([]), ["at"], ["a"]) and len(read()) == 4


def test_job_states(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    jobs = ops.job_table(spark, str(tmp_path / "jobs"))
    ops.create_jobs(jobs, "c", spark.createDataFrame([(1, 5, 10, at(0)), (2, 5, 20, at(0))], "job_id long, owner long, max_pages long, created_at timestamp_ntz"))
    schema = "job_id long, status string, ts timestamp_ntz, report_path string, error string"
    ops.update_jobs(jobs, "u", spark.createDataFrame([(1, "running", at(1), None, None), (1, "completed", at(2), "r.json", None)], schema))
    got = {r["job_id"]: (r["status"], r["finished_at"], r["report_path"]) for r in jobs.rows().collect()}
    assert got == {1: ("completed", at(2), "r.json"), 2: ("pending", None, None)}
    ops.update_jobs(jobs, "again", spark.createDataFrame([(1, "running", at(3), None, None)], schema))
    assert {r["job_id"]: (r["status"], r["finished_at"], r["report_path"]) for r in jobs.rows().collect()}[1] == ("running", None, None)


def test_addresses_are_found_by_their_rarest_parts(spark, tmp_path):
    rnd = random.Random(3)
    urls = [f"https://s{i % 3}.org/" + "".join(rnd.choice("ab/é") for _ in range(rnd.randint(0, 8))) for i in range(120)] + ["x", "", None, "https://s0.org/only-here"]
    rows = [(i, f"s{i % 3}", u) for i, u in enumerate(urls)]
    index = addresses.AddressIndex(spark, str(tmp_path / "index"))
    frame = spark.createDataFrame(rows, "page_id long, site string, url string")
    for part in (0, 1):  # in two parts
        index.add(frame.where(F.col("page_id") % 2 == part))
    for wanted in ("/ab", "aa", "", "/", "only-here", "é/a", "not there", "https://s1.org/"):
        want = {r for r in rows if r[2] is not None and wanted in r[2]}
        assert {tuple(r) for r in index.holding(wanted).collect()} == want
        first = {s: min(i for i, t, _ in want if t == s) for s in {t for _, t, _ in want}}
        assert {r["site"]: r["page_id"] for r in index.first_of_sites(wanted).collect()} == first
    assert index.rarest("https://s0.org/only-here")[0] in {"onl", "nly", "ly-", "y-h", "-he", "her", "ere"} and index.rarest("ab") is None


def test_a_lookup_reads_the_rows_of_its_parts_only(spark, tmp_path):
    """No more rows leave the index's scans than the rarest parts and the folders of candidates have."""
    frame = spark.range(3000).selectExpr("id AS page_id", "'s' AS site", "concat('https://s.org/page/', id, '/end') AS url")
    index = addresses.AddressIndex(spark, str(tmp_path / "index"))
    index.add(frame)
    plan = index.holding("/2718/")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "PushedFilters: [IsNotNull(part), EqualTo(part," in plan
    assert [r["page_id"] for r in index.holding("/2718/").collect()] == [2718]
