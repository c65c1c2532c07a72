"""Scores by address, and states that are part of others."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from weftaudit.operators import recommend

KEYS = "rec_id string, site string, rule string, severity string, exact_fix string"


def test_scores_by_address_then_site_then_default(spark):
    pages = spark.createDataFrame(
        [("a", 1, "https://a/x/"), ("a", 2, "https://a/y"), ("a", 3, "https://a/z"), ("b", 4, "https://b/"), ("c", 5, "https://c"), ("a", 6, "https://a/x"), ("a", 7, None)],
        "site string, page_id long, url string",
    )
    scores = spark.createDataFrame(
        [("a", 9, "https://a/x//", 10.0), ("a", 10, "https://a/x", 20.0), ("a", 11, "https://a/y/", 31.0), ("a", 12, "https://a/y//", 32.0), ("b", 1, "https://a/z", 1.0), ("a", 13, "https://a/z", None)],
        "site string, page_id long, url string, overall double",
    )
    sites = spark.createDataFrame([("a", 55.0), ("b", 0.0)], "site string, overall double")
    got = {r["page_id"]: r["overall"] for r in recommend.resolved_scores(pages, scores, lambda: sites).collect()}
    assert got == {1: 20.0, 2: 31.0, 3: 55.0, 4: 80.0, 5: 80.0, 6: 20.0, 7: 55.0}
    known = pages.where("page_id IN (1, 2, 6)")

    def asked():
        raise AssertionError("no page is without a score")

    assert recommend.resolved_scores(known, scores, asked).count() == 3
    alone = {r["page_id"]: r["overall"] for r in recommend.resolved_scores(pages, scores).collect()}
    assert alone[3] == 80.0


def plain_join(states):
    """One state after the other, as the joined text grows."""
    kept = []
    for state in states:
        if state and not any(state in k for k in kept):
            kept.append(state)
    return kept


def test_contained_states_are_dropped_in_first_seen_order(spark):
    rnd = random.Random(8)
    groups = {
        "one": ["only"],
        "none": [""],
        "fixed": ["Found 2 H1 tags: a, b", "Found 2 H1 tags: a", "", "tags", "Found 2 H1 tags: a, b, c", "x", "a", "H1", "Found 2 H1 tags: a, b, c, d"],
    }
    for g in range(3):
        words = [rnd.choice(["ab", "abc", "b", "long common words here ", "é", "zz"]) for _ in range(8)]
        groups[f"random{g}"] = list(dict.fromkeys("".join(rnd.choices(words, k=rnd.randint(1, 6))) for _ in range(80)))
    rows = [(g, "s", "r", "High", "f", state, (i // 3, i % 3)) for g, own in groups.items() for i, state in enumerate(own)]
    states = spark.createDataFrame(rows, f"{KEYS}, current_state string, place struct<page_id:long,ord:long>").repartition(4)
    for gram in (recommend.GRAM, 3):
        found = recommend.kept_states(states, gram)
        got = {}
        for r in found.where("kept").orderBy("ord").collect():
            got.setdefault(r["rec_id"], []).append((r["ord"], r["current_state"]))
        assert found.count() == len(rows)
        want = {g: list(enumerate(plain_join(own), 1)) for g, own in groups.items()}
        assert got == {g: w for g, w in want.items() if w}
    joined = {r["rec_id"]: (r["n_states"], r["joined_state"]) for r in recommend.joined_states(found).collect()}
    assert joined == {g: (len(w), " | ".join(s for _, s in w)) for g, w in want.items()}
    short = {r["rec_id"]: (r["n_states"], r["joined_state"]) for r in recommend.joined_states(found, most=1).collect()}
    assert short["one"] == (1, "only") and short["fixed"] == (len(want["fixed"]), None)


def test_all_states_are_joined_however_many_there_are(spark):
    n = 10_500
    rows = spark.range(n, numPartitions=4).select(
        F.lit("many").alias("rec_id"), F.lit("s").alias("site"), F.lit("r").alias("rule"), F.lit("High").alias("severity"), F.lit("f").alias("exact_fix"),
        F.format_string("state %05d", "id").alias("current_state"), F.when(F.col("id") % 100 != 7, F.col("id") - F.floor((F.col("id") + 92) / 100) + 1).alias("ord"),
    )
    none = spark.createDataFrame([("none", "s", "r", "High", None, "", None)], f"{KEYS}, current_state string, ord long")
    kept = rows.unionByName(none).repartition(6)
    want = [f"state {i:05d}" for i in range(n) if i % 100 != 7]
    got = {r["rec_id"]: (r["n_states"], r["joined_state"]) for r in recommend.joined_states(kept).collect()}
    assert got == {"many": (len(want), " | ".join(want)), "none": (0, "")}


def test_states_are_not_compared_in_pairs(spark):
    """Many states with a common beginning and end: each looks up its rarest part, which no other one holds."""
    rows = [(1, "s", "r", "High", "f", f"Current title is 70 characters: about number {i:06d} and more", (i, 0)) for i in range(3000)]
    states = spark.createDataFrame(rows, f"{KEYS}, current_state string, place struct<page_id:long,ord:long>")
    found = recommend.kept_states(states)
    assert found.where(F.col("kept")).count() == 3000


def test_no_index_of_parts_goes_through_the_driver(spark, monkeypatch):
    """Like texts are stored in few bytes, by which a planner would broadcast the whole index."""
    rows = [(i % 2, "s", "r", "High", "f", f"{'the same long words, ' * 20}number {i:05d}{' and more' * (i % 3)}", (i, 0)) for i in range(600)]
    states = spark.createDataFrame(rows, f"{KEYS}, current_state string, place struct<page_id:long,ord:long>")
    plans = []

    def seen(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return stored(frame)

    stored = recommend.materialised
    monkeypatch.setattr(recommend, "materialised", seen)
    found = recommend.kept_states(states)
    assert found.where("kept").count() == 600
    by_part = [line for plan in plans for line in plan.splitlines() if re.search(r"Join \[[^\]]*\bpart#", line)]
    assert by_part and not [line for line in by_part if "Broadcast" in line]
