"""Click depth and crawl order: joins whose levels are stored tables, and pointer doubling for what lies deep."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftaudit.functions import urls
from weftaudit.operators import robots
from weftaudit.operators.rows import unrolled
from weftaudit.sources.shared import bucketed, materialised


def homepages(facts: DataFrame, site_meta: DataFrame) -> DataFrame:
    """Graph key of the home page of each site: given page, base address, or first page."""
    first = facts.where(F.col("url") != "").groupBy("site").agg(F.min_by("url", "page_id").alias("first_url"))
    both = first.join(site_meta.select("site", "homepage_url", "base_url"), "site", "left")
    picked = F.coalesce(F.nullif("homepage_url", F.lit("")), F.nullif("base_url", F.lit("")), "first_url")
    return both.select("site", urls.graph_key(picked).alias("home"))


#: Levels searched by one join each; what lies deeper is contracted first.
NEAR = 8
#: Edges of the contracted rest of a site that one task works off at most.
SMALL = 200_000


def click_depths(nodes: DataFrame, edges: DataFrame, homes: DataFrame, rounds: int | None = None, near: int = NEAR, small: int = SMALL) -> DataFrame:
    """Depth of every page by breadth-first search from the home page of its site; null if it cannot be reached.

    All sites advance together, one join per level, for ``near`` levels (``rounds``, if given,
    ends the search there: pages further away get a null depth). Deeper pages are mostly long
    chains. A page with one link from what is not reached yet hangs on that page; pointer
    doubling takes all pages of such a chain to its head in a number of jobs that is the
    logarithm of its length. The heads keep weighted edges, few enough in most sites for one task
    per site; a site with more than ``small`` of them is relaxed by joins until nothing improves.
    No depth is cut off. ``nodes`` should be a stored table.
    """
    start = homes.select("site", F.col("home").alias("node")).join(nodes, ["site", "node"], "left_semi")
    level = materialised(start.distinct().withColumn("depth", F.lit(0).cast("bigint")))
    reached = level
    edges = bucketed(edges, ["site", "src"])
    for depth in range(1, (near if rounds is None else rounds) + 1):
        nexts = (
            level.select("site", F.col("node").alias("src"))
            .join(edges, ["site", "src"])
            .select("site", F.col("dst").alias("node"))
            .distinct()
            .join(reached, ["site", "node"], "left_anti")
            .withColumn("depth", F.lit(depth).cast("bigint"))
        )
        level = materialised(nexts)
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    else:
        if rounds is None:
            reached = reached.unionByName(_deeper(edges, reached, level, small))
    return nodes.join(reached, ["site", "node"], "left")


def _deeper(edges: DataFrame, reached: DataFrame, level: DataFrame, small: int) -> DataFrame:
    """Depths of the pages beyond the last level of a search."""
    done = reached.select("site", "node")
    inner = done.join(level, ["site", "node"], "left_anti")
    rest = edges.join(done.withColumnRenamed("node", "dst"), ["site", "dst"], "left_anti")
    rest = materialised(rest.join(inner.withColumnRenamed("node", "src"), ["site", "src"], "left_anti"))
    heads = chain_heads(rest)
    hanging = heads.select("site", "node")
    onward = rest.join(hanging.withColumnRenamed("node", "dst"), ["site", "dst"], "left_anti")
    moved = onward.join(heads.withColumnRenamed("node", "src"), ["site", "src"], "left").select(
        "site", F.coalesce("head", "src").alias("src"), "dst", (F.coalesce("hops", F.lit(0)) + 1).alias("weight")
    )
    links_between = materialised(moved.where("src <> dst").groupBy("site", "src", "dst").agg(F.min("weight").alias("weight")))
    found = least_weights(links_between, level, small)
    along = heads.join(found.withColumnRenamed("node", "head"), ["site", "head"])
    both = found.unionByName(along.select("site", "node", (F.col("depth") + F.col("hops")).alias("depth")))
    return materialised(both.join(level.select("site", "node"), ["site", "node"], "left_anti"))


def chain_heads(edges: DataFrame) -> DataFrame:
    """(site, node, head, hops) of the nodes with one incoming edge: the nearest node before them that is none of these.

    Pointers double: after each step every pointer reaches twice as far. Rings of such nodes
    have no head, and nothing outside leads to them; they are left out.
    """
    single = edges.groupBy("site", "dst").agg(F.count("*").alias("n"), F.min("src").alias("head")).where("n = 1")
    open_ones = materialised(single.select("site", F.col("dst").alias("node"), "head", F.lit(1).cast("bigint").alias("hops")))
    count, span, closed = open_ones.count(), 1, None
    while True:
        # A pointer is done if its head has no pointer itself; done ones are set aside and still serve as targets.
        known = open_ones if closed is None else open_ones.unionByName(closed)
        further = known.select("site", F.col("node").alias("head"), F.col("head").alias("next"), F.col("hops").alias("more"))
        stepped = materialised(open_ones.join(further, ["site", "head"], "left"))
        ended = stepped.where("next IS NULL").select("site", "node", "head", "hops")
        closed = ended if closed is None else closed.unionByName(ended)
        open_ones = stepped.where("next IS NOT NULL").select("site", "node", F.col("next").alias("head"), (F.col("hops") + F.col("more")).alias("hops"))
        span *= 2
        if span > 2 * count or open_ones.isEmpty():
            return closed


def least_weights(edges: DataFrame, starts: DataFrame, small: int) -> DataFrame:
    """(site, node, depth): the least sum of edge weights from any start, added to the depth of that start."""
    sizes = edges.groupBy("site").agg(F.count("*").alias("n"))
    large = materialised(sizes.where(F.col("n") > small).select("site"))
    begin = starts.select("site", F.lit(None).cast("string").alias("src"), F.col("node").alias("dst"), F.col("depth").alias("weight"))
    rows = edges.unionByName(begin)
    if large.isEmpty():
        return materialised(rows.groupBy("site").applyInPandas(_least_in_task, "site string, node string, depth bigint"))
    little = rows.join(large, "site", "left_anti").groupBy("site").applyInPandas(_least_in_task, "site string, node string, depth bigint")
    ways = bucketed(edges.join(large, "site", "left_semi"), ["site", "src"])
    best = materialised(starts.join(large, "site", "left_semi").select("site", "node", "depth"))
    better = best
    while not better.isEmpty():
        step = better.withColumnRenamed("node", "src").join(ways, ["site", "src"])
        offered = step.groupBy("site", F.col("dst").alias("node")).agg(F.min(F.col("depth") + F.col("weight")).alias("depth"))
        old = best.withColumnRenamed("depth", "old")
        better = materialised(offered.join(old, ["site", "node"], "left").where("old IS NULL OR depth < old").drop("old"))
        best = materialised(best.unionByName(better).groupBy("site", "node").agg(F.min("depth").alias("depth")))
    return materialised(little).unionByName(best)


def _least_in_task(rows: pd.DataFrame) -> pd.DataFrame:
    """Shortest ways inside one site of bounded size; rows without src are the starts."""
    site = rows["site"].iloc[0]
    ways: dict[str, list[tuple[str, int]]] = {}
    heap = []
    for src, dst, weight in zip(rows["src"], rows["dst"], rows["weight"]):
        if src is None or src != src:
            heap.append((int(weight), dst))
        else:
            ways.setdefault(src, []).append((dst, int(weight)))
    heapq.heapify(heap)
    best: dict[str, int] = {}
    while heap:
        depth, node = heapq.heappop(heap)
        if node not in best:
            best[node] = depth
            for dst, weight in ways.get(node, ()):
                if dst not in best:
                    heapq.heappush(heap, (depth + weight, dst))
    return pd.DataFrame({"site": site, "node": list(best), "depth": list(best.values())})


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("site", F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))


def page_positions(depths: DataFrame, degrees: DataFrame, homes: DataFrame) -> DataFrame:
    """Per page: depth, in-degree and the orphan, deep and shallow flags."""
    rows = depths.join(degrees, ["site", "node"], "left").join(
        homes.select("site", F.col("home").alias("node"), F.lit(True).alias("is_home")), ["site", "node"], "left"
    )
    return rows.select(
        "site",
        "node",
        "depth",
        F.coalesce("in_degree", F.lit(0).cast("bigint")).alias("in_degree"),
        (F.col("in_degree").isNull() & F.col("is_home").isNull()).alias("orphan"),
        (F.col("depth").isNull() | (F.col("depth") > 3)).alias("deep"),
        F.coalesce(F.col("depth") <= 2, F.lit(False)).alias("shallow"),
    )


def position_counts(positions: DataFrame) -> DataFrame:
    return positions.groupBy("site").agg(
        F.count("*").alias("nodes"),
        F.count_if("orphan").alias("orphans"),
        F.count_if("deep").alias("deep"),
        F.count_if("shallow").alias("shallow"),
    )


def crawl_links(facts: DataFrame) -> DataFrame:
    """Links a crawler would follow, by crawl key and place on the page."""
    usable = F.filter(
        "links", lambda x: x["internal"] & urls.is_crawlable(x["absolute_url"])
    )
    return (
        facts.where("fetched")
        .transform(unrolled, ["site", urls.crawl_key(F.col("url")).alias("src")], usable, "l", "pos")
        .select("site", "src", F.col("pos").cast("bigint").alias("pos"), urls.crawl_key(F.col("l.absolute_url")).alias("dst"))
    )


def crawl_order(
    links: DataFrame,
    stored: DataFrame,
    seeds: DataFrame,
    rules: DataFrame,
    max_pages: int = 50,
    max_depth: int = 3,
) -> DataFrame:
    """The pages a breadth-first crawl of the stored web would visit, in order.

    ``seeds`` has site and url, ``stored`` site and url (crawl key) of pages
    that answer, ``rules`` the robots rules that count (``robots.active_rules``). Each level keeps at
    most ``max_pages`` rows per site (that cap is the feature), so the window
    over a site stays small however many pages the site has.
    """
    candidates = seeds.select(
        "site", urls.crawl_key(F.col("url")).alias("url"), F.lit(0).cast("bigint").alias("parent"), F.lit(0).cast("bigint").alias("pos")
    )
    visited: DataFrame | None = None
    for depth in range(max_depth + 1):
        found = candidates.groupBy("site", "url").agg(F.min(F.struct("parent", "pos")).alias("place"))
        if visited is not None:
            found = found.join(visited, ["site", "url"], "left_anti")
        found = robots.with_allowed(found, rules).where("allowed").drop("allowed")
        place = Window.partitionBy("site").orderBy("place")
        ranked = found.withColumn("ord", F.row_number().over(place).cast("bigint"))
        if visited is not None:
            done = visited.groupBy("site").agg(F.count("*").alias("done"))
            ranked = ranked.join(done, "site", "left").withColumn("ord", F.col("ord") + F.coalesce("done", F.lit(0)))
        level = materialised(
            ranked.where(F.col("ord") <= max_pages).select(
                "site", "url", "ord", F.lit(depth).cast("bigint").alias("depth")
            )
        )
        visited = level if visited is None else visited.unionByName(level)
        if depth == max_depth or level.isEmpty():
            break
        candidates = (
            level.select("site", F.col("url").alias("src"), F.col("ord").alias("parent"))
            .join(links, ["site", "src"])
            .select("site", F.col("dst").alias("url"), "parent", "pos")
        )
    found_pages = stored.select("site", "url", F.lit(True).alias("found")).distinct()
    return visited.join(found_pages, ["site", "url"], "left").select(
        "site", "url", "ord", "depth", F.coalesce("found", F.lit(False)).alias("found")
    )
