"""Robots rules as data: the first rule of the agent whose prefix begins the path decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftaudit.functions import urls


def active_rules(rules: DataFrame, agent: str) -> DataFrame:
    """(site, prefix, ord, allow): the rules that count for the agent, the first one of each prefix.

    Rules naming the agent replace the general ones of the site.
    """
    asked = rules.where(F.col("agent").isin(agent, "*"))
    own = asked.where(F.col("agent") == agent).select("site").distinct().withColumn("own", F.lit(agent))
    counted = asked.join(own, "site", "left").where(F.col("agent") == F.coalesce("own", F.lit("*")))
    return counted.groupBy("site", "prefix").agg(F.min("ord").alias("ord"), F.min_by("allow", "ord").alias("allow"))


def target(url: Column) -> Column:
    """The part of an address that rules look at: path and query."""
    return urls.bind(
        urls.parts(url),
        lambda p: F.concat(
            F.when(p["path"] == "", F.lit("/")).otherwise(p["path"]),
            F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(F.lit("")),
        ),
    )


def forbidden(addresses: DataFrame, active: DataFrame) -> DataFrame:
    """The distinct (site, url) of ``addresses`` that the rules of their site forbid.

    The prefixes of a site are an index: an address is looked up once for each length that
    prefixes of its site have, by equality. So the number of rules of a site does not matter, and
    one join finds all rules that begin an address.
    """
    lengths = active.groupBy("site").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    asked = addresses.select("site", "url").distinct().withColumn("target", target(F.col("url")))
    fitting = F.filter("lengths", lambda n: n <= F.length("target"))
    begins = asked.join(lengths, "site").select("site", "url", F.explode(F.transform(fitting, lambda n: F.substring("target", F.lit(1), n))).alias("prefix"))
    first = begins.join(active, ["site", "prefix"]).groupBy("site", "url").agg(F.min_by("allow", "ord").alias("allow"))
    return first.where("NOT allow").select("site", "url")


def with_allowed(rows: DataFrame, active: DataFrame) -> DataFrame:
    """``rows`` (with site and url) and whether they may be fetched; without a matching rule they may."""
    no = forbidden(rows, active).withColumn("allowed", F.lit(False))
    return rows.join(no, ["site", "url"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))
