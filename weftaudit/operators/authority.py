"""Authority figures: alias resolution, provider choice and the authority pillar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftaudit.functions.common import round2
from weftaudit.functions.grades import clamp, grade

# Metric label, accepted spellings in order, weight and scale.
METRICS = [
    ("Link Profile Strength", ["link_profile_strength", "linkProfileStrength", "lps"], 0.15, "plain"),
    ("Domain Authority", ["domain_authority", "domainAuthority", "da"], 0.18, "plain"),
    ("Page Authority", ["page_authority", "pageAuthority", "pa"], 0.12, "plain"),
    ("Citation Flow", ["citation_flow", "citationFlow", "cf"], 0.10, "plain"),
    ("Trust Flow", ["trust_flow", "trustFlow", "tf"], 0.15, "plain"),
    ("External Backlinks", ["external_backlinks", "externalBacklinks", "backlinks"], 0.10, "log4"),
    ("Referring Domains", ["referring_domains", "refDomains", "referringDomains"], 0.10, "log3"),
    ("Referring IPs", ["referring_ips", "refIPs", "referringIPs"], 0.05, "log3"),
    ("Top Rank", ["top_rank", "topRank", "rank"], 0.03, "rank"),
    ("Facebook Shares", ["facebook_shares", "facebookShares", "shares"], 0.02, "log3"),
]
NEUTRAL_SCORE = 50.0
NEUTRAL_ISSUE = "Authority data was not provided; educational mode enabled with a neutral score of 50."
NEUTRAL_PASSED = "Provide authority_data to replace the neutral score with measured backlink metrics."


def alias_table(spark: SparkSession) -> DataFrame:
    """The fixed table of spellings (thirty rows)."""
    rows = [
        (name, i, label, ord_, weight, scale)
        for ord_, (label, names, weight, scale) in enumerate(METRICS)
        for i, name in enumerate(names)
    ]
    return spark.createDataFrame(
        rows, "metric string, alias_ord int, label string, ord int, weight double, scale string"
    )


def normalise_metric(value: Column, scale: Column) -> Column:
    """A raw figure on the 0-100 scale of its kind."""
    logged = F.log10(F.greatest(value, F.lit(0.0)) + 1.0)
    by_rank = F.when(value <= 0, F.lit(0.0)).otherwise(clamp(F.lit(100.0) - F.log10(value) / 7.0 * 100.0))
    return (
        F.when(scale == "log4", clamp(logged / 4.0 * 100.0))
        .when(scale == "log3", clamp(logged / 3.0 * 100.0))
        .when(scale == "rank", by_rank)
        .otherwise(clamp(value))
    )


def resolved_metrics(metrics: DataFrame) -> DataFrame:
    """One value per domain, provider and label: the first spelling that has a value."""
    named = metrics.where(F.col("value").isNotNull()).join(
        F.broadcast(alias_table(metrics.sparkSession)), "metric"
    )
    return named.groupBy("domain", "provider", "priority", "label", "ord", "weight", "scale").agg(
        F.min_by("value", "alias_ord").alias("value")
    )


def provider_choice(metrics: DataFrame) -> DataFrame:
    """Per domain the ten labels of its first provider that has any value."""
    per_provider = resolved_metrics(metrics).groupBy("domain", "provider", "priority").agg(
        F.array_sort(F.collect_list(F.struct("ord", "label", "value", "weight", "scale"))).alias("found")
    )
    return per_provider.groupBy("domain").agg(
        F.min_by(F.struct("provider", "found"), "priority").alias("p")
    ).select("domain", "p.provider", "p.found")


def authority_scores(domains: DataFrame, metrics: DataFrame) -> DataFrame:
    """``domain, provider, educational_mode, authority`` with the pillar struct."""
    chosen = domains.join(provider_choice(metrics), "domain", "left")
    shown = F.transform(
        "found",
        lambda m: F.struct(
            m["label"].alias("label"), m["weight"].alias("weight"), normalise_metric(m["value"], m["scale"]).alias("n")
        ),
    )
    scored = chosen.select("domain", "provider", F.col("found").isNull().alias("educational_mode"), shown.alias("m"))
    total = F.aggregate("m", F.lit(0.0), lambda acc, m: acc + m["n"] * m["weight"])
    weight = F.aggregate("m", F.lit(0.0), lambda acc, m: acc + m["weight"])
    raw = F.when(F.col("educational_mode"), F.lit(NEUTRAL_SCORE)).otherwise(total / weight)

    def verdicts(label: str) -> tuple[Column, Column]:
        hit = F.get(F.filter("m", lambda m: m["label"] == label), F.lit(0))["n"]
        issue = F.when(hit.isNull(), f"{label} was not provided").when(hit < 40, f"{label} is weak")
        return issue, F.when(hit >= 70, f"{label} is strong")

    pairs = [verdicts(label) for label, _, _, _ in METRICS]
    issues = F.when(F.col("educational_mode"), F.array(F.lit(NEUTRAL_ISSUE))).otherwise(
        F.array_compact(F.array(*[i for i, _ in pairs]))
    )
    passed = F.when(F.col("educational_mode"), F.array(F.lit(NEUTRAL_PASSED))).otherwise(
        F.array_compact(F.array(*[p for _, p in pairs]))
    )
    return scored.withColumn("raw", raw).select(
        "domain",
        "provider",
        "educational_mode",
        F.struct(
            round2(clamp(F.col("raw"))).alias("score"),
            grade(F.col("raw")).alias("grade"),
            issues.alias("issues"),
            passed.alias("passed"),
        ).alias("authority"),
    )
