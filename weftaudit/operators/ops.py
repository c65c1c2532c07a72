"""Job, quota, audit-log and monitoring operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftaudit.functions.common import round2, say
from weftaudit.sources.versioned import VersionedTable

# Limits per tier; an unknown tier gets the first one.
TIERS = [
    ("free", 10, 50, 5, 2, False, False),
    ("standard", 50, 500, 20, 3, True, True),
    ("full", 200, 2000, 100, 5, True, True),
]
# Share of the progress bar per stage (start, width).
STAGES = {"crawl": (0.0, 50.0), "analyze": (50.0, 40.0), "score": (90.0, 5.0), "finish": (95.0, 5.0)}


def tier_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        TIERS,
        "tier string, max_pages_per_run bigint, max_pages_stored bigint, max_analyses_per_month bigint, tier_depth bigint, "
        "include_ai_assistant boolean, include_google_docs boolean",
    )


def clamped_requests(requests: DataFrame) -> DataFrame:
    """Requests with their pages and depth cut to the limits of the tier."""
    tiers = F.broadcast(tier_table(requests.sparkSession))
    known = [t[0] for t in TIERS]
    rows = requests.withColumn("tier", F.when(F.col("tier").isin(known), F.col("tier")).otherwise(F.lit(known[0])))
    return rows.join(tiers, "tier").select(
        *requests.columns,
        F.least(F.coalesce("max_pages", "max_pages_per_run"), "max_pages_per_run").alias("pages_allowed"),
        F.col("tier_depth").alias("depth_allowed"),
    )


def monthly_usage(runs: DataFrame, owner: str, at: str, cap: int) -> DataFrame:
    """Runs per owner and month with what is left of the cap."""
    return runs.groupBy(owner, F.date_trunc("month", F.col(at)).cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("used")).select(
        "*", F.greatest(F.lit(0).cast("bigint"), F.lit(cap) - F.col("used")).alias("remaining"),
        (F.col("used") >= cap).alias("limit_reached"),
    )


def latest_status(log: DataFrame, job: str, status: str, at: str, tie: str) -> DataFrame:
    """Newest status per job."""
    return log.groupBy(job).agg(F.max_by(status, F.struct(at, tie)).alias("status"), F.max(at).alias("changed_at"))


JOB = "job_id bigint, owner bigint, max_pages bigint, created_at timestamp_ntz, status string, finished_at timestamp_ntz, report_path string, error string"


def job_table(spark: SparkSession, path: str) -> VersionedTable:
    """Stored jobs by their id."""
    return VersionedTable(spark, path, "job_id", JOB)


def create_jobs(jobs: VersionedTable, label: str, requests: DataFrame) -> bool:
    """Add jobs as pending; an id that is there already keeps its job. False if the label was applied before."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("finished_at", "timestamp_ntz"), ("report_path", "string"), ("error", "string"))]
    return jobs.insert(label, requests.select("job_id", "owner", "max_pages", "created_at", F.lit("pending").alias("status"), *none))


def update_jobs(jobs: VersionedTable, label: str, changes: DataFrame) -> bool:
    """Set status, report and error of stored jobs from their last change (job_id, status, ts, report_path, error).

    The time of a change is the end of the job if its status is a final one, and else there is no
    end. Changes of unknown jobs are passed over. False if the label was applied before.
    """
    ended = F.when(F.col("status").isin("completed", "failed"), F.col("ts"))
    return jobs.update(label, changes.withColumn("finished_at", ended), ["ts", "status", "report_path", "error"], ["status", "finished_at", "report_path", "error"])


def status_funnel(jobs: DataFrame) -> DataFrame:
    """Jobs per status with their mean and longest duration in seconds."""
    return jobs.groupBy("status").agg(
        F.count("*").alias("jobs"),
        F.count("seconds").alias("timed"),
        round2(F.sum("seconds").cast("double") / F.count("seconds").cast("double")).alias("mean_seconds"),
        F.max("seconds").alias("longest_seconds"),
    )


def audit_rollup(log: DataFrame, key: str, action: str, at: str) -> DataFrame:
    """Log entries per key, action and day."""
    return log.groupBy(key, action, F.date_trunc("day", F.col(at)).cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("entries"))


def progress(stage: Column, done: Column) -> Column:
    """Percentage of a job from its stage and the finished share (0-1) of that stage."""
    value = F.lit(100.0)
    for name, (start, width) in STAGES.items():
        value = F.when(stage == name, F.lit(start) + done * F.lit(width)).otherwise(value)
    return round2(F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)))


def list_jobs(jobs: DataFrame, owner: int | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest jobs first; the owner filter comes before the limit."""
    rows = jobs if owner is None else jobs.where(F.col("owner") == owner)
    return rows.orderBy(F.desc("created_at"), F.desc("job_id")).offset(offset).limit(limit)


def audit_changes(history: DataFrame) -> DataFrame:
    """Each audit against the one before it on the same site.

    A site with very many audits is cut by day: inside a day a window looks
    back one row, and the first audit of a day takes the last one of the
    latest earlier day, found from one row per site and day.
    """
    seen = F.struct("seo_score", "broken_links")
    days = history.withColumn("_day", F.date_trunc("day", "ts"))
    tails = days.groupBy("site", "_day").agg(F.max_by(seen, F.struct("ts", "run_id")).alias("tail"))
    earlier = tails.select(
        "site", "_day", F.lag("tail").over(Window.partitionBy("site").orderBy("_day")).alias("before_day")
    )
    inside = Window.partitionBy("site", "_day").orderBy("ts", "run_id")
    rows = days.join(earlier, ["site", "_day"]).withColumn("last", F.coalesce(F.lag(seen).over(inside), "before_day"))
    changed = rows.select(
        "site", "run_id", "ts", "seo_score", "broken_links",
        (F.col("seo_score") - F.col("last.seo_score")).alias("score_change"),
        (F.col("broken_links") - F.col("last.broken_links")).alias("broken_change"),
    )
    return changed.select(
        "*", trend(F.col("score_change")).alias("trend"), broken_note(F.col("broken_change")).alias("broken_note")
    )


def audit_alerts(audits: DataFrame) -> DataFrame:
    """A row (site, ts, alert, amount) for each score drop and each rise of broken links against the audit before.

    Audits of one time are ordered by their figures.
    """
    changes = audit_changes(audits.withColumn("run_id", F.struct("seo_score", "broken_links")))
    alert = lambda name, amount: F.when(amount > 0, F.struct(F.lit(name).alias("alert"), amount.alias("amount")))
    both = F.array_compact(F.array(alert("score_drop", -F.col("score_change")), alert("new_broken_links", F.col("broken_change"))))
    return changes.select("site", "ts", F.explode(both).alias("a")).select("site", "ts", "a.alert", "a.amount")


def latest_progress(log: DataFrame, terminal: list[str]) -> DataFrame:
    """Newest state per job; once a job has finished, only another final state can follow."""
    done = F.col("status").isin(terminal)
    best = F.max(F.struct(done.alias("terminal"), "ts", "status", "progress")).alias("b")
    return log.groupBy("job_id").agg(best).select("job_id", "b.status", "b.progress", "b.terminal")


def trend(change: Column) -> Column:
    return (
        F.when(change < 0, say("SEO Score decreased by ", -change, " points"))
        .when(change > 0, say("SEO Score improved by ", change, " points"))
        .when(change == 0, F.lit("SEO Score unchanged"))
    )


def broken_note(change: Column) -> Column:
    return F.when(change > 0, say(change, " new broken link(s) detected")).when(
        change < 0, say(-change, " broken link(s) fixed")
    )


def last_messages(rows: DataFrame, k: int = 20) -> DataFrame:
    """The last ``k`` messages of each conversation with their place, oldest first.

    The rank filter is applied before the shuffle too, so a very long
    conversation sends only its newest messages.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return (
        rows.withColumn("back", F.row_number().over(newest))
        .where(F.col("back") <= k)
        .withColumn("back", F.col("back").cast("bigint"))
    )


def events_per_window(log: DataFrame, at: str, action: str, width: str = "1 day") -> DataFrame:
    """Entries per tumbling window and action; works on batch and streaming frames."""
    return log.groupBy(F.window(at, width).alias("w"), action).agg(
        F.count("*").alias("entries")
    ).select(F.col("w.start").alias("window_start"), action, "entries")
