"""Streaming jobs over files, compared with their batch results."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftaudit.operators import ops, scoring
from weftaudit.operators.facts import page_facts
from weftaudit.sources import pages as src
from weftaudit.sources.tables import derived, table
from weftaudit.streaming import jobs, processors, sinks


def drain(stream, mode, name, spark):
    with sinks._state_on_disk(spark):
        query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
        query.processAllAvailable()
        query.stop()
    return spark.table(name)


def test_page_audit_stream(spark, sf, tmp_path):
    derived(spark, sf, "pages_raw").repartition(3).write.parquet(str(tmp_path / "in"))
    cols = ["page_id", "title", "word_count", "image_count", "internal_count"]
    got = drain(jobs.audit_stream(jobs.stream_snapshots(spark, str(tmp_path / "in"), 1)).select(*cols), "append", "audit", spark)
    want = page_facts(derived(spark, sf, "pages_raw")).select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


PAGE = "page_id long, site string, url string, html string, status_code long, depth long, load_time double, error string"


def page(number, body):
    return (number, "e.org", f"https://e.org/{number}", f"<title>T</title><p>{body}</p>", 200, 0, 0.5, None)


def test_openings_are_shared_across_batches_and_restarts(spark, tmp_path):
    """A page is told when another one with its opening lands, batches and restarts later; replays change nothing."""
    schema = "site string, page_id long, opening string"
    landings = [
        [("e", 1, "same"), ("e", 2, "alone"), ("e", 5, ""), ("f", 9, "same")],
        [("e", 3, "same"), ("e", 4, "other"), ("e", 2, "alone"), ("e", 6, "")],
        [("e", 7, "same"), ("e", 8, "other")],
    ]
    told = []
    for rows in landings:
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        shared = jobs.shared_openings(jobs.stream_files(spark, str(tmp_path / "in"), schema, 1))
        sinks.run_available(shared, sinks.batch_folders(str(tmp_path / "out")), str(tmp_path / "cp"))
        told.append(sorted(r["page_id"] for r in sinks.read_batches(spark, str(tmp_path / "out"), "site string, page_id long").collect()))
    assert told == [[], [1, 3], [1, 3, 4, 7, 8]]
    sinks.run_available(shared, sinks.batch_folders(str(tmp_path / "out")), str(tmp_path / "cp"))  # nothing new
    assert sinks.read_batches(spark, str(tmp_path / "out"), "site string, page_id long").count() == 5


def test_a_replayed_batch_overwrites_its_folder(spark, tmp_path):
    sink = sinks.batch_folders(str(tmp_path))
    for _ in range(2):
        sink(spark.range(3), 0)
        sink(spark.range(5, 7), 1)
    assert sorted(map(tuple, sinks.read_batches(spark, str(tmp_path), "id long").collect())) == [(0, 0), (1, 0), (2, 0), (5, 1), (6, 1)]


def test_a_page_that_lands_again_counts_once(spark, sf, tmp_path):
    meta, status = derived(spark, sf, "site_meta"), spark.createDataFrame([("https://e.org/x", 404)], "url string, status_code long")
    audit = jobs.PageAudit(spark, str(tmp_path / "in"), str(tmp_path / "store"))
    for body in ("short", 'now with <a href="/x">a broken link</a> and ' + "many words " * 400):
        spark.createDataFrame([page(1, body)], PAGE).write.mode("append").parquet(str(tmp_path / "in"))
        audit.run(meta, status)
    (last,) = audit.pillars().collect()
    facts = page_facts(spark.createDataFrame([page(1, body)], PAGE)).withColumn("broken_count", F.lit(1).cast("long"))
    (want,) = scoring.page_pillars(scoring.scoring_input(facts, meta)).collect()
    assert {k: last[k] for k in want.asDict()} == want.asDict()


def test_event_windows_drop_late_rows(spark, tmp_path):
    """Append mode: a day is given out when the watermark has passed it, and what comes for it later is dropped."""
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    schema = "ts timestamp, event_type string"
    landings = [
        [(at(1, 1), "a"), (at(1, 23), "a"), (at(2, 0), "b")],
        [(at(1, 2), "a"), (at(2, 5), "b")],  # the watermark is 1 January, 23:00: not late yet
        [(at(1, 3), "a"), (at(2, 1), "b"), (at(9, 9), "c")],  # 2 January, 04:00: the first row is late
    ]
    for rows in landings:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        windows = jobs.event_windows(jobs.stream_files(spark, str(tmp_path / "in"), schema))
        sinks.run_available(windows, sinks.batch_folders(str(tmp_path / "out")), str(tmp_path / "cp"))
    found = sinks.read_batches(spark, str(tmp_path / "out"), "window_start timestamp, event_type string, entries long")
    assert sorted((r["window_start"], r["event_type"], r["entries"]) for r in found.collect()) == [(at(1, 0), "a", 3), (at(2, 0), "b", 3)]


def in_batches(spark, path, schema, batches, start):
    """Run a streaming job over one file per batch and return all rows it gave out."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{i:03d}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False)
    return start(source.parquet(path))


def test_job_progress_keeps_finished_jobs(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    schema = "job_id long, status string, progress double, ts timestamp"
    batches = [
        [(1, "running", 10.0, at(1)), (1, "running", 60.0, at(2)), (2, "completed", 100.0, at(3)), (2, "running", 5.0, at(0))],
        [(2, "running", 60.0, at(2))],
        [(1, "failed", 60.0, at(4)), (2, "running", 70.0, at(3))],
    ]
    rows = in_batches(spark, str(tmp_path / "log"), schema, batches, lambda s: drain(jobs.job_progress(s), "update", "prog", spark)).collect()
    got = [(r["job_id"], r["status"], r["terminal"]) for r in rows]
    assert [g for g in got if g[0] == 2] == [(2, "completed", True)]
    assert [g for g in got if g[0] == 1] == [(1, "running", False), (1, "failed", True)]


def test_states_of_jobs_are_dropped_by_their_timers(spark, tmp_path):
    """A finished job keeps its end against late rows; long after it the state is gone and the id can be used again."""
    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    schema = "job_id long, status string, progress double, ts timestamp"
    landings = [
        [(1, "completed", 100.0, at(1, 5)), (2, "running", 1.0, at(1, 5))],
        [(1, "running", 3.0, at(1, 6)), (9, "running", 1.0, at(2))],
        [(9, "running", 2.0, at(20))],
        [(1, "running", 7.0, at(20, 1)), (2, "running", 9.0, at(20, 1))],
    ]
    for rows in landings:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        log = jobs.stream_files(spark, str(tmp_path / "in"), schema)
        sinks.run_available(jobs.job_progress(log), sinks.batch_folders(str(tmp_path / "out")), str(tmp_path / "cp"), "update")
    found = sinks.read_batches(spark, str(tmp_path / "out"), "job_id long, at long, status string, progress double, terminal boolean")
    rows = [(r["job_id"], r["status"], r["progress"]) for r in found.orderBy("batch").collect()]
    assert [r for r in rows if r[0] == 1] == [(1, "completed", 100.0), (1, "running", 7.0)]
    assert [r for r in rows if r[0] == 2] == [(2, "running", 1.0), (2, "running", 9.0)]
    last = {r["job_id"]: (r["status"], r["progress"]) for r in jobs.newest_progress(found).collect()}
    assert last == {1: ("running", 7.0), 2: ("running", 9.0), 9: ("running", 2.0)}


def test_alerts_of_audits_out_of_order(spark, tmp_path):
    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    schema = "site string, ts timestamp, seo_score long, broken_links long"
    batches = [
        [("e.org", at(1, 1), 80, 0), ("e.org", at(1, 3), 90, 1), ("f.org", at(1), 50, 5)],
        [("e.org", at(1, 2), 75, 2), ("f.org", at(1, 1), 50, 5)],
        [("e.org", at(5), 60, 1), ("e.org", at(5), 61, 0), ("e.org", at(5).replace(microsecond=7), 59, 9)],
        [("f.org", at(20), 49, 7)],
        [("z.org", at(30), 1, 1)],
    ]
    stream = in_batches(spark, str(tmp_path / "au"), schema, batches, lambda s: drain(jobs.audit_alerts(s), "append", "alerts", spark))
    got = sorted(map(tuple, stream.collect()))
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    want = sorted(map(tuple, ops.audit_alerts(every).collect()))
    assert got == want and ("e.org", at(1, 2), "score_drop", 5) in got and len(got) >= 6


class Store:
    """State and timers of one key in plain dictionaries; calls are counted."""

    def __init__(self):
        self.calls, self.now, self.values, self.timers = 0, None, {}, set()

    def getValueState(self, *named):  # noqa: N802
        return self

    getMapState = getValueState  # noqa: N815

    def _counted(self, value=None):
        self.calls += 1
        return value

    def exists(self):
        return self._counted(self.now is not None)

    def get(self):
        return self._counted(self.now)

    def update(self, value):
        self.now = self._counted(value)

    def containsKey(self, key):  # noqa: N802
        return self._counted(key in self.values)

    def getValue(self, key):  # noqa: N802
        return self._counted(self.values[key])

    def updateValue(self, key, value):  # noqa: N802
        self.values[key] = self._counted(value)

    def removeKey(self, key):  # noqa: N802
        self._counted(self.values.pop(key))

    def keys(self):
        return self._counted(iter(list(self.values)))

    def registerTimer(self, ms):  # noqa: N802
        self._counted(self.timers.add(ms))

    def deleteTimer(self, ms):  # noqa: N802
        self._counted(self.timers.discard(ms))

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.watermark

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.expiry


@pytest.mark.parametrize("chunk", [3, 4096])
def test_alerts_take_few_calls_and_keep_the_order_of_times(monkeypatch, chunk):
    """Audits of a site out of order within the delay, many of one time, in batches cut anywhere."""
    monkeypatch.setattr(processors.Alerts, "CHUNK", chunk, raising=False)
    rnd = random.Random(chunk)
    store, alerts = Store(), processors.Alerts()
    alerts.init(store)
    every, found, delay = [], [], 400
    for start in range(0, 3000, 500):
        store.watermark = max(0, start - delay)
        rows = [(1000 * rnd.randint(store.watermark + 1, start + 500) + rnd.choice((0, 0, 7)), rnd.randint(1, 99), rnd.randint(0, 9)) for _ in range(300)]
        every += rows
        batch = pd.DataFrame(rows, columns=["at", "seo_score", "broken_links"])
        assert not list(alerts.handleInputRows(("e",), iter([batch[:200], batch[200:]]), store))
        store.watermark = 10**6 if start == 2500 else start + 500 - delay
        while due := sorted(t for t in store.timers if t < store.watermark):
            store.expiry = due[0]
            store.timers.remove(due[0])
            found += [tuple(r) for part in alerts.handleExpiredTimer(("e",), store, store) for r in part.itertuples(index=False)]
    every.sort()
    want = [(b[0], n, x) for a, b in zip(every, every[1:]) for n, x in (("score_drop", a[1] - b[1]), ("new_broken_links", b[2] - a[2])) if x > 0]
    assert [(at, alert, amount) for _, at, alert, amount in found] == want and not store.values and not store.timers
    assert store.calls < (2000 if chunk == 3 else 120)  # 1800 audits; about six calls for each of them before


def test_sources_and_sinks(spark, sf, tmp_path):
    pages = derived(spark, sf, "pages_raw")
    src.append_log(table(spark, sf, "events"), str(tmp_path / "log"), "ts")
    src.append_log(table(spark, sf, "events"), str(tmp_path / "log"), "ts")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2 * table(spark, sf, "events").count()
    pages.write.json(str(tmp_path / "json"))
    assert src.read_snapshots(spark, str(tmp_path / "json"), "json").count() == pages.count()
    folder = tmp_path / "html"
    folder.mkdir()
    (folder / "a.html").write_text("<title>Hi</title>")
    got = page_facts(src.read_html_files(spark, str(folder), "https://e.org/")).select("url", "title").first()
    assert tuple(got) == ("https://e.org/a.html", "Hi")
    for sub in ("x", "y/z"):
        (folder / sub).mkdir(parents=True)
        (folder / sub / "index.html").write_text("<title>In</title>")
    found = {r["url"] for r in src.read_html_files(spark, str(folder), "https://e.org/").collect()}
    assert found == {"https://e.org/a.html", "https://e.org/x/index.html", "https://e.org/y/z/index.html"}
    report = '{"metadata":{"domain":"e.org","pages_crawled":2},"summary":{"total_images":3},"insights":{"critical":["c"]},"pages":[{"url":"u1"},{"url":"u2"}]}'
    (tmp_path / "r.json").write_text(report)
    rows = src.load_report(spark, str(tmp_path / "r.json")).select("page.url", "summary.total_images").collect()
    assert sorted(map(tuple, rows)) == [("u1", 3), ("u2", 3)]


def test_page_dumps_round_trip(spark, tmp_path):
    """Raw pages with the format's own signs, line ends, nulls and long bodies come back as they were, in batch and stream."""
    bodies = ["<p>a</p>\n\r\n", "", None, "\x1e", "\x1b", "\x1b1\x1b0\x1e\x1b\x1e1", "é日本 \u2028 \x00", "x" * 300_000 + "\n" + "\x1e" * 50]
    rows = [(i, "e.org", f"https://e.org/{i}\x1e\n?", b, 200, 1, None if i % 2 else 0.25, "gone" if b is None else None) for i, b in enumerate(bodies)]
    pages = spark.createDataFrame(rows, PAGE)
    src.write_page_dumps(pages.where("page_id < 4").repartition(2), str(tmp_path / "d"), pages_per_file=2)
    src.write_page_dumps(pages.where("page_id >= 4").coalesce(1), str(tmp_path / "d"))
    columns = pages.columns
    order = lambda frame: sorted(map(tuple, frame.select(*columns).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # pages longer than a split
    try:
        assert order(src.read_page_dumps(spark, str(tmp_path / "d"))) == sorted(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert order(src.read_page_dumps(spark, str(tmp_path / "d"), [rows[5][2], "other"])) == [rows[5]]
    got = drain(src.read_page_dumps(spark, str(tmp_path / "d"), stream=True, files_per_batch=1), "append", "dumps", spark)
    assert order(got) == sorted(rows)
