"""Keyed processors with state variables and timers, for ``transformWithStateInPandas``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# States after which a job sends nothing more.
TERMINAL = ["completed", "failed"]


class SharedOpenings(StatefulProcessor):
    """Pages of a (site, opening) that another page has too; the first one is told when the second comes.

    State is one page and whether it has been told, however many pages share the opening.
    """

    SCHEMA = "site string, page_id long"

    def __init__(self, keep_ms: int | None = None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "page_id long, told boolean", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, told = self.first.get() if self.first.exists() else (None, False)
        for some in rows:
            pages = some["page_id"].drop_duplicates()
            if first is None:
                first = int(pages.iloc[0])
            others = pages[pages != first]
            if len(others):
                found = others if told else pd.concat([pd.Series([first]), others])
                told = True
                yield pd.DataFrame({"site": key[0], "page_id": found.astype("int64")})
        self.first.update((first, told))

    def close(self) -> None:
        pass


class Progress(StatefulProcessor):
    """The newest state of a job; a finished one stays finished.

    A timer drops the state ``keep_ms`` after the job's last row, or after the watermark if that is later.
    """

    SCHEMA = "job_id long, at long, status string, progress double, terminal boolean"

    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "at long, status string, progress double, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        *before, due = self.best.get() if self.best.exists() else (None, None, None, None)
        rank = lambda s: (s[1] in TERMINAL, *s)
        best = None if before[0] is None else tuple(before)
        for some in rows:
            for seen in zip(some["at"].astype("int64").tolist(), some["status"].astype(str).tolist(), some["progress"].astype(float).tolist()):
                if best is None or (rank(seen)[0], seen[0], seen[1], seen[2]) > (rank(best)[0], *best):
                    best = seen
        if best == tuple(before):
            return
        if self.keep_ms is not None:
            if due is not None:
                self.handle.deleteTimer(due)
            due = max(best[0] // 1000, timerValues.getCurrentWatermarkInMs()) + self.keep_ms
            self.handle.registerTimer(due)
        self.best.update((*best, due))
        yield pd.DataFrame(
            {"job_id": [key[0]], "at": [best[0]], "status": [best[1]], "progress": [best[2]], "terminal": [best[1] in TERMINAL]}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.best.clear()
        yield pd.DataFrame({"job_id": [], "at": [], "status": [], "progress": [], "terminal": []}).astype(
            {"job_id": "int64", "at": "int64", "status": "object", "progress": "float64", "terminal": "bool"}
        )

    def close(self) -> None:
        pass


class Alerts(StatefulProcessor):
    """Each audit of a site against the one before it in time, once no earlier one can come.

    Audits wait in sorted chunks of at most ``CHUNK``, in a map by the time of their first one. A site has
    one timer, for the earliest that waits. It takes out the chunks that have begun and merges them in the order
    of their times; of the last ones, what is not due goes back. So a batch reads and writes what it brings, what is
    due and the chunks cut by the watermark, in a few calls a site, not some for each audit.
    """

    SCHEMA = "site string, at long, alert string, amount long"
    CHUNK = 4096

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.site = handle.getValueState("site", "score long, broken long, due long, chunks long")
        self.waiting = handle.getMapState("waiting", "first long, number long", "at array<long>, score array<long>, broken array<long>")

    def _wait(self, rows: np.ndarray, chunks: int) -> int:
        """Store sorted rows; the number of the next chunk."""
        for i in range(0, len(rows), self.CHUNK):
            some = rows[i : i + self.CHUNK]
            self.waiting.updateValue((int(some[0, 0]), chunks), tuple(some[:, j].tolist() for j in range(3)))
            chunks += 1
        return chunks

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        score, broken, due, chunks = self.site.get() or (None, None, None, 0)
        first = None
        for some in rows:
            new = _in_time(some[["at", "seo_score", "broken_links"]].to_numpy("int64"))
            first = int(new[0, 0]) // 1000 if first is None else min(first, int(new[0, 0]) // 1000)
            chunks = self._wait(new, chunks)
        if first is not None and (due is None or first < due):
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(first)
            due = first
        self.site.update((score, broken, due, chunks))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        score, broken, _, chunks = self.site.get()
        end = 1000 * max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)
        keys = sorted(tuple(k) for k in self.waiting.keys())
        begun = [k for k in keys if k[0] < end]
        last = None if score is None else (score, broken)
        rows = np.empty((0, 3), dtype=np.int64)
        for i, there in enumerate(begun):
            chunk = np.array(self.waiting.getValue(there), dtype=np.int64).T
            self.waiting.removeKey(there)
            rows = _in_time(np.concatenate([rows, chunk]))
            known = int(np.searchsorted(rows[:, 0], begun[i + 1][0] if i + 1 < len(begun) else end))
            if known:
                found = _alerts(key[0], last, rows[:known])
                last, rows = (int(rows[known - 1, 1]), int(rows[known - 1, 2])), rows[known:]
                if len(found):
                    yield found
        chunks = self._wait(rows, chunks)
        nexts = [int(rows[0, 0])] if len(rows) else []
        nexts += [k[0] for k in keys[len(begun) :][:1]]
        due = min(nexts) // 1000 if nexts else None
        if due is not None:
            self.handle.registerTimer(due)
        self.site.update((*(last or (None, None)), due, chunks))

    def close(self) -> None:
        pass


def _in_time(rows: np.ndarray) -> np.ndarray:
    """Rows of (at, score, broken) in this order."""
    return rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]


def _alerts(site: str | None, last: tuple[int, int] | None, rows: np.ndarray) -> pd.DataFrame:
    """Alerts of audits in the order of their times; ``last`` has the figures of the audit before them."""
    before = np.concatenate([rows[:1, 1:] if last is None else np.array([last]), rows[:-1, 1:]])
    changes = np.stack([before[:, 0] - rows[:, 1], rows[:, 2] - before[:, 1]], axis=1)
    row, kind = np.nonzero(changes > 0)
    names = np.array(["score_drop", "new_broken_links"], dtype=object)
    return pd.DataFrame({"site": [site] * len(row), "at": rows[row, 0], "alert": names[kind], "amount": changes[row, kind]})
