"""Progress of streaming queries: a listener that passes on what batches report, throttled, and keeps the last lines of a log."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent

from fathomry.streaming.live import Throttle, progress_rates


class LogRing:
    """The last ``size`` lines; older ones go. Lines are added by Spark's listener thread and read by others."""

    def __init__(self, size: int = 500):
        self.rows, self.lock, self.dropped = deque(maxlen=size), threading.Lock(), 0

    def add(self, level: str, text: str) -> None:
        with self.lock:
            self.dropped += len(self.rows) == self.rows.maxlen
            self.rows.append((level, text))

    def lines(self, level: str | None = None) -> list[tuple[str, str]]:
        with self.lock:
            return [r for r in self.rows if level is None or r[0] == level]


class ProgressListener(StreamingQueryListener):
    """Calls ``report`` with the batches, rows and rate of each query so far, at most every ``millis``; the last state of a query
    is reported when it ends. ``total`` rows, if known, give the seconds left.

    Register with ``spark.streams.addListener``. A batch that is repeated after a failure counts once.
    """

    def __init__(self, report: Callable[[dict], None], millis: int = 100, log: LogRing | None = None, total: int | None = None):
        self.report, self.millis, self.log, self.total = report, millis, log or LogRing(), total
        self.seen: dict[str, dict] = {}
        self.throttles: dict[str, Throttle] = {}

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802
        run = str(event.runId)
        self.throttles[run] = Throttle(self.report, self.millis)
        self.seen[run] = {"query": str(event.id), "name": event.name, "batch": -1, "batches": 0, "rows": 0, "seconds": 0.0, "rate": 0.0, "left": None, "state": "running"}
        self.log.add("info", f"query {event.name or event.id} started")

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        p = event.progress
        now = self.seen.get(str(p.runId))
        if now is None or p.batchId <= now["batch"]:
            return
        now["batch"], now["batches"] = p.batchId, now["batches"] + 1
        now["rows"] += p.numInputRows
        now["seconds"] += p.durationMs.get("triggerExecution", 0) / 1000
        now["rate"], now["left"] = progress_rates(now["rows"], self.total, now["seconds"]) if self.total else (progress_rates(now["rows"], now["rows"], now["seconds"])[0], None)
        self.log.add("info", f"batch {p.batchId}: {p.numInputRows} rows")
        self.throttles[str(p.runId)](dict(now))

    def onQueryIdle(self, event: QueryIdleEvent) -> None:  # noqa: N802
        self.log.add("debug", f"query {event.id} waits")

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        run = str(event.runId)
        now = self.seen.pop(run, None)
        if now is None:
            return
        now["state"] = "failed" if event.exception else "ended"
        if event.exception:
            self.log.add("error", event.exception.splitlines()[0])
        self.log.add("info", f"query {now['name'] or now['query']} {now['state']}")
        self.throttles.pop(run)(dict(now), final=True)
