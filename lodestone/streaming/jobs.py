"""Ingestion jobs as a stateful stream (M3): queued, parsing, parsed or failed, a row for each step, bounded attempts.

Events are submissions of documents and results of attempts. A document's state is one row: its status, how many attempts it had and
when the one that runs began. Each event, and each attempt that says nothing for ``patience``, gives one row:

* a submission of a new or failed document queues it; of one that is parsed, it is reused; of one that is under way, it is joined;
* a result ``ok`` makes it parsed; any other is an error, after which the document is tried again until ``max_attempts``, then failed;
* an attempt that isn't over by its start and ``patience`` counts as an error named ``Timeout``: before the next event of its document,
  or when the watermark passes that time.

State is kept by Spark's state store in the checkpoint folder, by RocksDB, so that it may be larger than memory; a stream that is
started again goes on where it stopped. Timers and rows follow event time, so a rerun over the same files gives the same rows.

Defined results: events of one document are taken in order of their time, then of kind and result; results without a job that is under
way, and events with a null hash or time, are left out; of a null result the error is empty.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "content_hash string, kind string, result string, at timestamp"
STEPS = "content_hash string, step string, status string, attempt int, reused boolean, error string, at timestamp"
STATE = "status string, attempt int, due long"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Jobs(StatefulProcessor):
    def __init__(self, max_attempts: int, patience_ms: int):
        self.max_attempts, self.patience_ms = max_attempts, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE)

    def close(self) -> None:
        pass

    def _begin(self, attempt: int, at_ms: int) -> None:
        due = at_ms + self.patience_ms
        self.state.update(("parsing", attempt, due))
        self.handle.registerTimer(due)

    def _ended(self, key: str, attempt: int, error: str, at, at_ms: int) -> Row:
        """After an error: the next attempt, or the end."""
        if attempt >= self.max_attempts:
            self.state.update(("failed", attempt, 0))
            return Row(content_hash=key, step="result", status="failed", attempt=attempt, reused=False, error=error, at=at)
        self._begin(attempt + 1, at_ms)
        return Row(content_hash=key, step="result", status="parsing", attempt=attempt, reused=False, error=error, at=at)

    def _overdue(self, key: str, upto_ms: int, fired: int | None = None) -> Iterator[Row]:
        """Ends the attempts whose time was up by ``upto_ms``, one after the other."""
        while self.state.exists() and (now := self.state.get())[0] == "parsing" and now[2] <= upto_ms:
            if now[2] != fired:
                self.handle.deleteTimer(now[2])
            yield self._ended(key, now[1], "Timeout", datetime.datetime.fromtimestamp(now[2] / 1000), now[2])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        key = key[0]
        for e in sorted(rows, key=lambda r: (r.at, 0 if r.kind == "submitted" else 1, r.result or "")):
            at_ms = int(e.at.timestamp() * 1000)
            # an attempt is over by its own time, whether or not the watermark has come that far: batches may be cut anywhere
            yield from self._overdue(key, at_ms)
            now = self.state.get() if self.state.exists() else None
            status, attempt = (now[0], now[1]) if now else (None, 0)
            if e.kind == "submitted":
                fresh = status in (None, "failed")
                if fresh:
                    self._begin(1, at_ms)
                yield Row(content_hash=key, step="submitted", status="queued" if fresh else status, attempt=0 if fresh else attempt, reused=status == "parsed", error=None, at=e.at)
            elif status == "parsing":
                self.handle.deleteTimer(now[2])
                if e.result == "ok":
                    self.state.update(("parsed", attempt, 0))
                    yield Row(content_hash=key, step="result", status="parsed", attempt=attempt, reused=False, error=None, at=e.at)
                else:
                    yield self._ended(key, attempt, e.result or "", e.at, at_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._overdue(key[0], timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())


def event_stream(spark: SparkSession, path: str, late: str = "0 seconds", files: int = 1) -> DataFrame:
    """JSON files of events as they arrive, ``files`` a batch."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).json(path).where("content_hash IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)


def job_steps(events: DataFrame, max_attempts: int = 3, patience_seconds: int = 600) -> DataFrame:
    """The steps of all jobs. The session's state store is to be RocksDB (``with_rocks``)."""
    return events.groupBy("content_hash").transformWithState(_Jobs(max_attempts, patience_seconds * 1000), STEPS, "Append", "EventTime")


def with_rocks(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store that such streams need; the caller's settings stay."""
    own = spark.newSession()
    own.conf.set(STORE, ROCKS)
    return own
