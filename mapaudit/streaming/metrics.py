"""Run counters: rows sent and failed, throughput, success rate."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from mapaudit.sources.messages import to_messages


@dataclass(frozen=True)
class RunMetrics:
    sent: int
    acked: int
    failed: int
    seconds: float
    rejected: int = 0  # rows that never became a message

    @property
    def pending(self) -> int:
        return self.sent - self.acked - self.failed

    @property
    def throughput(self) -> float | None:
        return self.acked / self.seconds if self.seconds > 0 else None

    @property
    def success_rate_pct(self) -> float | None:
        """Null rather than a division by zero when nothing was sent."""
        return 100.0 * self.acked / self.sent if self.sent else None


def send_batch(rows: DataFrame, target: dict[str, str], fmt: str = "kafka") -> RunMetrics:
    """Writes messages and counts them on the way: the counters ride on the write job.

    ``rows`` carry ``reject_reason``; rejected rows are counted apart and not sent. The job
    writes all messages or fails, so what was sent is acknowledged.
    """
    seen = Observation("send")
    ok = F.col("reject_reason").isNull()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("all"), F.count(F.when(ok, 1)).alias("ok"))
    started = time.monotonic()
    to_messages(counted.where(ok)).drop("message").write.format(fmt).options(**target).mode("append").save()
    total, good = seen.get["all"], seen.get["ok"]
    return RunMetrics(good, good, 0, time.monotonic() - started, total - good)


class StreamCounter(StreamingQueryListener):
    """Counts every micro-batch of the session's queries from when it is added:
    ``spark.streams.addListener(counter)`` before the query starts. Nothing ages out."""

    def __init__(self) -> None:
        self._sums: dict[str, list[float]] = {}
        self._ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self._sums[str(event.runId)] = [0, 0, 0]

    def onQueryProgress(self, event) -> None:
        p = event.progress
        sums = self._sums.setdefault(str(p.runId), [0, 0, 0])
        seen = p.observedMetrics.get("csv_rows")
        sums[0] += seen["rows"] if seen else p.numInputRows
        sums[1] += seen["rejected"] if seen else 0
        sums[2] += (p.durationMs or {}).get("triggerExecution", 0) / 1000.0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended.add(str(event.runId))

    def metrics(self, query: StreamingQuery, wait_seconds: float = 30.0) -> RunMetrics:
        """Counters of the query's whole run; of an ended one after its last event has arrived."""
        run, until = str(query.runId), time.monotonic() + wait_seconds
        while not query.isActive and run not in self._ended and time.monotonic() < until:
            time.sleep(0.05)
        rows, rejected, seconds = self._sums.get(run, [0, 0, 0])
        sent = int(rows - rejected)
        return RunMetrics(sent, sent, 0, seconds, int(rejected))
