"""Alarms from keyed state: the changes of every alarm as metric points stream by.

A series (alarm and dimension) keeps the breaches of its last N periods and its
state, nothing else: a period without a point is no breach, so points that do not
breach are dropped before the state is asked. When an alarm goes on, the moment it
would go off without further breaches is known, and an event-time timer at the end
of that period puts it back to OK though nothing arrives. No history is read again.

Points are final values of their periods (windows in append mode); their event
time is ``closed_at``, the end of the period. Every point moves the clock, so the
watermark is taken before points without a rule or a breach are dropped. A point of
a period that its series has passed is a ``late`` row and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from docketry.operators import metrics
from docketry.shipping import ship_with_tasks
from docketry.sources import sinks

ship_with_tasks(__name__)

POINTS = "metric string, dim string, period_start timestamp, closed_at timestamp, value double"
CHANGES = "alarm string, dim string, period_us bigint, state string, previous_state string"
_STATE = "alarm_on boolean, recent array<bigint>, last bigint"
_OUT = Row(*[f.split()[0] for f in CHANGES.split(", ")])


class AlarmSeries(StatefulProcessor):
    """M breaches in N periods; ``recent`` holds the numbers of the breaching periods, oldest first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getValueState("series", _STATE)
        self._rule = handle.getValueState("rule", "period_us bigint, datapoints int, evaluation_periods int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self._held.get()
        on, recent, last = (held[0], list(held[1]), held[2]) if held is not None else (False, [], None)
        before = self._off_at(recent) if on else None
        for row in sorted(rows, key=lambda r: r.period_us):
            step, m, n = row.period, row.datapoints, row.evaluation_periods
            self._step, self._m, self._n = step, m, n
            at = row.period_us // step
            if last is not None and at <= last:
                yield _OUT(*key, row.period_us, "late", None)
                continue
            if on and (off := recent[-m] + n) < at:
                on = False
                yield _OUT(*key, off * step, "OK", "ALARM")
            recent = [p for p in recent if p > at - n] + [at]
            last = at
            if not on and len(recent) >= m:
                on = True
                yield _OUT(*key, at * step, "ALARM", "OK")
            elif on and len(recent) < m:
                on = False
                yield _OUT(*key, at * step, "OK", "ALARM")
        self._held.update((on, recent, last))
        self._rule.update((self._step, self._m, self._n))
        after = self._off_at(recent) if on else None
        if after != before:
            if before is not None:
                self._handle.deleteTimer(before)
            if after is not None:
                self._handle.registerTimer(after)

    def _off_at(self, recent: list[int]) -> int:
        """When the period ends in which too few breaches are left, in ms."""
        step, m, n = self._rule.get() if self._rule.exists() else (self._step, self._m, self._n)
        return -(-((recent[-m] + n + 1) * step) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        on, recent, last = self._held.get()
        if on and self._off_at(list(recent)) == expiredTimerInfo.getExpiryTimeInMs():
            step, m, n = self._rule.get()
            off = recent[-m] + n
            self._held.update((False, list(recent), max(last, off)))
            yield _OUT(*key, off * step, "OK", "ALARM")

    def close(self) -> None:
        pass


def alarm_changes(points: DataFrame) -> DataFrame:
    """A stream of final ``POINTS`` to the changes of every alarm: ``alarm, dim, period_start, state, previous_state``.

    ``dim`` is empty for metrics without one. Needs the RocksDB state store.
    """
    rules = F.broadcast(metrics.alarms_table(points.sparkSession))  # nine rows
    timed = points.withWatermark("closed_at", "0 seconds").join(rules, "metric")
    breaching = timed.where("value >= threshold").select(
        "alarm", F.coalesce("dim", F.lit("")).alias("dim"), F.unix_micros("period_start").alias("period_us"),
        (F.col("period") * F.lit(1_000_000).cast("long")).alias("period"), "datapoints", "evaluation_periods", "closed_at",
    )
    out = breaching.groupBy("alarm", "dim").transformWithState(
        statefulProcessor=AlarmSeries(), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime"
    )
    return out.select("alarm", "dim", F.timestamp_micros("period_us").alias("period_start"), "state", "previous_state")


def start_alarm_changes(points: DataFrame, out: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Changes below ``out/alarm_changes``, one folder per batch."""
    writer = (
        alarm_changes(points).writeStream.outputMode("append")
        .foreachBatch(lambda batch, number: sinks.write_batch(batch, out, "alarm_changes", number))
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
