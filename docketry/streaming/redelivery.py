"""Redelivery after the visibility wait: a delay queue in keyed state with event-time timers.

A message that is sent is delivered at once and hidden for the wait of its level.
Handled in time and well, it is acknowledged and forgotten. Otherwise its timer
delivers it again; after the receives of its level it moves to the next level
(work queue, then dead-letter queue), and behind the last one to quarantine. State
is a few numbers per message that is not settled, held in hash buckets of messages.

The stream reads two kinds of rows, ``sent`` and ``handled``, and ticks that move
the clock when nothing else arrives. Event time is ``clock``, when a row reached
the stream, not when it happened, so no row is late for the watermark and none is
dropped; what comes too late for its message is an outcome of its own (``stale``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from docketry.config import IntakeConfig
from docketry.functions import times as TM
from docketry.operators import outcomes as R
from docketry.plans import pipeline as P
from docketry.shipping import ship_with_tasks
from docketry.sources import sinks
from docketry.sources.job_store import JobStore
from docketry.streaming.buckets import BUCKETS, run_in_buckets
from docketry.streaming.state import use_rocksdb

ship_with_tasks(__name__)

WORK, DEAD_LETTER, QUARANTINE = "work", "dead_letter", "quarantine"

EVENTS = "kind string, message_id string, level string, receive_count int, ok boolean, ts timestamp, clock timestamp"
OUTCOMES = "message_id string, kind string, level string, receive_count int, us bigint"
_OUT = Row("message_id", "kind", "level", "receive_count", "us")
_STATE = "level int, receives int, visible_us bigint"


@dataclass(frozen=True)
class Level:
    name: str
    max_receives: int
    wait_seconds: int


def levels(config: IntakeConfig = IntakeConfig()) -> tuple[Level, ...]:
    """The work queue and its dead-letter queue; behind them is quarantine."""
    return (
        Level(WORK, config.max_receives, config.visibility_seconds),
        Level(DEAD_LETTER, config.max_receives, config.dead_letter_visibility_seconds),
    )


class DelayQueue(StatefulProcessor):
    """Deliveries, retries and the last word on every message.

    Kinds of outcome: ``delivery`` (receive it now), ``retry`` (handled without
    success; ``us`` is when it can be received again), ``acknowledged``,
    ``quarantine``, ``stale`` (an answer to a delivery that is over), ``duplicate``
    (sent while the message is not settled).
    """

    def __init__(self, queue: tuple[Level, ...]) -> None:
        self._levels = queue

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._pending = handle.getValueState("pending", _STATE)

    def _hide(self, level: int, receives: int, at_us: int) -> int:
        """The message is being handled; when it becomes visible again."""
        visible = at_us + self._levels[level].wait_seconds * 1_000_000
        self._pending.update((level, receives, visible))
        self._handle.registerTimer(-(-visible // 1000))
        return visible

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        message, state = key[0], self._pending.get()
        order = {"sent": 0, "handled": 1}
        for row in sorted((r for r in rows if r.kind in order), key=lambda r: (order[r.kind], r.us, r.receive_count or 0)):
            if row.kind == "sent":
                if state is not None:
                    yield self._row(message, "duplicate", state[0], state[1], row.us)
                    continue
                yield self._row(message, "delivery", 0, 1, row.us)
                state = (0, 1, self._hide(0, 1, row.us))
                continue
            if state is None or (row.level, row.receive_count) != (self._levels[state[0]].name, state[1]) or row.us >= state[2]:
                yield _OUT(message, "stale", row.level, row.receive_count, row.us)
            elif row.ok:
                yield self._row(message, "acknowledged", state[0], state[1], row.us)
                self._handle.deleteTimer(-(-state[2] // 1000))
                self._pending.clear()
                state = None
            else:
                yield self._row(message, "retry", state[0], state[1], state[2])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self._pending.get()
        if state is None or -(-state[2] // 1000) != expiredTimerInfo.getExpiryTimeInMs():
            return
        level, receives, at = state
        receives += 1
        if receives > self._levels[level].max_receives:
            level, receives = level + 1, 1
        if level == len(self._levels):
            yield _OUT(key[0], QUARANTINE, QUARANTINE, 0, at)
            self._pending.clear()
            return
        # nobody received it while the clock stood still: a delivery has its whole wait before it
        now = timerValues.getCurrentWatermarkInMs() * 1000
        if at + self._levels[level].wait_seconds * 1_000_000 <= now:
            at = now
        yield self._row(key[0], "delivery", level, receives, at)
        self._hide(level, receives, at)

    def _row(self, message: str, kind: str, level: int, receives: int, us: int) -> Row:
        return _OUT(message, kind, self._levels[level].name, receives, us)

    def close(self) -> None:
        pass


def delay_queue(events: DataFrame, config: IntakeConfig = IntakeConfig(), *, buckets: int = BUCKETS) -> DataFrame:
    """A stream of ``EVENTS`` to a stream of outcomes ``message_id, kind, level, receive_count, at``.

    Rows without a message id can not be answered and are left out. Needs the
    RocksDB state store. ``buckets`` stays as it is over the life of a checkpoint.
    """
    # ticks have no time of their own
    us = F.when(F.col("kind").isin("sent", "handled"), F.unix_micros("ts")).otherwise(0)
    known = events.withWatermark("clock", "0 seconds").where("message_id is not null").select(
        "message_id", "kind", "level", "receive_count", "ok", us.alias("us"), "clock"
    )
    out = run_in_buckets(known, DelayQueue(levels(config)), key="message_id", state=_STATE, outcomes=OUTCOMES, buckets=buckets)
    return out.select("message_id", "kind", "level", "receive_count", F.timestamp_micros("us").alias("at"))


def start_delay_queue(
    spark: SparkSession, folder: str, config: IntakeConfig = IntakeConfig(), *, available_now: bool = True
) -> StreamingQuery:
    """The delay queue over ``folder/events``; a batch owns its part of ``folder/outcomes``."""
    use_rocksdb(spark)
    events = spark.readStream.schema(EVENTS).parquet(f"{folder}/events")
    writer = (
        delay_queue(events, config).writeStream.outputMode("append")
        .foreachBatch(lambda batch, number: sinks.write_batch(batch, folder, "outcomes", number))
        .option("checkpointLocation", f"{folder}/checkpoint")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def sent_events(messages: DataFrame, clock) -> DataFrame:
    """Messages ``(message_id, sent_ts)`` as rows of the stream."""
    return _events(messages, "sent", F.col("sent_ts"), clock)


def handled_events(handled: DataFrame, clock) -> DataFrame:
    """Answers ``(message_id, level, receive_count, ok, ts)`` as rows of the stream."""
    return _events(handled, "handled", F.col("ts"), clock)


def tick(spark: SparkSession, clock) -> DataFrame:
    return _events(spark.range(1).select(F.lit("").alias("message_id")), "tick", F.lit(None), clock)


def _events(rows: DataFrame, kind: str, ts, clock) -> DataFrame:
    made = {"kind": F.lit(kind), "ts": ts, "clock": TM.as_timestamp(clock)}
    fields = [f.split(" ") for f in EVENTS.split(", ")]
    return rows.select(
        *[(made[n] if n in made else F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields]
    )


Handler = Callable[[DataFrame, object], DataFrame]


def redeliver(spark: SparkSession, messages: DataFrame, handle: Handler, folder: str, clocks: list, config: IntakeConfig = IntakeConfig()) -> DataFrame:
    """Close the loop: what is delivered by one clock is handled before the next.

    ``handle(deliveries, clock)`` answers deliveries ``(message_id, level,
    receive_count, at)`` with ``(message_id, level, receive_count, ok, ts)``. Every
    clock is one run of the stream from its checkpoint, so a run that is lost is
    taken up where it was. Returns all outcomes.
    """
    answers: DataFrame | None = None
    last = -1
    for n, clock in enumerate(clocks):
        parts = [tick(spark, clock)]
        if n == 0:
            parts.append(sent_events(messages, clock))
        if answers is not None:
            parts.append(handled_events(answers, clock))
        for part in parts:
            part.write.mode("append").parquet(f"{folder}/events")
        run = start_delay_queue(spark, folder, config)
        run.awaitTermination()
        outcomes = spark.read.parquet(f"{folder}/outcomes")
        new = outcomes.where((F.col("stream_batch") > last) & (F.col("kind") == "delivery")).drop("kind", "stream_batch")
        last = int(run.lastProgress["batchId"])
        answers = handle(new, clock)
    return spark.read.parquet(f"{folder}/outcomes").drop("stream_batch")


def pipeline_handler(
    messages: DataFrame, store: JobStore, objects: Callable[[SparkSession], DataFrame], config: IntakeConfig = IntakeConfig()
) -> Handler:
    """Deliveries through the jobs: uploads are processed, dead letters reconciled, and both publish their job rows.

    ``messages`` holds the bodies; a delivery brings its receive count and time.
    """

    def run(deliveries: DataFrame, clock) -> DataFrame:
        held = deliveries.join(messages.drop("receive_count", "sent_ts"), "message_id").withColumn("sent_ts", F.col("at"))
        answers = []
        for level in (WORK, DEAD_LETTER):
            batch = held.where(F.col("level") == level)
            if level == WORK:
                result = P.process_uploads(batch.drop("level", "at"), store.read(), objects(batch.sparkSession), as_of=clock, config=config)
            else:
                result = P.reconcile_dead_letters(batch.drop("level", "at"), store.read(), as_of=clock, config=config)
            if not result.changes.isEmpty():
                store.apply(result.changes)
            verdicts = result.messages.select(*R.MESSAGE_KEY, "failed")
            answers.append(
                batch.join(verdicts, R.MESSAGE_KEY).select(
                    "message_id", "level", "receive_count", (~F.col("failed")).alias("ok"), TM.as_timestamp(clock).alias("ts")
                )
            )
        return answers[0].unionByName(answers[1])

    return run
