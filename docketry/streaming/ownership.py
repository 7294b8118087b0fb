"""Claims and finalizations as events of their own, checked against the owner in keyed state.

A job's state holds its active attempt. A claim takes a pending job, or one whose
lease is over; only the attempt that holds the job may complete, fail or release
it. What is refused keeps its row: it is tagged (``side``) as late (older than the
last change of the job), as stale (not by the owner) or as not needed. When a lease
ends before its owner has answered, an event-time timer says so (``expired``).

Event time is ``arrived``, when a row reached the stream, so the watermark drops
nothing; an event that is old when it arrives is judged against the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from docketry import schemas as S
from docketry.operators import jobs as J, outcomes as R
from docketry.shipping import ship_with_tasks
from docketry.sources import sinks
from docketry.streaming.buckets import BUCKETS, run_in_buckets

ship_with_tasks(__name__)

CLAIM, COMPLETE, FAIL, RELEASE = "claim", "complete", "fail", "release"
TAKEN_OVER, RELEASED, STALE, LATE, EXPIRED = "claim_taken_over", "released", "stale_attempt", "rejected_late", "lease_expired"

OUTCOMES = (
    "job_id string, attempt_id string, kind string, us bigint, outcome string, status string, attempts int, "
    "active_attempt_id string, lease_us bigint"
)
_STATE = "status string, attempts int, attempt_id string, lease_us bigint, changed_us bigint"
_OUT = Row(*[f.split()[0] for f in OUTCOMES.split(", ")])
_SIDES = {LATE: "late", STALE: "stale", EXPIRED: "expired", J.ALREADY_ACTIVE: "not_needed", J.ALREADY_APPLIED: "not_needed"}


class Job(NamedTuple):
    status: str = S.PENDING
    attempts: int = 0
    attempt_id: str | None = None
    lease_us: int | None = None
    changed_us: int | None = None


def decide(job: Job, kind: str, attempt: str, us: int, lease_us: int) -> tuple[Job, str]:
    """State and outcome after one claim or finalization."""
    late = job.changed_us is not None and us < job.changed_us
    if kind == CLAIM:
        if job.status in S.TERMINAL_STATUSES:
            return job, J.ALREADY_APPLIED
        if late:
            return job, LATE
        if job.status == S.PROCESSING and job.lease_us > us:
            return job, J.ALREADY_ACTIVE
        taken = Job(S.PROCESSING, job.attempts + 1, attempt, us + lease_us, us)
        return taken, TAKEN_OVER if job.status == S.PROCESSING else J.CLAIM_ACQUIRED
    if job.status != S.PROCESSING or job.attempt_id != attempt:
        return job, STALE
    if late:
        return job, LATE
    status, outcome = {
        COMPLETE: (S.SUCCEEDED, R.PROCESSED),
        FAIL: (S.FAILED, R.TERMINAL_FAILURE),
        RELEASE: (S.PENDING, RELEASED),
    }[kind]
    return Job(status, job.attempts, None, None, us), outcome


class OwnedJob(StatefulProcessor):
    """One small state row per job; the events of a trigger run in the order of their own time."""

    def __init__(self, lease_seconds: int) -> None:
        self._lease_us = lease_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._job = handle.getValueState("job", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self._job.get()
        before = job = Job(*held) if held is not None else Job()
        for row in sorted(rows, key=lambda r: (r.us, r.kind != CLAIM, r.attempt_id)):
            job, outcome = decide(job, row.kind, row.attempt_id, row.us, self._lease_us)
            yield _OUT(key[0], row.attempt_id, row.kind, row.us, outcome, job.status, job.attempts, job.attempt_id, job.lease_us)
        if job != before:
            self._job.update(tuple(job))
        if job.lease_us != before.lease_us:
            if before.lease_us is not None:
                self._handle.deleteTimer(-(-before.lease_us // 1000))
            if job.lease_us is not None:
                self._handle.registerTimer(-(-job.lease_us // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._job.get()
        job = Job(*held) if held is not None else Job()
        if job.lease_us is not None and -(-job.lease_us // 1000) == expiredTimerInfo.getExpiryTimeInMs():
            yield _OUT(key[0], job.attempt_id, "lease", job.lease_us, EXPIRED, job.status, job.attempts, job.attempt_id, job.lease_us)

    def close(self) -> None:
        pass


def owned_jobs(events: DataFrame, *, lease_seconds: int, buckets: int = BUCKETS) -> DataFrame:
    """A stream of ``job_id, attempt_id, kind, ts, arrived`` to the outcome of every event, with its ``side``.

    Unknown kinds and rows without job or attempt have the side ``malformed``
    upstream (``malformed_events``) and are left out here. Needs RocksDB. ``buckets``
    stays as it is over the life of a checkpoint.
    """
    known = events.withWatermark("arrived", "0 seconds").where(_well_formed()).select(
        "job_id", "attempt_id", "kind", F.unix_micros("ts").alias("us"), "arrived"
    )
    out = run_in_buckets(known, OwnedJob(lease_seconds), key="job_id", state=_STATE, outcomes=OUTCOMES, buckets=buckets)
    side = F.lit("applied")
    for outcome, name in _SIDES.items():
        side = F.when(F.col("outcome") == outcome, name).otherwise(side)
    return out.withColumn("side", side)


def _well_formed():
    known = F.col("kind").isin(CLAIM, COMPLETE, FAIL, RELEASE)
    whole = F.col("job_id").isNotNull() & F.col("attempt_id").isNotNull() & F.col("ts").isNotNull() & F.col("arrived").isNotNull()
    return F.coalesce(known & whole, F.lit(False))


def malformed_events(events: DataFrame) -> DataFrame:
    """The rows that ``owned_jobs`` leaves out."""
    return events.where(~_well_formed())


def start_owned_jobs(events: DataFrame, out: str, checkpoint: str, *, lease_seconds: int, available_now: bool = True) -> StreamingQuery:
    """Outcomes below ``out/outcomes``, one folder per batch and side."""

    def write(batch: DataFrame, number: int) -> None:
        sinks.write_batch(batch, out, "outcomes", number, ["side"])

    writer = (
        owned_jobs(events, lease_seconds=lease_seconds).writeStream.outputMode("append")
        .foreachBatch(write).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
