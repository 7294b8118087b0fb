"""Keyed streaming state machine of a job: claim, lease, release, finalization."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docketry.shipping import ship_with_tasks

ship_with_tasks(__name__)

STATE = "status string, attempts bigint, lease_us bigint, changed_us bigint"
OUTCOME = (
    "job_id string, event_id bigint, us bigint, outcome string, status string, "
    "attempts bigint, lease_us bigint"
)
_NONE = -1
_ENDED = ("succeeded", "failed", "dead")


def step(state: tuple, us: int, result: str, lease_us: int) -> tuple[tuple, str]:
    """Next state and outcome of one delivery."""
    status, attempts, lease, changed = state
    if status in _ENDED:
        return state, "effect_already_applied"
    if us < changed:
        return state, "rejected_late"
    if status == "processing" and lease > us:
        return state, "processing_already_active"
    if result == "complete":
        return ("succeeded", attempts + 1, _NONE, us), "processed"
    if result == "fail":
        return ("failed", attempts + 1, _NONE, us), "terminal_failure_recorded"
    if result == "release":
        return ("pending_upload", attempts + 1, _NONE, us), "released"
    return ("processing", attempts + 1, us + lease_us, us), "claim_kept"


class JobStateMachine(StatefulProcessor):
    """One small state row per job; deliveries of a trigger run in time order."""

    def __init__(self, lease_seconds: int) -> None:
        self._lease_us = lease_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._job = handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self._job.get() if self._job.exists() else ("pending_upload", 0, _NONE, _NONE)
        state = tuple(state)
        # the trigger size bounds what one key can hold here
        batch = pd.concat(list(rows)).sort_values(["us", "event_id"])
        out = []
        for event_id, us, result in zip(batch["event_id"], batch["us"], batch["result"]):
            state, outcome = step(state, int(us), result, self._lease_us)
            out.append((key[0], int(event_id), int(us), outcome, state[0], state[1], state[2]))
        self._job.update(state)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOME.split(", ")])

    def close(self) -> None:
        pass


def run_state_machine(deliveries: DataFrame, *, lease_seconds: int) -> DataFrame:
    """Outcome of every delivery ``(job_id, event_id, ts, result)`` of a stream.

    Needs the RocksDB state store: ``use_rocksdb(spark)``.
    """
    slim = deliveries.select("job_id", "event_id", F.unix_micros("ts").alias("us"), "result")
    return slim.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=JobStateMachine(lease_seconds),
        outputStructType=OUTCOME,
        outputMode="Append",
        timeMode="None",
    )


def use_rocksdb(spark) -> None:
    """Keyed state in RocksDB; a batch stores what it changed, not a copy of each store."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
