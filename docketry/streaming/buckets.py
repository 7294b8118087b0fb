"""Many keys in one state row.

A processor for one key asks for its state and its timers one call at a time, each
a round trip between Python and the JVM, and its rows come back as a batch of their
own. Over millions of keys this costs far more than the work. ``InBuckets`` runs
such a processor for all keys of a hash bucket: what the bucket holds is read once,
the keys that have rows or are due are worked on in memory, and the bucket is stored
once, with one timer for the earliest of its keys.

Bounds: a task holds the keys of one bucket and what they receive in one trigger. A
bucket that is touched is stored whole, so the number of buckets weighs calls against
bytes: choose it for some hundreds of keys in each. It is part of the checkpoint
and must not change between runs.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo
from pyspark.sql.types import IntegralType, TimestampType

from docketry.shipping import ship_with_tasks

ship_with_tasks(__name__)

BUCKETS = 1 << 12


def run_in_buckets(rows: DataFrame, processor: StatefulProcessor, *, key: str, state: str, outcomes: str, buckets: int = BUCKETS) -> DataFrame:
    """``processor`` for every ``key`` of a stream with a watermark, by event time, to ``outcomes``.

    The processor holds one value of the fields ``state`` and at most one timer for a
    key; a key without a value has no timer. It gets the columns of ``rows`` but the
    timestamps, and yields tuples.
    """
    columns = [f.name for f in rows.schema if not isinstance(f.dataType, TimestampType)]
    whole = {f.name for f in rows.schema if isinstance(f.dataType, IntegralType)}
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    return rows.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=InBuckets(processor, key, state, outcomes, columns, whole),
        outputStructType=outcomes, outputMode="Append", timeMode="EventTime",
    )


class _OneKey:
    """State and timer of the key at work, with the calls of a handle and of a value state."""

    value: tuple | None = None
    timer: int | None = None

    def getValueState(self, name: str, schema: str) -> _OneKey:
        return self

    def exists(self) -> bool:
        return self.value is not None

    def get(self) -> tuple | None:
        return self.value

    def update(self, value: tuple) -> None:
        self.value = tuple(value)

    def clear(self) -> None:
        self.value = None

    def registerTimer(self, ms: int) -> None:
        self.timer = ms

    def deleteTimer(self, ms: int) -> None:
        if self.timer == ms:
            self.timer = None


class InBuckets(StatefulProcessor):
    """``processor`` for every key of a bucket; rows are told apart by their column ``key``."""

    def __init__(self, processor: StatefulProcessor, key: str, state: str, outcomes: str, columns: list[str], whole: set[str]) -> None:
        self._processor, self._key, self._columns, self._whole = processor, columns.index(key), columns, whole
        self._fields = [f.split() for f in state.split(", ")]
        self._outcomes = [f.split()[0] for f in outcomes.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ", ".join(f"{name} array<{kind}>" for name, kind in [("key", "string"), ("timer", "bigint"), *self._fields])
        self._handle, self._at, self._row = handle, _OneKey(), namedtuple("Received", self._columns)
        self._held = handle.getValueState("held", fields)
        self._processor.init(self._at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        keys, received, out = self._load(), {}, []
        before, first = dict(keys), _earliest(keys)
        for chunk in rows:
            for row in self._rows(chunk):
                received.setdefault(row[self._key], []).append(row)
        for one, own in received.items():
            self._at.timer, self._at.value = keys.get(one, (None, None))
            out.extend(self._processor.handleInputRows((one,), iter(own), timerValues))
            self._keep(keys, one)
        if keys != before:
            self._store(keys)
        due = _earliest(keys)
        if due != first:
            if first is not None:
                self._handle.deleteTimer(first)
            if due is not None:
                self._handle.registerTimer(due)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        keys, out = self._load(), []
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        over = [one for one, (timer, _) in keys.items() if timer is not None and timer <= until]
        for one in over:
            timer, self._at.value = keys[one]
            self._at.timer = None
            out.extend(self._processor.handleExpiredTimer((one,), timerValues, ExpiredTimerInfo(timer)))
            self._keep(keys, one)
        if over:
            self._store(keys)
        # Spark deletes the timer that fired
        due = _earliest(keys)
        if due is not None:
            self._handle.registerTimer(due)
        yield self._frame(out)

    def _rows(self, chunk: pd.DataFrame) -> Iterator[tuple]:
        """Rows with None for null and whole numbers as such: pandas makes floats of a column with nulls."""
        columns = []
        for name in self._columns:
            values = chunk[name].tolist()
            if chunk[name].hasnans:
                values = [None if x is None or x != x else x for x in values]
            if name in self._whole and chunk[name].dtype.kind == "f":
                values = [None if x is None else int(x) for x in values]
            columns.append(values)
        return map(self._row, *columns)

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=self._outcomes, dtype=object)

    def _load(self) -> dict[str, tuple[int | None, tuple]]:
        held = self._held.get()
        return {} if held is None else {one[0]: (one[1], one[2:]) for one in zip(*held)}

    def _keep(self, keys: dict, one: str) -> None:
        if self._at.value is None:
            keys.pop(one, None)
        else:
            keys[one] = (self._at.timer, self._at.value)

    def _store(self, keys: dict) -> None:
        if keys:
            self._held.update(tuple(map(list, zip(*((one, timer, *value) for one, (timer, value) in keys.items())))))
        else:
            self._held.clear()

    def close(self) -> None:
        self._processor.close()


def _earliest(keys: dict[str, tuple[int | None, tuple]]) -> int | None:
    return min((timer for timer, _ in keys.values() if timer is not None), default=None)
