"""Processors of one key, run over buckets of keys."""

import random
from collections import namedtuple

import pandas as pd
import pytest

from docketry.streaming import ownership as O, redelivery as D
from docketry.streaming.buckets import InBuckets
from test_redelivery import Clock, Memory

SECOND = 1_000_000
COLUMNS = {
    "queue": ["message_id", "kind", "level", "receive_count", "ok", "us"],
    "owners": ["job_id", "attempt_id", "kind", "us"],
}


class Counted(Memory):
    """The state handle of a bucket; how often it was called."""

    calls = 0

    def get(self):
        self.calls += 1
        return super().get()

    def update(self, value):
        self.calls += 1
        super().update(value)

    def registerTimer(self, ms):
        self.calls += 1
        super().registerTimer(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        super().deleteTimer(ms)


def one_key(kind):
    return D.DelayQueue(D.levels()) if kind == "queue" else O.OwnedJob(300)


def in_bucket(kind):
    held = Counted()
    state, outcomes = (D._STATE, D.OUTCOMES) if kind == "queue" else (O._STATE, O.OUTCOMES)
    bucket = InBuckets(one_key(kind), COLUMNS[kind][0], state, outcomes, COLUMNS[kind], {"receive_count", "us"})
    bucket.init(held)
    return held, bucket


def received(kind, rng, keys, trigger):
    rows, start = [], trigger * 400
    for _ in range(3 * keys):
        key, us = f"k{rng.randrange(keys)}", (start + rng.randrange(-50, 400, 50)) * SECOND + rng.choice([0, len(rows)])
        if kind == "owners":
            rows.append((key, f"a{rng.randrange(3)}", rng.choice([O.CLAIM, O.CLAIM, O.COMPLETE, O.FAIL, O.RELEASE]), us))
        elif rng.random() < 0.5:
            rows.append((key, "sent", None, None, None, us))
        else:
            rows.append((key, "handled", rng.choice([D.WORK, D.DEAD_LETTER]), rng.randrange(1, 4), rng.random() < 0.4, us))
    return rows


@pytest.mark.parametrize("kind", ["queue", "owners"])
def test_a_bucket_gives_what_its_keys_give_alone(kind):
    rng, keys = random.Random(7), 60
    held, bucket = in_bucket(kind)
    alone = {}
    made = namedtuple("Made", COLUMNS[kind])
    for trigger in range(9):
        # the watermark stands until the trigger is over; the last triggers bring no rows
        rows = received(kind, rng, keys, trigger) if trigger < 6 else []
        # timers at the watermark are due
        now, want, got = trigger * 400_000, [], []
        for key in dict.fromkeys(r[0] for r in rows):
            if key not in alone:
                alone[key] = (Memory(), one_key(kind))
                alone[key][1].init(alone[key][0])
            want += alone[key][1].handleInputRows((key,), iter([made(*r) for r in rows if r[0] == key]), Clock(now))
        if rows:
            frame = pd.DataFrame(rows, columns=COLUMNS[kind])
            before = held.calls
            for out in bucket.handleInputRows((0,), iter([frame[:50], frame[50:]]), Clock(now)):
                got += out.itertuples(index=False, name=None)
            assert held.calls - before <= 4
        for key, (own, processor) in alone.items():
            for at in sorted(own.timers):
                if at <= now + 400_000:
                    own.timers.remove(at)
                    want += processor.handleExpiredTimer((key,), Clock(now + 400_000), Clock(at))
        assert len(held.timers) <= 1
        for at in [x for x in held.timers if x <= now + 400_000]:
            for out in bucket.handleExpiredTimer((0,), Clock(now + 400_000), Clock(at)):
                got += out.itertuples(index=False, name=None)
            held.timers.discard(at)
        assert sorted(map(repr, got)) == sorted(repr(tuple(r)) for r in want)
        assert min(held.timers, default=None) == min((t for own, _ in alone.values() for t in own.timers), default=None)
    assert len(bucket._load()) == sum(own.value is not None for own, _ in alone.values())


def test_nulls_in_a_chunk_stay_nulls_and_whole_numbers_stay_whole():
    held, bucket = in_bucket("queue")
    chunk = pd.DataFrame([("a", "handled", None, None, None, 5), ("b", "handled", "work", 2.0, True, 7)], columns=COLUMNS["queue"])
    out = pd.concat(bucket.handleInputRows((0,), iter([chunk]), Clock(0)))
    assert out.values.tolist() == [["a", "stale", None, None, 5], ["b", "stale", "work", 2, 7]]
    assert held.value is None and not held.timers


def test_many_messages_are_few_state_rows(spark, tmp_path):
    rows = spark.range(3000).selectExpr("concat('m', id) AS message_id", "TIMESTAMP '2024-02-01 00:00:00' AS sent_ts")
    D.sent_events(rows, "2024-02-01 00:01:00").write.parquet(str(tmp_path / "events"))
    D.use_rocksdb(spark)
    events = spark.readStream.schema(D.EVENTS).parquet(str(tmp_path / "events"))
    run = (
        D.delay_queue(events, buckets=8).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("kind = 'delivery'").count() == 3000
    assert spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "checkpoint")).count() <= 8
