"""Delay queue and owner-checked jobs in keyed state."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docketry.config import IntakeConfig
from docketry.operators import jobs as J
from docketry.sources.job_store import JobStore
from docketry.streaming import ownership as O, redelivery as D
from docketry.streaming.state import use_rocksdb
from test_jobs import NOW, job, table
from test_pipeline import CONFIG, msgs, objects, rec
from test_store_and_streams import states

MIN = 60_000_000


class Memory:
    """The state handle of one key, in memory."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: self.ms


def queue():
    held, processor = Memory(), D.DelayQueue(D.levels())
    processor.init(held)
    return held, processor


def sent(us=0):
    return Row(kind="sent", level=None, receive_count=None, ok=None, us=us)


def handled(level, receives, ok, us):
    return Row(kind="handled", level=level, receive_count=receives, ok=ok, us=us)


def feed(processor, *rows):
    return [(r.kind, r.level, r.receive_count, r.us) for r in processor.handleInputRows(("m",), iter(rows), Clock(0))]


def fire(held, processor, now_ms=None):
    """The next timer, at its time or later."""
    at = min(held.timers)
    held.timers.remove(at)
    out = processor.handleExpiredTimer(("m",), Clock(now_ms or at), Clock(at))
    return [(r.kind, r.level, r.receive_count, r.us) for r in out]


def test_two_redrives_and_quarantine():
    held, processor = queue()
    out = feed(processor, sent())
    while held.timers:
        out += fire(held, processor)
    assert out == [
        ("delivery", "work", 1, 0), ("delivery", "work", 2, 12 * MIN), ("delivery", "work", 3, 24 * MIN),
        ("delivery", "dead_letter", 1, 36 * MIN), ("delivery", "dead_letter", 2, 39 * MIN), ("delivery", "dead_letter", 3, 42 * MIN),
        ("quarantine", "quarantine", 0, 45 * MIN),
    ]
    assert held.value is None


def test_answers_of_the_wrong_delivery_do_not_count():
    held, processor = queue()
    feed(processor, sent())
    assert feed(processor, sent(5)) == [("duplicate", "work", 1, 5)]
    assert feed(processor, handled("work", 1, False, MIN)) == [("retry", "work", 1, 12 * MIN)]
    assert fire(held, processor) == [("delivery", "work", 2, 12 * MIN)]
    assert feed(processor, handled("work", 1, True, 13 * MIN)) == [("stale", "work", 1, 13 * MIN)]
    assert feed(processor, handled("dead_letter", 2, True, 13 * MIN)) == [("stale", "dead_letter", 2, 13 * MIN)]
    assert feed(processor, handled("work", 2, True, 24 * MIN)) == [("stale", "work", 2, 24 * MIN)]  # visible again by then
    assert feed(processor, handled("work", 2, True, 23 * MIN)) == [("acknowledged", "work", 2, 23 * MIN)]
    assert held.value is None and not held.timers
    assert feed(processor, handled("work", 2, True, 23 * MIN)) == [("stale", "work", 2, 23 * MIN)]


def test_a_clock_that_jumps_leaves_every_delivery_its_wait():
    held, processor = queue()
    feed(processor, sent())
    assert fire(held, processor, now_ms=100 * 60_000) == [("delivery", "work", 2, 100 * MIN)]
    assert held.timers == {112 * 60_000}


def test_loop_with_the_jobs(spark, tmp_path):
    """Uploads and reconciliation as handlers: success, late success, a dead job, and a message nobody can read."""
    config = IntakeConfig(max_size_bytes=100, expected_bucket=CONFIG.expected_bucket)
    store = JobStore(spark, str(tmp_path / "store"))
    store.apply(table(spark, job("good"), job("slow"), job("never")))
    messages = msgs(spark, [rec("good")], [rec("slow")], [rec("never")], "{broken")
    reads = []

    def stored(session):
        reads.append(1)
        slow = {"load_error": "timeout"} if len(reads) == 1 else {}
        return objects(session, ("good", {}), ("slow", slow), ("never", {"load_error": "timeout"}))

    minutes = (2, 14, 26, 38, 41, 44, 47)
    out = D.redeliver(
        spark, messages, D.pipeline_handler(messages, store, stored, config), str(tmp_path / "queue"),
        [NOW + dt.timedelta(minutes=m) for m in minutes], config,
    ).collect()
    last = {r.message_id: (r.kind, r.level, r.receive_count) for r in out if r.kind in ("acknowledged", "quarantine")}
    assert last == {
        "m0": ("acknowledged", "work", 1), "m1": ("acknowledged", "work", 2), "m2": ("acknowledged", "dead_letter", 1),
        "m3": ("quarantine", "quarantine", 0),
    }
    assert states(store.read()) == {"good": "succeeded", "slow": "succeeded", "never": "dead"}
    assert sum(r.kind == "delivery" for r in out) == 1 + 2 + 4 + 6
    assert {r.message_id for r in out if r.kind == "retry"} == {"m1", "m2", "m3"}


# ---- owners ------------------------------------------------------------------


LEASE = 300 * 1_000_000


def run(*events, start=O.Job()):
    state, seen = start, []
    for kind, attempt, us in events:
        state, outcome = O.decide(state, kind, attempt, us, LEASE)
        seen.append(outcome)
    return state, seen


def test_only_the_owner_finalizes():
    state, seen = run(("claim", "a", 0), ("complete", "b", 1), ("claim", "b", 2), ("complete", "a", 3), ("complete", "a", 4), ("claim", "c", 5))
    assert seen == [J.CLAIM_ACQUIRED, O.STALE, J.ALREADY_ACTIVE, "processed", O.STALE, J.ALREADY_APPLIED]
    assert state == O.Job("succeeded", 1, None, None, 3)


def test_an_owner_whose_lease_is_over_may_answer_until_it_is_taken():
    assert run(("claim", "a", 0), ("fail", "a", LEASE + 1))[1] == [J.CLAIM_ACQUIRED, "terminal_failure_recorded"]
    state, seen = run(("claim", "a", 0), ("claim", "b", LEASE), ("complete", "a", LEASE + 1), ("release", "b", LEASE + 2), ("claim", "c", LEASE + 2))
    assert seen == [J.CLAIM_ACQUIRED, O.TAKEN_OVER, O.STALE, O.RELEASED, J.CLAIM_ACQUIRED]
    assert (state.attempts, state.attempt_id) == (3, "c")


def test_what_is_older_than_the_last_change_is_late():
    assert run(("claim", "a", 10), ("complete", "a", 9))[1][-1] == O.LATE
    assert run(("claim", "a", 10), ("release", "a", 20), ("claim", "b", 19))[1][-1] == O.LATE


def test_stream_against_a_plain_run(spark, tmp_path):
    """Three triggers with restarts; every row has an outcome, and ended leases are told once."""
    use_rocksdb(spark)
    rng, seconds = random.Random(3), lambda n: NOW + dt.timedelta(seconds=n)
    rows = []
    for n in range(240):
        kind = rng.choice(["claim", "claim", "complete", "fail", "release"])
        part = n // 80
        rows.append((f"j{rng.randrange(12)}", f"a{rng.randrange(6)}", kind, 2000 * part + rng.randrange(-900, 2000), part))
    rows += [(None, "a", "claim", 10, 0), ("j1", None, "fail", 10, 1), ("j1", "a", "explode", 10, 1)]
    schema = "job_id string, attempt_id string, kind string, ts timestamp, arrived timestamp"
    for part in range(3):
        # unique times within a job, so the order is one
        own = [(j, a, k, seconds(s) + dt.timedelta(microseconds=i), seconds(2000 * part + 1999 + part)) for i, (j, a, k, s, p) in enumerate(rows) if p == part]
        batch = spark.createDataFrame(own, schema)
        assert O.malformed_events(batch).count() == (1, 2, 0)[part]
        batch.write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        O.start_owned_jobs(source, str(tmp_path), str(tmp_path / "checkpoint"), lease_seconds=300).awaitTermination()
    got = [r.asDict() for r in spark.read.parquet(str(tmp_path / "outcomes")).collect()]
    start = int(NOW.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    jobs, want, expired = {}, [], []
    for part in range(3):
        for i, (j, a, k, s, p) in sorted(enumerate(rows), key=lambda x: (x[1][3], x[0])):
            if p == part and j and a and k != "explode":
                us = start + s * 1_000_000 + i
                jobs[j], outcome = O.decide(jobs.get(j, O.Job()), k, a, us, LEASE)
                want.append((j, a, k, us, outcome, jobs[j].status))
        mark = start + (2000 * part + 1999 + part) * 1_000_000
        for j, state in jobs.items():
            if state.lease_us and state.lease_us <= mark and (j, state.attempt_id, state.lease_us) not in expired:
                expired.append((j, state.attempt_id, state.lease_us))
    rows_of = lambda kind: sorted((r["job_id"], r["attempt_id"], r["kind"], r["us"], r["outcome"], r["status"]) for r in got if (r["kind"] == "lease") == kind)
    assert rows_of(False) == sorted(want)
    assert sorted((r["job_id"], r["attempt_id"], r["us"]) for r in got if r["kind"] == "lease") == sorted(expired)
    assert {r["side"] for r in got} == {"applied", "late", "stale", "not_needed", "expired"}


def test_registered_stream_reaches_every_side(spark):
    from docketry.plans import catalog

    out = catalog.all_queries()["stream_owner_finalize"](spark, "/root/testdata/sf0.001")
    sides = {r.side: r["count"] for r in out.groupBy("side").count().collect()}
    assert set(sides) == {"applied", "late", "stale", "not_needed", "expired"}
    assert out.where(F.col("outcome") == O.TAKEN_OVER).count() > 0


def test_missing_ids_are_left_out(spark, tmp_path):
    rows = spark.createDataFrame([(None, NOW)], "message_id string, sent_ts timestamp")
    out = D.redeliver(spark, rows, lambda d, c: d.selectExpr("message_id", "level", "receive_count", "true AS ok", "at AS ts"), str(tmp_path), [NOW])
    assert out.count() == 0


@pytest.mark.parametrize("config", [IntakeConfig(), IntakeConfig(max_receives=1)])
def test_levels(config):
    assert [x.max_receives for x in D.levels(config)] == [config.max_receives] * 2
