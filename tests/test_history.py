import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docketry.operators import history as H
from docketry.streaming import state as ST

LEASE = 900
BASE = dt.datetime(2024, 1, 1)


def deliveries(spark, n=1500, seed=3, hot_end=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        kinds = ["release", "crash", "crash"] if hot and (i < n * 0.8 or not hot_end) else list(H.RESULTS) + ["crash"] * 6
        rows.append(("hot" if hot else f"j{rng.randrange(60)}", i, BASE + dt.timedelta(seconds=rng.randrange(40_000)), rng.choice(kinds)))
    return spark.createDataFrame(rows, "job_id string, event_id long, ts timestamp, result string")


def brute(rows):
    status, attempts, lease, changed, active, applied = "pending_upload", 0, None, None, 0, 0
    for us, _, result in sorted(rows):
        if status in ("succeeded", "failed"):
            applied += 1
        elif status == "processing" and lease > us:
            active += 1
        else:
            attempts, changed, lease = attempts + 1, us, None
            if result == "crash":
                status, lease = "processing", us + LEASE * 1_000_000
            else:
                status = {"complete": "succeeded", "fail": "failed", "release": "pending_upload"}[result]
    return status, attempts, lease, changed, active, applied, len(rows)


def expected(df):
    rows = {}
    for r in df.select("job_id", F.unix_micros("ts").alias("us"), "event_id", "result").collect():
        rows.setdefault(r[0], []).append(tuple(r[1:]))
    return {k: brute(v) for k, v in rows.items()}


def replayed(df, **options):
    out = H.replay(df, ["ts", "event_id"], lease_seconds=LEASE, **options)
    return {
        r[0]: tuple(r[1:])
        for r in out.select(
            "job_id", "status", "attempts", F.unix_micros("lease_expires_at"), F.unix_micros("updated_at"),
            "active", "applied", "deliveries",
        ).collect()
    }


@pytest.mark.parametrize("seconds", [None, 300, 3600, 20_000])
@pytest.mark.parametrize("hot_end", [True, False])
def test_replay_matches_a_sequential_fold(spark, seconds, hot_end):
    df = deliveries(spark, hot_end=hot_end)
    options = {} if seconds is None else dict(slice_seconds=seconds, share=0.05, min_rows=0)
    assert replayed(df, **options) == expected(df)


@pytest.mark.parametrize("parts,lease", [(1, LEASE), (40, LEASE), (25, 9000)])
@pytest.mark.parametrize("hot_end", [True, False])
def test_sorted_replay_matches_a_sequential_fold(spark, monkeypatch, parts, lease, hot_end):
    """One job over most partitions, leases shorter and longer than a partition."""
    monkeypatch.setattr(H, "FAN_OUT", 3)
    monkeypatch.setattr("test_history.LEASE", lease)
    df = deliveries(spark, n=1200, seed=parts + lease, hot_end=hot_end)
    df = df.unionByName(df.where("false")).unionByName(df.limit(1).withColumn("job_id", F.lit(None).cast("string")))
    out = H.replay_sorted(df, ["ts", "event_id"], lease_seconds=lease, parts=parts)
    got = {
        r[0]: tuple(r[1:])
        for r in out.select(
            "job_id", "status", "attempts", F.unix_micros("lease_expires_at"), F.unix_micros("updated_at"),
            "active", "applied", "deliveries",
        ).collect()
    }
    want = expected(df.where("job_id is not null"))
    assert got == {k: v for k, v in want.items()}


def test_sorted_replay_of_nothing(spark):
    df = deliveries(spark, n=3).where("false")
    assert H.replay_sorted(df, ["ts", "event_id"], lease_seconds=10).count() == 0


def test_groups_may_span_batches():
    frame = pd.DataFrame({"job_id": list("aabbbc"), "__seg": [None] * 6, "x": range(6)})
    parts = [frame.iloc[0:1], frame.iloc[1:4], frame.iloc[4:4], frame.iloc[4:6]]
    groups = [(k, g["x"].tolist()) for k, g in H._grouped(iter(parts), ["job_id", "__seg"])]
    assert groups == [(("a", -1), [0, 1]), (("b", -1), [2, 3, 4]), (("c", -1), [5])]


def test_stream_equals_replay(spark, tmp_path):
    df = deliveries(spark, n=600)
    # files in time order: no delivery is older than the state it meets
    bounds = [0, 10_000, 20_000, 40_001]
    for a, b in zip(bounds, bounds[1:]):
        low, high = BASE + dt.timedelta(seconds=a), BASE + dt.timedelta(seconds=b)
        df.where((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high))).coalesce(1).write.mode(
            "append"
        ).parquet(str(tmp_path / "in"))
    ST.use_rocksdb(spark)
    source = (
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    )
    run = (
        ST.run_state_machine(source, lease_seconds=LEASE)
        .writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    want = expected(df)
    got = out.groupBy("job_id").agg(
        F.max("attempts").alias("attempts"),
        F.count_if(F.col("outcome") == "processing_already_active").alias("active"),
        F.count_if(F.col("outcome") == "effect_already_applied").alias("applied"),
        F.count(F.lit(1)).alias("n"),
    )
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == {k: (v[1], v[4], v[5], v[6]) for k, v in want.items()}
    last = {r.job_id: r.status for r in out.groupBy("job_id").agg(F.max_by("status", F.struct("us", "event_id")).alias("status")).collect()}
    assert last == {k: v[0] for k, v in want.items()}


def test_late_delivery_is_rejected_and_never_reopens():
    state, out = ST.step(("pending_upload", 0, -1, -1), 100, "release", 10)
    assert (state, out) == (("pending_upload", 1, -1, 100), "released")
    assert ST.step(state, 99, "complete", 10) == (state, "rejected_late")
    done, _ = ST.step(state, 101, "complete", 10)
    assert ST.step(done, 50, "release", 10) == (done, "effect_already_applied")
    kept, _ = ST.step(state, 100, "crash", 10)
    assert ST.step(kept, 109, "complete", 10)[1] == "processing_already_active"
    assert ST.step(kept, 110, "complete", 10)[1] == "processed"
