"""Alarm changes from keyed state against the evaluation of a whole table."""

import datetime as dt
import random

from pyspark.sql import functions as F

from docketry import schemas as S
from docketry.operators import metrics
from docketry.streaming import alarms as A
from docketry.streaming.state import use_rocksdb

START = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, parts):
    use_rocksdb(spark)
    for part in parts:
        spark.createDataFrame(part, A.POINTS).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(A.POINTS).parquet(str(tmp_path / "in"))
        A.start_alarm_changes(source, str(tmp_path), str(tmp_path / "checkpoint")).awaitTermination()
    return [(r.alarm, r.dim, r.period_start, r.state, r.previous_state) for r in spark.read.parquet(str(tmp_path / "alarm_changes")).collect()]


def minutes(n):
    return START + dt.timedelta(minutes=n)


def test_against_the_whole_table(spark, tmp_path):
    """Random gaps and values over four triggers with restarts, several series of every alarm."""
    rng, points = random.Random(4), []
    by_metric = {m: (threshold, period) for _, m, _, threshold, period, _, _ in S.ALARMS}
    for metric, (threshold, period) in by_metric.items():
        for dim in ("a", "b") if metric == "queue_oldest_age" else (None,):
            for n in range(0, 600, period // 60):
                if rng.random() < 0.4:
                    points.append((metric, dim, minutes(n), minutes(n + period // 60), threshold * rng.choice([0.5, 1.0, 2.0])))
    tick = lambda n: ("clock", None, minutes(n), minutes(n), 0.0)
    parts = [[p for p in points if lo < (p[3] - START).seconds // 60 <= lo + 150] + [tick(lo + 150)] for lo in range(0, 600, 150)]
    got = run(spark, tmp_path, [*parts, [tick(700)]])
    table = spark.createDataFrame(points, A.POINTS).withColumnRenamed("dim", "queue")
    first, last = (F.lit(minutes(n)).cast("timestamp") for n in (0, 660))
    states = metrics.evaluate_alarms(table, first, last, ("queue",))
    want = [
        (r.alarm, r.queue, r.period_start, r.state, r.previous_state)
        for r in metrics.state_changes(states, ["alarm", "queue"]).collect()
    ]
    assert (set(want) - set(got), set(got) - set(want)) == (set(), set()) and len(got) == len(want) > 100


def test_a_timer_ends_an_alarm_that_nothing_follows(spark, tmp_path):
    age = lambda n, seen=0: ("queue_oldest_age", "q", minutes(n), minutes(seen or n + 1), 400.0)
    clock = ("clock", None, minutes(60), minutes(60), 0.0)
    got = run(spark, tmp_path, [[age(0), age(1)], [clock], [age(70), age(1, seen=71), age(72)]])
    name = "processing-queue-age"
    assert sorted(got, key=lambda r: (r[2], r[3])) == [
        (name, "q", minutes(1), "ALARM", "OK"), (name, "q", minutes(1), "late", None), (name, "q", minutes(3), "OK", "ALARM"),
        (name, "q", minutes(72), "ALARM", "OK"),
    ]
