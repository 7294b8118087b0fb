import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docketry.operators import changes as C
from docketry.operators import metrics, requests as RQ, telemetry as TE
from test_jobs import NOW

SNAP = "key string, entity string, payload string, identity string"


def test_change_actions_and_counts(spark):
    before = spark.createDataFrame([("a", "t", "1", "x"), ("b", "t", "1", "x"), ("c", "t", "1", "x"), ("d", "t", "1", None)], SNAP)
    after = spark.createDataFrame([("a", "t", "1", "x"), ("b", "t", "2", "x"), ("c", "t", "1", "y"), ("e", "t", "1", "x")], SNAP)
    rows = C.change_set(before, after)
    assert {r.key: r.action for r in rows.collect()} == {"a": "no-op", "b": "update", "c": "replace", "d": "delete", "e": "create"}
    counts = C.action_counts(rows).collect()
    assert len(counts) == 5 and all(r.n == 1 and r.has_changes and r.destructive for r in counts)
    same = C.action_counts(C.change_set(before, before)).collect()
    assert {r.action: r.n for r in same} == {"create": 0, "update": 0, "delete": 0, "replace": 0, "no-op": 4}
    assert not any(r.has_changes or r.destructive for r in same)


def test_fingerprint_is_order_free_and_counts_copies(spark):
    rows = [(f"k{i % 50}", "t", "update") for i in range(200)]
    schema = "key string, entity string, action string"
    a = spark.createDataFrame(rows, schema).repartition(3)
    random.Random(1).shuffle(rows)
    b = spark.createDataFrame(rows, schema).repartition(7)
    one = lambda df: C.fingerprint(df).collect()[0][0]
    assert one(a) == one(b)
    assert one(a) != one(spark.createDataFrame(rows[:-1], schema))
    empty = spark.createDataFrame([], schema)
    assert one(empty) != one(a)
    assert C.matches(a, b).first()[0] and not C.matches(a, empty).first()[0] and C.matches(empty, empty).first()[0]


def test_report_is_redacted_escaped_and_ordered(spark):
    rows = [("x|y", "t", "delete"), ("me@x.org", "t", "create"), ("x|y", "t", "create")]
    got = C.report_lines(spark.createDataFrame(rows, "key string, entity string, action string")).collect()
    assert [(r.action, r.key) for r in got] == [("Create", "`<email>`"), ("Create", "`x\\|y`"), ("Delete", "`x\\|y`")]


def test_telemetry_allowlist(spark):
    rows = [
        (" e ", '{"outcome":"ok","duration_ms":1.5,"secret":"x","job_id":{"a":1},"status_code":200,"retryable":false,"error_code":null}'),
        ("f", '{"duration_ms":1e999,"outcome":["x"]}'), ("  ", "{}"), (None, "{}"), ("g", "not json"), ("h", None),
    ]
    raw = spark.createDataFrame(rows, "event_name string, fields string").withColumn("component", F.lit("c"))
    got = {r.event_name: (r.fields, r.dropped_field_count) for r in TE.project_events(raw, "svc").collect()}
    assert got == {
        "e": ({"outcome": "ok", "duration_ms": "1.5", "status_code": "200", "retryable": "false", "error_code": None}, 2),
        "f": ({}, 2), "g": ({}, 0), "h": ({}, 0),
    }


@pytest.mark.parametrize("code,level", [(199, None), (200, "info"), (399, "info"), (400, "warning"), (499, "warning"), (500, "error"), (599, "error")])
def test_severity(spark, code, level):
    assert spark.range(1).select(RQ.severity(F.lit(code))).first()[0] == level


def test_response_helpers(spark):
    row = spark.range(1).select(
        RQ.error_payload(F.lit("c"), F.lit("m"), F.lit("r"), F.lit("k")).alias("p"),
        RQ.merge_headers(F.expr("map('a','1','b','2')"), F.expr("map('b','3')")).alias("h"),
        RQ.path_job_id(F.expr("map('job_id',' j ')")).alias("j"),
        RQ.valid_status(F.lit(99)).alias("low"), RQ.valid_status(F.lit(599)).alias("high"),
    ).first()
    assert row.p == '{"error":{"code":"c","message":"m","request_id":"r","correlation_id":"k"}}'
    assert row.h == {"a": "1", "b": "3"} and row.j == "j" and not row.low and row.high


def test_p95_of_one_window(spark):
    rows = [(NOW + dt.timedelta(seconds=i), "c", float(i + 1)) for i in range(100)]
    df = spark.createDataFrame(rows, "ts timestamp, component string, duration_ms double")
    assert [(r.p95_duration_ms, r.n) for r in metrics.latency_p95(df).collect()] == [(95.0, 100)]


def test_gauges_and_oldest_age(spark):
    t = lambda s: NOW + dt.timedelta(seconds=s)
    rows = [("q", t(0), t(130), t(200)), ("q", t(10), t(20), None), ("q", t(100), None, None)]
    df = spark.createDataFrame(rows, "queue string, sent_ts timestamp, received_ts timestamp, done_ts timestamp")
    g = metrics.gauges_at(df, F.lit(t(120))).first()
    assert (g.visible, g.in_flight, g.oldest_age_s) == (2, 1, 120.0)
    ages = [(r.period_start, r.oldest_age_s) for r in metrics.oldest_age(df).orderBy("period_start").collect()]
    # the third message is never received: it waits to the end
    assert ages == [(t(0), 60.0), (t(60), 120.0), (t(120), 80.0), (t(180), 140.0)]
    lone = spark.createDataFrame([("q", t(0), None, None)], df.schema)
    later = metrics.oldest_age(lone, until=F.lit(t(150))).orderBy("period_start")
    assert [r.oldest_age_s for r in later.collect()] == [60.0, 120.0, 180.0]
    depth = [(r.visible, r.in_flight) for r in metrics.queue_depth(df).orderBy("period_start").collect()]
    assert depth == [(1, 1), (2, 1), (1, 2), (1, 1)]


def test_trace_joins_three_identifier_kinds(spark):
    t = lambda s: NOW + dt.timedelta(seconds=s)
    rows = [
        (1, t(0), "request.completed", "c1", "j1", None), (2, t(1), "processing.record_completed", None, "j1", "a1"),
        (3, t(2), "ai_provider.invocation_completed", "c1", None, "a1"), (4, t(3), "request.completed", "c2", "j2", None),
        (5, t(4), "processing.record_completed", None, "j2", "a2"), (6, t(5), "ai_provider.invocation_completed", "c1", None, "a9"),
    ]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, event_name string, correlation_id string, job_id string, processing_attempt_id string")
    assert [(r.event_id, r.stage) for r in TE.trace(df, "c1").collect()] == [(1, "request"), (2, "record"), (3, "provider")]


def test_latency_summaries_merge_and_hold_their_bound(spark):
    import datetime as dt
    import math
    import random

    from docketry.operators import metrics

    rng, start = random.Random(6), dt.datetime(2024, 1, 1)
    rows = [("c", start + dt.timedelta(seconds=rng.randrange(7200)), rng.choice([0.0, -3.0, 1e-7, 1.0, rng.lognormvariate(3, 2)])) for _ in range(3000)]
    rows += [("c", start, None), ("c", start, float("nan")), ("one", start, 42.0)]
    df = spark.createDataFrame(rows, "component string, ts timestamp, duration_ms double")
    minutes = metrics.latency_summary(df, 60)
    for quantile in (0.01, 0.5, 0.95, 1.0):
        for seconds in (300, 3600):
            direct, rolled = metrics.latency_summary(df, seconds), metrics.roll_up(metrics.roll_up(minutes, 300), seconds)
            assert sorted(map(str, direct.collect())) == sorted(map(str, rolled.collect()))
            got = {(r.component, r.period_start): r for r in metrics.summary_quantile(rolled, quantile).collect()}
            groups = {}
            for c, ts, v in rows:
                if v is not None and not math.isnan(v):
                    at = start + dt.timedelta(seconds=(ts - start).seconds // seconds * seconds)
                    groups.setdefault((c, at), []).append(v)
            assert set(got) == set(groups)
            for key, values in groups.items():
                exact = sorted(values)[math.ceil(quantile * len(values)) - 1]
                assert got[key].n == len(values)
                assert abs(got[key].value - max(exact, 0)) <= 0.01 * max(exact, 0) * (1 + 1e-9)
