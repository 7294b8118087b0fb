import datetime as dt
import hashlib
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from docketry import schemas as S
from docketry.config import IntakeConfig
from docketry.operators import metrics
from docketry.sources import files, retention, sinks
from docketry.sources.job_store import JobStore, VersionConflict
from docketry.streaming import intake as SI
from test_jobs import NOW, job, table
from test_pipeline import CONFIG, msgs, objects, rec


def states(df):
    return {r.job_id: r.status for r in df.collect()}


def test_store_versions_and_compaction(spark, tmp_path):
    store = JobStore(spark, str(tmp_path), compact_after=1, buckets=1)
    assert store.version() == 0 and store.read().count() == 0
    assert store.apply(table(spark, job("a"), job("b"))) == 1
    assert store.apply(table(spark, job("a", "succeeded", 1, result="{}"))) == 2
    assert store.apply(table(spark, job("c"))) == 3
    assert states(store.read()) == {"a": "succeeded", "b": "pending_upload", "c": "pending_upload"}
    assert store.apply(table(spark, job("b", "failed", 1, reason="x"))) == 4
    assert store._manifest(2)["deltas"] and not store._manifest(3)["deltas"] and store._manifest(4)["deltas"]
    assert states(store.read()) == {"a": "succeeded", "b": "failed", "c": "pending_upload"}
    assert states(store.read(2)) == {"a": "succeeded", "b": "pending_upload"}


def test_store_repeated_batch_and_lost_race(spark, tmp_path):
    store = JobStore(spark, str(tmp_path))
    store.apply(table(spark, job("a")), batch=0)
    store.apply(table(spark, job("a", "failed", 1, reason="x")), batch=1)
    assert store.apply(table(spark, job("a")), batch=1) == 2
    assert states(store.read()) == {"a": "failed"}
    with pytest.raises(VersionConflict):
        store.apply(table(spark, job("b")), expected=1)
    with pytest.raises(VersionConflict):
        store._publish(2, {})


def test_intake_stream_end_to_end(spark, tmp_path):
    store = JobStore(spark, str(tmp_path / "store"))
    store.apply(table(spark, job("a"), job("b"), job("x", attempts=3)))
    stored = objects(spark, ("a", {}), ("b", {"content_type": "image/png"}))
    inbox = str(tmp_path / "in")
    msgs(spark, [rec("a")], [rec("b")], [rec("gone")]).coalesce(1).write.parquet(inbox)
    stream = lambda: files.messages(spark, inbox, streaming=True, max_files=1)
    start = lambda: SI.start_intake(
        stream(), store, lambda s: stored, str(tmp_path / "out"), str(tmp_path / "cp"),
        as_of=lambda batch: NOW + dt.timedelta(hours=batch), config=CONFIG,
    )
    start().awaitTermination()
    assert states(store.read()) == {"a": "succeeded", "b": "failed", "x": "pending_upload"}
    # the same deliveries again: effects are applied already
    msgs(spark, [rec("a")], [rec("gone")], receives=3).coalesce(1).write.mode("append").parquet(inbox)
    start().awaitTermination()
    records = spark.read.parquet(str(tmp_path / "out/records"))
    assert sorted((r.stream_batch, r.message_id, r.outcome) for r in records.collect()) == [
        (0, "m0", "processed"), (0, "m1", "terminal_failure_recorded"), (0, "m2", None),
        (1, "m0", "effect_already_applied"), (1, "m1", None),
    ]
    undelivered = spark.read.parquet(str(tmp_path / "out/undelivered"))
    assert sorted((r.stream_batch, r.message_id, r.destination) for r in undelivered.collect()) == [
        (0, "m2", "retry"), (1, "m1", "dead_letter")
    ]
    dead = str(tmp_path / "dead")
    msgs(spark, [rec("x")], [rec("gone")], receives=3).write.parquet(dead)
    SI.start_reconciliation(
        files.messages(spark, dead, streaming=True), store, str(tmp_path / "out"), str(tmp_path / "cp2"),
        as_of=lambda batch: NOW, config=CONFIG,
    ).awaitTermination()
    assert states(store.read())["x"] == "dead"
    parked = spark.read.parquet(str(tmp_path / "out/dead_letters/undelivered"))
    assert [(r.message_id, r.destination) for r in parked.collect()] == [("m1", "quarantine")]


def test_windowed_request_stream(spark, tmp_path):
    rows = [(NOW + dt.timedelta(seconds=s), "api", code, None, 1, 2) for s, code in [(0, 200), (10, 404), (299, 503), (300, 500)]]
    df = spark.createDataFrame(
        rows, "ts timestamp, component string, status_code int, provider_error_code string, input_tokens long, output_tokens long"
    )
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = (
        SI.windowed_requests(stream).writeStream.outputMode("update").format("memory").queryName("req")
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    got = sorted((r.period_start, r.requests, r.errors_4xx, r.errors_5xx, r.input_tokens) for r in spark.table("req").collect())
    assert got == [(NOW, 3, 1, 1, 3), (NOW + dt.timedelta(minutes=5), 1, 0, 1, 1)]


def test_alarm_stream(spark, tmp_path):
    rows = [("queue_oldest_age", NOW + dt.timedelta(minutes=m), v) for m, v in [(0, 400.0), (2, 301.0), (3, 10.0)]]
    df = spark.createDataFrame(rows, "metric string, period_start timestamp, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    SI.start_alarms(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    written = spark.read.parquet(str(tmp_path / "out/alarm_states"))
    assert written.select("alarm").distinct().count() == len(S.ALARMS)
    assert written.where("alarm <> 'processing-queue-age' AND state <> 'OK'").count() == 0
    states_ = written.where("alarm = 'processing-queue-age'").orderBy("period_start").collect()
    assert [(r.alarm, r.state) for r in states_] == [
        ("processing-queue-age", "OK"), ("processing-queue-age", "OK"),
        ("processing-queue-age", "ALARM"), ("processing-queue-age", "OK"),
    ]


def test_alarm_stream_keeps_the_look_back(spark, tmp_path):
    schema = "metric string, period_start timestamp, value double"
    for m, v in [(0, 400.0), (1, 400.0), (2, 10.0)]:
        df = spark.createDataFrame([("queue_oldest_age", NOW + dt.timedelta(minutes=m), v)], schema)
        df.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        SI.start_alarms(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    written = spark.read.parquet(str(tmp_path / "out/alarm_states")).where("alarm = 'processing-queue-age'")
    got = [(r.period_start.minute, r.state) for r in written.orderBy("period_start").collect()]
    assert got == [(0, "OK"), (1, "ALARM"), (2, "ALARM")]


def test_alarm_one_of_one_and_missing_periods(spark):
    rows = [("m", NOW, 1.0), ("m", NOW + dt.timedelta(minutes=15), 0.5)]
    df = spark.createDataFrame(rows, "metric string, period_start timestamp, value double")
    got = metrics.evaluate_alarm(df, ["metric"], 1.0, seconds=300).orderBy("period_start").collect()
    assert [r.state for r in got] == ["ALARM", "OK", "OK", "OK"]
    moves = metrics.state_changes(metrics.evaluate_alarm(df, ["metric"], 1.0, seconds=300), ["metric"]).collect()
    assert [(r.previous_state, r.state) for r in moves] == [("ALARM", "OK"), ("OK", "ALARM")]


def test_queue_batch_files(spark, tmp_path):
    docs = {
        "a.json": {"Records": [{"messageId": "m1", "body": "{}", "attributes": {
            "SentTimestamp": "1706745600000", "ApproximateReceiveCount": "2"}}, {"messageId": 5, "body": 7}, "x"]},
        "b.json": {"Records": []},
        "c.json": {"Records": {}},
    }
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc, indent=1))
    rows = files.queue_batches(spark, str(tmp_path)).orderBy("batch_id", "msg_pos").collect()
    assert [(r.batch_id[-6:], r.msg_pos, r.message_id, r.body, r.receive_count, r.batch_error) for r in rows] == [
        ("a.json", 0, "m1", "{}", 2, None), ("a.json", 1, None, None, 1, None), ("a.json", 2, None, None, 1, None),
        ("c.json", 0, None, None, 1, "malformed_queue_event"),
    ]
    assert rows[0].sent_ts == dt.datetime(2024, 2, 1)


def test_text_objects_skip_large_bodies(spark, tmp_path):
    for name, text in {"j1": "hello", "j2": "x" * 50, "j 3": "bad"}.items():
        folder = tmp_path / "documents" / name
        folder.mkdir(parents=True)
        (folder / "source.txt").write_text(text)
    (tmp_path / "documents" / "j1" / "other.txt").write_text("no")
    rows = files.text_objects(spark, str(tmp_path), max_size_bytes=10).orderBy("object_key").collect()
    got = [(r.object_key, r.size_bytes, r.content) for r in rows if r.object_key]
    assert got == [("documents/j1/source.txt", 5, bytearray(b"hello")), ("documents/j2/source.txt", 50, None)]


def test_text_objects_written_and_listed_by_folders(spark, tmp_path):
    rows = spark.createDataFrame([(f"j{n}", "x" * n) for n in range(150)] + [("j1", "again"), ("j2", None), (None, "lost")], "owner string, value string")
    folders = files.write_text_objects(rows, str(tmp_path / "objects"), folders=40)
    assert 32 < len(folders) <= 40  # above Spark's threshold, so folders and not objects are the listing's tasks
    found = files.text_objects(spark, folders, max_size_bytes=30, owner_pattern=files.OWNER_FOLDER)
    got = {r.object_key: (r.size_bytes, r.content and bytes(r.content)) for r in found.collect()}
    sizes = {f"documents/j{n}/source.txt": n + 1 for n in range(150)} | {"documents/__HIVE_DEFAULT_PARTITION__/source.txt": 5}
    sizes |= {"documents/j1/source.txt": 8, "documents/j2/source.txt": 4}
    assert {k: v[0] for k, v in got.items()} == sizes
    assert got["documents/j7/source.txt"][1] == b"x" * 7 + b"\n" and got["documents/j30/source.txt"][1] is None
    assert got["documents/j2/source.txt"][1] in (b"xx\n\n", b"\nxx\n")


def test_text_objects_take_one_file_each_and_tasks_by_folders(spark, tmp_path):
    rows = spark.range(1500).selectExpr("concat('j', id) AS owner", "repeat('é', int(id)) AS value")
    folders = files.write_text_objects(rows, str(tmp_path / "objects"), folders=40)
    assert sum(p.is_file() for p in (tmp_path / "objects").rglob("*")) == 1500
    assert sum(p.is_dir() for p in (tmp_path / "objects").rglob("*")) == len(folders)  # a folder an object took a block of its own
    found = files.text_objects(spark, folders, max_size_bytes=2048, owner_pattern=files.OWNER_FOLDER)
    # Spark's file index held every path on the driver, and a task took a few objects only
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism and not found.inputFiles()
    got = {r.object_key: r for r in found.collect()}
    body = lambda n: "é".encode() * n + b"\n"
    assert {k: r.size_bytes for k, r in got.items()} == {f"documents/j{n}/source.txt": 2 * n + 1 for n in range(1500)}
    assert all((r.content and bytes(r.content)) == (body(n) if n <= 1023 else None) for n in range(1500) for r in [got[f"documents/j{n}/source.txt"]])
    assert got["documents/j9/source.txt"].etag == hashlib.md5(body(9)).hexdigest() and got["documents/j1024/source.txt"].etag is None


def test_text_objects_of_odd_owners(spark, tmp_path):
    rows = spark.createDataFrame([(x, "v") for x in ("a/b", "b", "_c", ".d", "", "e f", "g.txt", "%2F", None)], "owner string, value string")
    folders = files.write_text_objects(rows, str(tmp_path / "objects"))
    got = [r.object_key for r in files.text_objects(spark, folders, owner_pattern=files.OWNER_FOLDER).collect()]
    named = [f"documents/{x}/source.txt" for x in ("%2F", ".d", "__HIVE_DEFAULT_PARTITION__", "_c", "b", "g.txt")]
    assert sorted(k for k in got if k) == named and got.count(None) == 3  # nested, empty, spaced


def test_text_objects_of_a_list_as_of_its_root(spark, tmp_path):
    bodies = {"documents/a/source.txt": "a" * 5, "documents/b/source.txt": "b" * 50, "documents/empty/source.txt": "", "documents/c/other.txt": "c",
              "documents/_d/source.txt": "d", "documents/.e/source.txt": "e", "documents/_f=g/source.txt": "f", "documents/h/_source.txt": "h",
              "deep/documents/i j/source.txt": "i", "source.txt": "s", "source.txt._COPYING_": "t"}
    for name, text in bodies.items():
        (tmp_path / "o" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "o" / name).write_text(text)
    root = str(tmp_path / "o")
    rows = lambda df: sorted(map(repr, df.collect()))
    for glob in ("source.txt", "*.txt", "{other,sourc?}.[s-u]xt", "*"):
        for limit in (None, 10):
            one = files.text_objects(spark, root, max_size_bytes=limit, file_glob=glob)
            for many in ([root], [f"file://{root}", f"file://{root}"], [f"{root}/doc*", f"{root}/deep", f"{root}/source.txt"]):
                listed = files.text_objects(spark, many, max_size_bytes=limit, file_glob=glob)
                assert listed.dtypes == one.dtypes
                assert rows(listed) == rows(one), (glob, limit, many)
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        files.text_objects(spark, [root, f"{root}/none"])


def test_access_log(spark, tmp_path):
    (tmp_path / "log").write_text(json.dumps({"requestId": "r", "requestTimeEpoch": "1706745600000", "status": "404",
                                              "responseLength": "-", "integrationLatency": "12"}) + "\n{bad\n")
    rows = files.access_log(spark, str(tmp_path / "log")).collect()
    assert (rows[0].ts, rows[0].status_code, rows[0].response_bytes, rows[0].integration_latency_ms) == (
        dt.datetime(2024, 2, 1), 404, None, 12.0)
    assert rows[1].requestId is None


def test_retention_and_idempotent_sink(spark, tmp_path):
    df = spark.createDataFrame([(NOW,), (NOW - dt.timedelta(days=14),), (NOW - dt.timedelta(days=14, seconds=1),)], "ts timestamp")
    assert retention.retained(df, "ts", "logs", NOW).count() == 2
    dates = df.withColumn("d", F.to_date("ts"))
    assert retention.expired_dates(dates, "d", "logs", NOW).count() == 1
    for _ in range(2):
        sinks.write_batch(df, str(tmp_path), "t", 7)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    events = df.withColumn("event_name", F.lit("e"))
    sinks.write_telemetry(events, str(tmp_path), 1)
    assert spark.read.parquet(str(tmp_path / "telemetry")).where("event_date = DATE'2024-02-01'").count() == 1


def test_raw_jobs_keep_bad_rows(spark, tmp_path):
    (tmp_path / "jobs.json").write_text('{"job_id":"a","attempts":1}\n{"job_id":"b","attempts":"x"}\nnope\n')
    rows = files.raw_jobs(spark, str(tmp_path / "jobs.json"))
    assert rows.count() == 3 and rows.columns == list(S.JOB_COLUMNS)


def test_config_rejects_bad_limits():
    for bad in ({"expected_bucket": " "}, {"max_size_bytes": 0}, {"lease_seconds": 0}, {"max_receives": 0}):
        with pytest.raises(ValueError):
            IntakeConfig(**bad)


def test_a_batch_is_computed_again_after_another_writer(spark, tmp_path):
    store = JobStore(spark, str(tmp_path))
    store.apply(table(spark, job("a"), job("b")))
    seen = []

    def compute(jobs):
        seen.append(states(jobs))
        if len(seen) == 1:  # another writer publishes between read and apply
            store.apply(table(spark, job("a", "dead", 1, reason="processing_retries_exhausted")))
        done = [j for j, s in seen[-1].items() if s == "pending_upload"]
        return table(spark, *[job(j, "succeeded", 1, result="{}") for j in done]), lambda: None

    SI.publish_once(store, "intake", 0, compute)
    assert states(store.read()) == {"a": "dead", "b": "succeeded"} and len(seen) == 2
    SI.publish_once(store, "intake", 0, compute)
    assert len(seen) == 2 and store.last_batch() == 0 and store.last_batch("reconciliation") == -1


def test_repeated_reconciliation_keeps_its_records(spark, tmp_path):
    store = JobStore(spark, str(tmp_path / "store"))
    store.apply(table(spark, job("x", attempts=3)))
    msgs(spark, [rec("x")], receives=3).write.parquet(str(tmp_path / "dead"))
    for cp in ("cp1", "cp2"):  # a lost checkpoint repeats batch 0
        SI.start_reconciliation(
            files.messages(spark, str(tmp_path / "dead"), streaming=True), store, str(tmp_path / "out"), str(tmp_path / cp),
            as_of=lambda batch: NOW, config=CONFIG,
        ).awaitTermination()
    records = spark.read.parquet(str(tmp_path / "out/dead_letter_records")).collect()
    assert [r.outcome for r in records] == ["dead_recorded"] and store.version() == 2


def test_store_errors_are_not_conflicts(spark, tmp_path):
    store = JobStore(spark, str(tmp_path / "s"))
    (tmp_path / "s").write_text("a file where the folder should be")
    with pytest.raises(Exception) as caught:
        store._publish(1, {})
    assert not isinstance(caught.value, VersionConflict)


def test_alarms_of_every_queue_and_messages_never_received(spark):
    rows = [
        ("lost", "2024-01-01 00:00:00", None), ("served", "2024-01-01 00:00:00", "2024-01-01 00:10:00"),
        ("quick", "2024-01-01 00:00:00", "2024-01-01 00:02:00"),
    ]
    sent = spark.createDataFrame([(*r, None) for r in rows], "queue string, sent_ts string, received_ts string, done_ts string")
    sent = sent.select("queue", *[F.col(c).cast("timestamp").alias(c) for c in ("sent_ts", "received_ts", "done_ts")])
    first, last = (F.lit(x).cast("timestamp") for x in ("2024-01-01 00:00:00", "2024-01-01 00:20:00"))
    points = metrics.oldest_age(sent, until=last).select(
        "queue", "period_start", F.lit("queue_oldest_age").alias("metric"), F.col("oldest_age_s").cast("double").alias("value")
    )
    states = metrics.evaluate_alarms(points, first, last, ("queue",))
    moved = metrics.state_changes(states, ["alarm", "queue"]).collect()
    assert sorted((r.queue, str(r.period_start)[14:16], r.state) for r in moved) == [
        ("lost", "05", "ALARM"), ("served", "05", "ALARM"), ("served", "11", "OK"),
    ]
    assert states.select("alarm", "queue").distinct().count() == len(S.ALARMS) - 1 + 3


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "job_id string")


def test_lookup_opens_the_buckets_asked_for(spark, tmp_path):
    store = JobStore(spark, str(tmp_path), buckets=32)
    names = [f"j{i}" for i in range(200)]
    store.apply(table(spark, *[job(n) for n in names]))
    store.apply(table(spark, job("j7", "failed", 1, reason="x")))
    found = store.lookup(ids(spark, "j7", "gone", None))
    assert states(found) == {"j7": "failed"}
    files_ = {f for f in store.lookup(ids(spark, "j7")).inputFiles()}
    assert 1 <= len(files_) <= 3 < len(store.read().inputFiles())
    assert store.lookup(ids(spark)).count() == 0


def test_a_change_rewrites_only_its_buckets(spark, tmp_path):
    store = JobStore(spark, str(tmp_path), compact_after=1, buckets=8)
    store.apply(table(spark, *[job(f"j{i}") for i in range(100)]))
    before = store._manifest(1)["base"]
    for _ in range(2):
        store.apply(table(spark, job("j3", "failed", 1, reason="x")))
    after = store._manifest(3)
    assert sum(after["base"][b] != run for b, run in before.items()) == 1 and not after["deltas"]
    assert states(store.read())["j3"] == "failed" and store.read().count() == 100
    assert states(store.read(1))["j3"] == "pending_upload"


def test_a_writer_that_dies_at_any_step_leaves_a_store_that_works(spark, tmp_path, monkeypatch):
    store = JobStore(spark, str(tmp_path), compact_after=0, buckets=4)
    store.apply(table(spark, job("a"), job("b")))

    class Died(BaseException):
        pass

    steps = ("_write", "_publish", "_name")
    for step in steps:
        for after in (False, True):
            real = getattr(JobStore, step)

            def broken(self, *args, real=real, after=after):
                if after:
                    real(self, *args)
                raise Died

            with monkeypatch.context() as m:
                m.setattr(JobStore, step, broken)
                version = store.version()
                with pytest.raises(Died):
                    store.apply(table(spark, job("a", "failed", 1, reason=step)))
            published = after and step in ("_publish", "_name")
            assert store.version() == version + published
            assert states(store.read())["b"] == "pending_upload"
            store.apply(table(spark, job("a", "dead", 1, reason="next")))
            assert states(store.read()) == {"a": "dead", "b": "pending_upload"}
    folders = len(list((tmp_path / "data").iterdir()))
    assert store.remove_unused(keep_versions=1, older_than_seconds=0) > 0
    assert len(list((tmp_path / "data").iterdir())) < folders
    assert states(store.read()) == {"a": "dead", "b": "pending_upload"}


def test_an_empty_version_file_of_a_dead_writer_is_passed_over(spark, tmp_path):
    store = JobStore(spark, str(tmp_path))
    store.apply(table(spark, job("a")))
    (tmp_path / "_versions" / f"{2:012d}.json").write_text("")
    assert states(store.read()) == {"a": "pending_upload"} and store.last_batch() == -1
    assert store.apply(table(spark, job("a", "failed", 1, reason="x"))) == 3
    assert states(store.read()) == {"a": "failed"} and states(store.read(1)) == {"a": "pending_upload"}
    with pytest.raises(json.JSONDecodeError):
        store.read(2)
    with pytest.raises(VersionConflict):
        store._publish(3, {})
    assert states(store.read()) == {"a": "failed"}


def test_no_change_is_a_version_too(spark, tmp_path):
    store = JobStore(spark, str(tmp_path))
    assert store.apply(table(spark, job("a")).where("false"), batch=0) == 1
    assert store.read().count() == 0 and store.last_batch() == 0
    assert store.lookup(ids(spark, "a")).count() == 0
