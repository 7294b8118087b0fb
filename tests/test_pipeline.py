"""Terminal and retryable outcomes, message verdicts, dead letters."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from docketry import schemas as S
from docketry.config import IntakeConfig
from docketry.operators import outcomes as R
from docketry.plans import pipeline as P
from test_jobs import LIVE, NOW, job, table

TEXT = "Invoice 7"
ETAG = hashlib.md5(TEXT.encode()).hexdigest()
CONFIG = IntakeConfig(max_size_bytes=100)


def rec(job_id, size=len(TEXT), etag=ETAG, version=None, **changes):
    obj = {"key": f"documents%2F{job_id}%2Fsource.txt", "size": size}
    if etag:
        obj["eTag"] = etag
    if version:
        obj["versionId"] = version
    obj.update(changes)
    return {"eventName": "ObjectCreated:Put", "s3": {"bucket": {"name": "docs"}, "object": obj}}


def msgs(spark, *bodies, ids=None, receives=1):
    rows = [
        ("b", i, (ids or {}).get(i, f"m{i}"), json.dumps({"Records": b}) if isinstance(b, list) else b,
         NOW + dt.timedelta(seconds=i), receives)
        for i, b in enumerate(bodies)
    ]
    return spark.createDataFrame(rows, S.MESSAGE)


def objects(spark, *rows):
    """(job_id, changes) to stored objects."""
    out = []
    for job_id, changes in rows:
        o = dict(object_key=f"documents/{job_id}/source.txt", version_id=None, is_latest=True,
                 content=TEXT.encode(), size_bytes=len(TEXT), content_type="text/plain",
                 etag=f'"{ETAG}"', load_error=None)
        o.update(changes)
        out.append(tuple(o[c] for c in S.STORED_OBJECT.fieldNames()))
    return spark.createDataFrame(out, S.STORED_OBJECT)


def test_outcome_matrix(spark):
    blank = b" \n "
    bad_utf8 = b"\xff\xfe\xfd"
    case = {
        # job: (record, object changes or None, planned outcome, status, reason, retry, failed)
        "ok": (rec("ok"), {}, None, "succeeded", None, None),
        "noetag": (rec("noetag", etag=None), {}, None, "failed", "invalid_document_reference", None),
        "nofile": (rec("nofile"), None, None, "failed", "document_not_found", None),
        "big": (rec("big", size=101), None, None, "failed", "document_validation_failed", None),
        "pdf": (rec("pdf"), {"content_type": "application/pdf"}, None, "failed", "document_validation_failed", None),
        "tag": (rec("tag", etag="other"), {}, None, "failed", "document_validation_failed", None),
        "size": (rec("size", size=3), {}, None, "failed", "document_validation_failed", None),
        "short": (rec("short"), {"content": b"x"}, None, "failed", "document_validation_failed", None),
        "utf8": (rec("utf8", size=3), {"content": bad_utf8, "size_bytes": 3}, None, "failed",
                 "document_validation_failed", None),
        "blank": (rec("blank", size=3), {"content": blank, "size_bytes": 3}, None, "failed",
                  "invalid_provider_request", None),
        "store": (rec("store"), {"load_error": "timeout"}, None, "pending_upload", None, "document_dependency_error"),
        "late": (rec("late"), {}, "timeout", "pending_upload", None, "provider_timeout"),
        "slow": (rec("slow"), {}, "throttled", "pending_upload", None, "provider_throttled"),
        "conf": (rec("conf"), {}, "configuration_error", "pending_upload", None, "provider_configuration_error"),
        "junk": (rec("junk"), {}, "invalid_response", "failed", "ai_provider_invalid_response", None),
        "boom": (rec("boom"), {}, "unexpected", "processing", None, "unexpected"),
        "ver": (rec("ver", version="v1"), {"version_id": "v1", "is_latest": False}, None, "succeeded", None, None),
        "nover": (rec("nover", version="v2"), {"version_id": "v1"}, None, "failed", "document_not_found", None),
    }
    jobs = table(spark, *[job(n) for n in case])
    stored = objects(spark, *[(n, c[1]) for n, c in case.items() if c[1] is not None])
    plan = spark.createDataFrame(
        [(n, c[2]) for n, c in case.items() if c[2]], "job_id string, planned_outcome string"
    )
    run = P.process_uploads(
        msgs(spark, *[[c[0]] for c in case.values()]), jobs, stored, as_of=NOW, config=CONFIG, plan=plan
    )
    records = {r.job_id: r for r in run.records.collect()}
    after = {r.job_id: r for r in run.jobs.collect()}
    for name, (_, _, _, status, reason, retry) in case.items():
        r, j = records[name], after[name]
        assert (j.status, j.error_reason, j.attempts) == (status, reason, 1), name
        assert (r.failure_reason, r.retry_reason, r.failed) == (reason, retry, retry is not None), name
        assert (j.active_attempt_id is not None) == (status == "processing"), name
        assert (j.processing_result is not None) == (status == "succeeded"), name
    assert after["boom"].active_attempt_lease_expires_at == NOW + dt.timedelta(seconds=300)
    assert json.loads(after["ok"].processing_result)["document_type"] == "invoice"
    assert R.outcome_violations(run.records).where("size(violations) > 0").count() == 0
    failed = {r.message_id for r in run.messages.where("failed").collect()}
    assert len(failed) == sum(1 for c in case.values() if c[5])


def test_start_rejections_leave_the_job_alone(spark):
    jobs = table(spark, job("live", "processing", 1, "a", LIVE), job("done", "succeeded", 1, result="{}"))
    run = P.process_uploads(
        msgs(spark, [rec("live")], [rec("done")], [rec("gone")], "{bad"), jobs, objects(spark), as_of=NOW, config=CONFIG
    )
    got = {r.message_id: (r.outcome, r.retry_reason, r.error_code) for r in run.records.collect()}
    assert got == {
        "m0": (None, "processing_already_active", P.PROCESSING_ERROR),
        "m1": ("effect_already_applied", None, None),
        "m2": (None, "job_not_found", P.PROCESSING_ERROR),
        "m3": (None, "malformed_queue_message", P.PARSING_ERROR),
    }
    assert run.changes.count() == 0
    assert sorted(map(str, run.jobs.collect())) == sorted(map(str, jobs.collect()))


def test_records_of_one_message_stop_at_the_first_failure(spark):
    jobs = table(spark, *[job(n) for n in "abcd"])
    stored = objects(spark, *[(n, {}) for n in "abcd"])
    run = P.process_uploads(
        msgs(spark, [rec("a"), rec("gone"), rec("b")], [rec("c"), rec("a"), rec("d")]),
        jobs, stored, as_of=NOW, config=CONFIG,
    )
    got = sorted((r.message_id, r.rec_pos, r.job_id, r.outcome) for r in run.records.collect())
    assert got == [
        ("m0", 0, "a", "processed"), ("m0", 1, "gone", None),
        ("m1", 0, "c", "processed"), ("m1", 1, "a", "effect_already_applied"), ("m1", 2, "d", "processed"),
    ]
    assert {r.job_id: r.status for r in run.jobs.collect()} == {
        "a": "succeeded", "b": "pending_upload", "c": "succeeded", "d": "succeeded"
    }
    assert {r.message_id for r in run.messages.where("failed").collect()} == {"m0"}


def test_one_claim_per_job_under_a_race(spark):
    jobs = table(spark, job("a"), job("b", "processing", 3, "old", NOW))
    stored = objects(spark, ("a", {}), ("b", {}))
    run = P.process_uploads(
        msgs(spark, *[[rec("a")] for _ in range(20)], [rec("b")], [rec("b")]), jobs, stored, as_of=NOW,
        config=IntakeConfig(max_size_bytes=100, hot_share=0.2, hot_min_rows=0, salts=3),
    )
    outcomes = [r.start_outcome for r in run.records.collect()]
    assert outcomes.count("claim_acquired") == 2
    assert outcomes.count("processing_already_active") == 20
    assert {r.job_id: r.attempts for r in run.jobs.collect()} == {"a": 1, "b": 4}


def test_message_without_id_fails_its_batch(spark):
    jobs = table(spark, *[job(n) for n in "abc"])
    stored = objects(spark, *[(n, {}) for n in "abc"])
    run = P.process_uploads(
        msgs(spark, [rec("a")], [rec("b")], [rec("c")], ids={1: " "}), jobs, stored, as_of=NOW, config=CONFIG
    )
    assert {r.job_id: r.status for r in run.jobs.collect()} == {
        "a": "succeeded", "b": "pending_upload", "c": "pending_upload"
    }
    assert run.messages.where("not failed").count() == 0


def test_repeat_of_an_applied_batch_changes_nothing(spark):
    jobs = table(spark, job("a"))
    stored = objects(spark, ("a", {}))
    first = P.process_uploads(msgs(spark, [rec("a")]), jobs, stored, as_of=NOW, config=CONFIG)
    again = P.process_uploads(
        msgs(spark, [rec("a")]), first.jobs, stored, as_of=NOW + dt.timedelta(hours=1), config=CONFIG
    )
    assert again.changes.count() == 0
    assert [r.outcome for r in again.records.collect()] == ["effect_already_applied"]


def test_dead_letters(spark):
    jobs = table(
        spark, job("exh", attempts=3), job("new"), job("exp", "processing", 1, "a", NOW),
        job("live", "processing", 1, "a", LIVE), job("done", "succeeded", 1, result="{}"),
    )
    run = P.reconcile_dead_letters(
        msgs(spark, [rec("exh")], [rec("exh")], [rec("new")], [rec("exp")], [rec("live")], [rec("done")],
             [rec("gone")], [rec("new"), rec("exp")]),
        jobs, as_of=NOW, config=CONFIG,
    )
    got = {(r.message_id, r.rec_pos): (r.outcome, r.attempted, r.failed) for r in run.records.collect()}
    assert got == {
        ("m0", 0): ("dead_recorded", True, False), ("m1", 0): ("effect_already_applied", True, False),
        ("m2", 0): ("conflict", True, True), ("m3", 0): ("dead_recorded", True, False),
        ("m4", 0): ("conflict", True, True), ("m5", 0): ("effect_already_applied", True, False),
        ("m6", 0): ("job_not_found", True, True), ("m7", 0): ("conflict", True, True),
        ("m7", 1): ("dead_recorded", False, False),
    }
    dead = {r.job_id: r for r in run.changes.collect()}
    assert set(dead) == {"exh", "exp"} and dead["exh"].attempts == 3
    assert all(r.status == "dead" and r.error_reason == S.RETRIES_EXHAUSTED for r in dead.values())


@pytest.mark.parametrize("dlq,last", [(False, "dead_letter"), (True, "quarantine")])
def test_redrive(spark, dlq, last):
    df = spark.createDataFrame(
        [(True, 1, NOW), (True, 2, NOW), (True, 3, NOW), (False, 3, NOW)],
        "failed boolean, receive_count int, sent_ts timestamp",
    )
    rows = R.route_failed(df, IntakeConfig(), dead_letter_queue=dlq).orderBy("failed", "receive_count").collect()
    assert [r.destination for r in rows] == ["acknowledged", "retry", "retry", last]
    wait = 180 if dlq else 720
    assert rows[1].available_at == NOW + dt.timedelta(seconds=wait)
    routed = R.route_failed(df, IntakeConfig(), dead_letter_queue=dlq)
    assert R.due(routed, NOW + dt.timedelta(seconds=wait - 1)).count() == 0
    assert R.due(routed, NOW + dt.timedelta(seconds=wait)).count() == 2


def test_batch_summary_counts_distinct_failed_ids(spark):
    df = spark.createDataFrame(
        [("b", 0, "x", True), ("b", 1, "x", True), ("b", 2, "y", False), ("c", 3, "z", False)],
        "batch_id string, msg_pos long, message_id string, failed boolean",
    )
    got = {r.batch_id: (r.batch_size, r.processed_record_count, r.failed_record_count, r.outcome)
           for r in R.batch_summary(df).collect()}
    assert got == {"b": (3, 2, 1, "completed_with_failures"), "c": (1, 1, 0, "succeeded")}


def test_create_requests(spark):
    rows = [
        ("k1", "new", {"X-Request-ID": " r1 ", "x-correlation-id": "c1"}, None, None, False),
        ("k2", "new", None, "gw", "{}", False),
        ("k0", "new", None, "gw", "[1]", False),
        ("k3", "old", None, " ", " ", False),
        ("k4", "n4", None, None, "", True),
        ("k5", "n5", None, "g5", " {} ", False),
    ]
    df = spark.createDataFrame(
        rows, "event_key string, job_id string, headers map<string,string>, gateway_request_id string, "
        "body string, is_base64 boolean",
    )
    # a map literal keeps the order of its entries
    ordered = F.expr("map('x-request-id', ' ', 'X-Correlation-Id', 'a', 'x-correlation-ID', 'b', 'x-CORRELATION-id', ' ')")
    df = df.withColumn("headers", F.when(F.col("event_key") == "k5", ordered).otherwise(F.col("headers")))
    made = P.create_jobs(df, table(spark, job("old")), as_of=NOW)
    got = {r.event_key: (r.outcome, r.status_code, r.error_code, r.request_id, r.correlation_id)
           for r in made.responses.collect()}
    generated = "req_" + hashlib.sha256(b"k3").hexdigest()
    assert got["k1"] == ("succeeded", 201, None, "r1", "c1")
    assert got["k2"] == ("conflict", 409, "job_conflict", "gw", "gw")
    assert got["k0"] == ("invalid_request", 400, "invalid_request", "gw", "gw")
    assert got["k3"] == ("conflict", 409, "job_conflict", generated, generated)
    assert got["k4"][0] == "invalid_request"
    assert got["k5"] == ("succeeded", 201, None, "g5", "b")
    assert sorted(r.job_id for r in made.created.collect()) == ["n5", "new"]
    assert made.created.select(F.min("status")).first()[0] == "pending_upload"


def plain_rounds(messages, state, effect):
    """Round k runs record k of every message that has not failed; the first to arrive claims."""
    alive, out, state, attempts = set(messages), {}, dict(state), {}
    for k in range(max(map(len, messages.values()))):
        here = [(m, messages[m][k]) for m in sorted(alive, key=lambda m: int(m[1:])) if k < len(messages[m])]
        before, claimed = dict(state), set()
        for m, j in here:
            if before.get(j) is None:
                start = "job_not_found"
            elif before[j] == "ended":
                start = "effect_already_applied"
            elif before[j] == "live" or j in claimed:
                start = "processing_already_active"
            else:
                start = "claim_acquired"
                claimed.add(j)
                attempts[j] = attempts.get(j, 0) + 1
                e = effect(m, j, k)
                state[j] = {"complete": "ended", "release": "open", "kept": "live"}[e]
                out[m, k] = (j, start, e != "complete")
                if e != "complete":
                    alive.discard(m)
                continue
            out[m, k] = (j, start, start != "effect_already_applied")
            if start != "effect_already_applied":
                alive.discard(m)
    return out, state, attempts


@pytest.mark.parametrize("seed", range(3))
def test_records_in_order_against_plain_rounds(spark, seed):
    """Chains of conflicts between messages of several records, with releases and kept claims on the way."""
    import random

    rng = random.Random(seed)
    names = [f"j{i}" for i in range(14)]
    bodies = [[rng.choice(names) for _ in range(rng.choice([1, 1, 2, 3, 5, 9]))] for _ in range(22)]
    if seed == 0:
        bodies = [["j0", "j1"], ["j1", "j0"], ["j2"] * 6, ["j3", "j2"]]
    planned = {j: rng.choice(["success"] * 5 + ["timeout", "unexpected"]) for j in names}
    start = {j: rng.choice(["open"] * 6 + ["ended", "live", None]) for j in names}
    rows = {"open": lambda j: job(j), "ended": lambda j: job(j, "failed", 1, reason="x"), "live": lambda j: job(j, "processing", 1, attempt="a", lease=LIVE)}
    jobs = table(spark, *[rows[s](j) for j, s in start.items() if s])
    plan = spark.createDataFrame(list(planned.items()), "job_id string, planned_outcome string")
    kind = {"success": "complete", "timeout": "release", "unexpected": "kept"}
    messages = {f"m{i}": b for i, b in enumerate(bodies)}
    want, state, attempts = plain_rounds(messages, start, lambda m, j, k: kind[planned[j]])
    run = P.process_uploads(
        msgs(spark, *[[rec(j) for j in b] for b in bodies]), jobs, objects(spark, *[(j, {}) for j in names]), as_of=NOW, config=CONFIG, plan=plan,
    )
    got = {(r.message_id, r.rec_pos): (r.job_id, r.start_outcome, r.failed) for r in run.records.collect()}
    assert got == want
    after = {r.job_id: (r.status, r.attempts) for r in run.changes.collect()}
    name = {"ended": "succeeded", "open": "pending_upload", "live": "processing"}
    assert after == {j: (name[state[j]], n) for j, n in attempts.items()}
    failed = {m for (m, _), x in want.items() if x[2]}
    assert {r.message_id: r.failed for r in run.messages.collect()} == {m: m in failed for m in messages}


def test_jobs_do_not_grow_with_the_length_of_messages(spark):
    """One message of 60 records: as many Spark jobs as one of two."""
    def count(n):
        names = [f"j{i}" for i in range(n)]
        tracker, group = spark.sparkContext.statusTracker(), f"length-{n}"
        spark.sparkContext.setJobGroup(group, group)
        run = P.process_uploads(
            msgs(spark, [rec(j) for j in names], [rec("j0")]), table(spark, *[job(j) for j in names]),
            objects(spark, *[(j, {}) for j in names]), as_of=NOW, config=CONFIG,
        )
        records = run.records.collect()
        found = len(tracker.getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(records) == n + 1 and sum(r.outcome == "processed" for r in records) == n
        return found

    assert count(60) <= count(2) + 3


def test_objects_are_read_twice_and_bodies_for_passed_keys_only(spark, tmp_path):
    from docketry.operators import objects as O

    stored = objects(spark, *[(f"j{i}", {}) for i in range(50)])
    stored.write.parquet(str(tmp_path / "objects"))
    stored = spark.read.parquet(str(tmp_path / "objects"))
    references = spark.createDataFrame(
        [("j1", "documents/j1/source.txt", None, len(TEXT), ETAG), ("j2", "documents/j2/source.txt", None, len(TEXT), "other")],
        "job_id string, object_key string, version_id string, object_size long, etag string",
    )
    loaded = O.load_documents(references, stored, CONFIG)
    plan = loaded._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert len(scans) == 1 and "content#" in scans[0] and "LeftSemi" in plan  # metadata is behind the cut
    assert sorted((r.job_id, r.object_error, r.document_text) for r in loaded.collect()) == [
        ("j1", None, TEXT), ("j2", "document_validation_failed", None)
    ]
