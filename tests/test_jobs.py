import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from docketry import schemas as S
from docketry.operators import jobs as J

NOW = dt.datetime(2024, 2, 1)
OLD = dt.datetime(2024, 1, 31)
LIVE = NOW + dt.timedelta(seconds=1)


def job(job_id, status="pending_upload", attempts=0, attempt=None, lease=None, result=None, reason=None, **changes):
    row = dict(
        PK=f"JOB#{job_id}", entity_type="document_job", job_id=job_id, status=status, request_id="r",
        correlation_id="c", created_at=OLD, updated_at=OLD, attempts=attempts, active_attempt_id=attempt,
        active_attempt_started_at=OLD if attempt else None, active_attempt_lease_expires_at=lease,
        processing_result=result, error_reason=reason,
    )
    row.update(changes)
    return tuple(row[c] for c in S.JOB_COLUMNS)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), S.JOB)


def test_transitions_are_exactly_five(spark):
    pairs = list(itertools.product(S.STATUSES, S.STATUSES))
    df = spark.createDataFrame(pairs, "a string, b string")
    allowed = df.where(J.transition_allowed(F.col("a"), F.col("b"))).collect()
    assert sorted((r.a, r.b) for r in allowed) == sorted(S.TRANSITIONS)


def test_start_routes(spark):
    jobs = table(
        spark, job("p"), job("r", attempts=1), job("live", "processing", 1, "a", LIVE),
        job("edge", "processing", 1, "a", NOW), job("nolease", "processing", 1, "a", None),
        job("s", "succeeded", 1, result="{}"), job("f", "failed", 1, reason="x"), job("d", "dead", 1, reason="x"),
    )
    events = spark.createDataFrame(
        [(n, i, f"documents/{n}/source.txt") for i, n in enumerate(
            ["p", "p", "r", "live", "edge", "nolease", "s", "f", "d", "missing"])]
        + [("s", 90, " documents/s/source.txt"), ("p", -1, " documents/p/source.txt")],
        "job_id string, n int, object_key string",
    )
    got = {r.n: r.start_outcome for r in J.route_claims(events, jobs, NOW, ["n"]).collect()}
    assert got == {
        0: "claim_acquired", 1: "processing_already_active", 2: "claim_acquired",
        3: "processing_already_active", 4: "claim_acquired", 5: "conflict",
        6: "effect_already_applied", 7: "effect_already_applied", 8: "effect_already_applied",
        9: "job_not_found", 90: "conflict", -1: "conflict",
    }


def test_routes_do_not_depend_on_input_order_or_salting(spark):
    from docketry.config import IntakeConfig

    jobs = table(spark, *[job(f"j{i}") for i in range(5)])
    rows = [(f"j{0 if i % 2 else i % 5}", i, f"documents/j{0 if i % 2 else i % 5}/source.txt") for i in range(200)]
    schema = "job_id string, n int, object_key string"
    plain = J.route_claims(spark.createDataFrame(rows, schema), jobs, NOW, ["n"])
    salted = J.route_claims(
        spark.createDataFrame(rows[::-1], schema).repartition(7), jobs, NOW, ["n"],
        IntakeConfig(hot_share=0.1, hot_min_rows=0, salts=4),
    )
    view = lambda df: sorted((r.n, r.start_outcome) for r in df.collect())
    assert view(plain) == view(salted)


def test_claim_and_finalize_cycle(spark):
    jobs = table(spark, job("a"), job("b", "processing", 1, "old", NOW), job("c", "processing", 1, "x", LIVE))
    claims = spark.createDataFrame(
        [(n, f"new-{n}", NOW, LIVE, OLD) for n in ("a", "b", "c", "zz")] + [("a", "stale", NOW, LIVE, NOW)],
        "job_id string, attempt_id string, claimed_at timestamp, lease_expires_at timestamp, expected_updated_at timestamp",
    )
    judged = J.claim(jobs, claims)
    got = {(r.job_id, r.attempt_id): r.result for r in judged.collect()}
    assert got == {
        ("a", "new-a"): "applied", ("a", "stale"): "state_conflict", ("b", "new-b"): "applied",
        ("c", "new-c"): "claim_conflict", ("zz", "new-zz"): "job_not_found",
    }
    claimed = J.merge_rows(jobs, J.claimed_rows(jobs, judged))
    state = {r.job_id: (r.status, r.attempts, r.active_attempt_id) for r in claimed.collect()}
    assert state == {"a": ("processing", 1, "new-a"), "b": ("processing", 2, "new-b"), "c": ("processing", 1, "x")}
    later = NOW + dt.timedelta(minutes=1)
    finals = spark.createDataFrame(
        [
            ("a", "new-a", "complete", None, later, "{}", None),
            ("b", "old", "complete", None, later, "{}", None),
            ("c", "x", "fail", None, later, None, " bad "),
            ("zz", "x", "fail", None, later, None, "bad"),
        ],
        "job_id string, attempt_id string, operation string, expected_updated_at timestamp, "
        "finished_at timestamp, processing_result string, error_reason string",
    )
    done = J.finalize(claimed, finals)
    assert {r.job_id: r.result for r in done.collect()} == {
        "a": "applied", "b": "attempt_mismatch", "c": "applied", "zz": "job_not_found"
    }
    final = {r.job_id: r for r in J.finalized_rows(claimed, done).collect()}
    assert final["a"].status == "succeeded" and final["a"].active_attempt_id is None
    assert (final["c"].status, final["c"].error_reason) == ("failed", "bad")


@pytest.mark.parametrize(
    "row,want",
    [
        (job("j"), "conflict"),
        (job("j", attempts=1), "dead_recorded"),
        (job("j", "processing", 1, "a", NOW), "dead_recorded"),
        (job("j", "processing", 1, "a", LIVE), "conflict"),
        (job("j", "succeeded", 1, result="{}"), "effect_already_applied"),
        (job("j", "dead", 1, reason="x"), "effect_already_applied"),
    ],
)
def test_dead_letter_eligibility(spark, row, want):
    df = table(spark, row).withColumn("job_found", F.lit(True))
    assert df.select(J.dead_route(NOW)).first()[0] == want


def test_audit_finds_each_broken_rule(spark):
    cases = [
        (job("ok"), []),
        (job("ok2", "processing", 1, "a", LIVE), []),
        (job("ok3", "succeeded", 1, result="{}"), []),
        (job("ok4", "dead", 1, reason="x"), []),
        (job("a", attempt="a", lease=LIVE), ["attempt_not_allowed"]),
        (job("b", result="{}"), ["result_not_allowed"]),
        (job("c", reason="x"), ["reason_not_allowed"]),
        (job("d", "processing", 1), ["attempt_required"]),
        (job("e", "processing", 0, "a", LIVE), ["attempts_required"]),
        (job("f", "succeeded", 1), ["result_required"]),
        (job("g", "failed", 1, reason="  "), ["reason_required"]),
        (job("h", "failed", 0, reason="x"), ["attempts_required"]),
        (job("i", attempts=-1), ["attempts_negative"]),
        (job("j", "lost"), ["status_unknown"]),
        (job("k", PK="JOB#other"), ["partition_key"]),
        (job("l", entity_type="x"), ["entity_type"]),
        (job("m", updated_at=OLD - dt.timedelta(1)), ["updated_before_created"]),
        (job("n", "processing", 1, "a", OLD), ["lease_not_after_start"]),
        (job("o", "processing", 1, "a", None), ["attempt_incomplete"]),
        (job("p", correlation_id=" "), ["correlation_id_blank"]),
    ]
    got = {r.job_id: r.violations for r in J.audit(table(spark, *[c[0] for c in cases])).collect()}
    assert got == {c[0][2]: c[1] for c in cases}


def test_item_round_trip(spark):
    jobs = table(spark, job("a"), job("b", "processing", 1, "x", NOW + dt.timedelta(microseconds=5)))
    back = J.decode_items(J.encode_items(jobs))
    assert all(r.decode_violations == [] for r in back.collect())
    assert sorted(map(str, back.select(*S.JOB_COLUMNS).collect())) == sorted(map(str, jobs.collect()))


def test_illegal_transition_and_regression_with_hot_job(spark):
    t = lambda s: OLD + dt.timedelta(seconds=s)
    rows = [("h", i, t(i * 40), ("pending_upload", "processing")[i % 2], t(i * 40)) for i in range(30)]
    rows += [("h", 30, t(1200), "succeeded", t(5)), ("x", 31, t(0), "pending_upload", t(0)), ("x", 32, t(1), "dead", t(1))]
    df = spark.createDataFrame(rows, "job_id string, id int, ts timestamp, status string, updated_at timestamp")
    hot = dict(seconds=60, share=0.2, min_rows=0)
    bad = J.illegal_transitions(df, ["job_id"], ["ts", "id"], "ts", **hot).collect()
    assert [(r.job_id, r.id) for r in bad] == [("x", 32)]
    late = J.timestamp_regressions(df, ["job_id"], ["ts", "id"], "updated_at", "ts", **hot).collect()
    assert [(r.job_id, r.id) for r in late] == [("h", 30)]
