"""The job table: creation, lookup, claims, finalization and audits.

Every conditional write of the service is a compare-and-set join here: the
request rows carry the version they saw, the join decides which of them still
hold, and the rest come back classified instead of raising.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import schemas as S
from docketry.config import IntakeConfig
from docketry.functions import text as X
from docketry.functions import times as TM
from docketry.functions import variants as V
from docketry.operators import skew

# fixed values: outcomes of a start decision
CLAIM_ACQUIRED = "claim_acquired"
ALREADY_ACTIVE = "processing_already_active"
ALREADY_APPLIED = "effect_already_applied"
CLAIMABLE = "claimable"
JOB_NOT_FOUND = "job_not_found"
CONFLICT = "conflict"

LEASE = "active_attempt_lease_expires_at"


def is_terminal(status: Column) -> Column:
    return status.isin(*S.TERMINAL_STATUSES)


def transition_allowed(current: Column, target: Column) -> Column:
    return F.concat_ws(">", current, target).isin(*[f"{a}>{b}" for a, b in S.TRANSITIONS])


def transitions_table(spark: SparkSession) -> DataFrame:
    """The five allowed pairs as a dimension."""
    return spark.createDataFrame(list(S.TRANSITIONS), "from_status string, to_status string")


# ---- creation and lookup ----------------------------------------------------


def new_jobs(requests: DataFrame, as_of) -> DataFrame:
    """Pending rows for accepted create requests ``(job_id, request_id, correlation_id)``."""
    now = TM.as_timestamp(as_of)
    return requests.select(
        X.partition_key(F.col("job_id")).alias("PK"),
        F.lit(S.ENTITY_TYPE).alias("entity_type"),
        "job_id",
        F.lit(S.PENDING).alias("status"),
        "request_id",
        "correlation_id",
        now.alias("created_at"),
        now.alias("updated_at"),
        F.lit(0).cast("long").alias("attempts"),
        F.lit(None).cast("string").alias("active_attempt_id"),
        F.lit(None).cast("timestamp").alias("active_attempt_started_at"),
        F.lit(None).cast("timestamp").alias(LEASE),
        F.lit(None).cast("string").alias("processing_result"),
        F.lit(None).cast("string").alias("error_reason"),
    )


def insert_if_absent(
    rows: DataFrame, jobs: DataFrame, order: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Rows to insert and rows that conflict with an existing or earlier row.

    The first of several new rows with the same id wins; ``order`` decides.
    """
    position = F.struct(*[F.col(c) for c in order])
    packed = F.struct(*[F.col(c) for c in rows.columns])
    first = rows.groupBy("job_id").agg(F.min(position).alias("__first"), F.min_by(packed, position).alias("r"))
    inserted = first.join(jobs.select("job_id"), "job_id", "left_anti").select("r.*")
    winners = inserted.select("job_id", position.alias("__first"), F.lit(True).alias("__won"))
    looked = skew.salted_lookup(rows, winners, ["job_id"], order)
    conflicts = looked.where(
        F.col("__won").isNull() | (position != F.col("__first"))
    ).select(*rows.columns)
    return inserted, conflicts


def lookup(
    requests: DataFrame,
    jobs: DataFrame,
    spread_by: list[str],
    config: IntakeConfig = IntakeConfig(),
    *,
    few: bool = False,
) -> DataFrame:
    """Current row of each requested job id; rows without a job are kept."""
    state = jobs.withColumn("job_found", F.lit(True))
    found = skew.salted_lookup(
        requests, state, ["job_id"], spread_by, few=few, **config.hot_options()
    )
    return found.withColumn("job_found", F.coalesce("job_found", F.lit(False)))


def view(jobs: DataFrame) -> DataFrame:
    """The eight public fields of a job."""
    return jobs.select(
        "job_id", "status", "created_at", "updated_at",
        "attempts", "correlation_id", "processing_result", "error_reason",
    )


def latest_state(history: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key by aggregation (no sort of a whole group)."""
    packed = F.struct(*[F.col(c) for c in history.columns])
    position = F.struct(*[F.col(o) for o in order])
    return history.groupBy(*keys).agg(F.max_by(packed, position).alias("r")).select("r.*")


# ---- claims -----------------------------------------------------------------


def start_route(as_of, job_found: Column = None, owned: Column = None) -> Column:
    """Routing of an event joined to its job row, before any race is decided."""
    now = TM.as_timestamp(as_of)
    job_found = F.col("job_found") if job_found is None else job_found
    owned = F.lit(True) if owned is None else owned
    lease = F.col(LEASE)
    return (
        F.when(~job_found, JOB_NOT_FOUND)
        .when(~F.coalesce(owned, F.lit(False)), CONFLICT)
        .when(is_terminal(F.col("status")), ALREADY_APPLIED)
        .when((F.col("status") == S.PROCESSING) & lease.isNull(), CONFLICT)
        .when((F.col("status") == S.PROCESSING) & ~TM.lease_expired(now, lease), ALREADY_ACTIVE)
        .when(F.col("status").isin(S.PENDING, S.PROCESSING), CLAIMABLE)
        .otherwise(CONFLICT)
    )


# what routing and the later effects need; results can be large and stay behind
ROUTING = (
    "PK", "entity_type", "job_id", "status", "request_id", "correlation_id", "created_at",
    "attempts", LEASE,
)


def route_claims(
    events: DataFrame,
    jobs: DataFrame,
    as_of,
    order: list[str],
    config: IntakeConfig = IntakeConfig(),
    *,
    few: bool = False,
) -> DataFrame:
    """Join events to their jobs and decide ``start_outcome`` for each event.

    Deliveries of one batch are concurrent: for a claimable job the first event
    by ``order`` acquires the claim and the others see an active attempt. The
    first event and the row count of a job come from one combined aggregation,
    which also tells the lookup which job ids are hot. ``few`` as in
    ``skew.salted_lookup``.
    """
    position = F.struct(*[F.col(o) for o in order])
    owned = F.col("object_key") == X.build_object_key(F.col("job_id"))
    stats = events.groupBy("job_id").agg(
        F.min(F.when(owned, position)).alias("__winner"), F.count(F.lit(1)).alias("__n")
    )
    winners = stats.select("job_id", "__winner")
    state = jobs.select(*ROUTING, F.lit(True).alias("job_found")).join(
        F.broadcast(winners) if few else winners, "job_id"
    )
    joined = skew.salted_lookup(
        events, state, ["job_id"], order, counts=stats.select("job_id", "__n"),
        few=few, **config.hot_options(),
    ).withColumn("job_found", F.coalesce("job_found", F.lit(False)))
    route = start_route(as_of, owned=owned)
    return (
        joined.withColumn("__route", route)
        .withColumn(
            "start_outcome",
            F.when(
                F.col("__route") == CLAIMABLE,
                F.when(position == F.col("__winner"), CLAIM_ACQUIRED).otherwise(ALREADY_ACTIVE),
            ).otherwise(F.col("__route")),
        )
        .drop("__route", "__winner")
    )


def _one_winner(judged: DataFrame, order: list[str], lost: str) -> DataFrame:
    """Of the requests of one job that pass, the first by ``order`` applies; the
    others find its effect. Repeats of the winning request count as that request."""
    position = F.struct(*[F.col(c) for c in order])
    passed = F.col("result") == "applied"
    first = judged.where(passed).groupBy("job_id").agg(F.min(position).alias("__first"))
    named = judged.join(first, "job_id", "left")
    result = F.when(passed & ~position.eqNullSafe(F.col("__first")), lost).otherwise(F.col("result"))
    return named.select(*[c for c in judged.columns if c != "result"], result.alias("result"))


def claim(jobs: DataFrame, claims: DataFrame) -> DataFrame:
    """Conditional claims ``(job_id, attempt_id, claimed_at, lease_expires_at,
    expected_updated_at)``; adds ``result``. Of several that pass for one job the
    earliest applies and the others are ``claim_conflict``."""
    c = claims.alias("c")
    j = jobs.withColumn("job_found", F.lit(True)).alias("j")
    joined = c.join(j, F.col("c.job_id") == F.col("j.job_id"), "left")
    now = F.col("c.claimed_at")
    lease = F.col(f"j.{LEASE}")
    same_version = F.col("j.updated_at") == F.col("c.expected_updated_at")
    result = (
        F.when(F.col("j.job_found").isNull(), JOB_NOT_FOUND)
        .when((F.col("j.status") == S.PROCESSING) & (lease > now), "claim_conflict")
        .when(is_terminal(F.col("j.status")) | ~same_version, "state_conflict")
        .when((F.col("j.status") == S.PROCESSING) & lease.isNull(), "state_conflict")
        .when(now < F.col("j.updated_at"), "invalid_timestamp")
        .otherwise("applied")
    )
    judged = joined.select("c.*", result.alias("result"))
    return _one_winner(judged, ["claimed_at", "attempt_id", "lease_expires_at"], "claim_conflict")


def claimed_rows(jobs: DataFrame, claims: DataFrame) -> DataFrame:
    """New job rows of the applied claims."""
    won = claims.where(F.col("result") == "applied").select(
        "job_id", F.col("attempt_id").alias("__attempt"), "claimed_at", "lease_expires_at"
    ).distinct()
    return jobs.join(won, "job_id").select(
        "PK", "entity_type", "job_id", F.lit(S.PROCESSING).alias("status"),
        "request_id", "correlation_id", "created_at", F.col("claimed_at").alias("updated_at"),
        (F.col("attempts") + 1).alias("attempts"),
        F.col("__attempt").alias("active_attempt_id"),
        F.col("claimed_at").alias("active_attempt_started_at"),
        F.col("lease_expires_at").alias(LEASE),
        F.lit(None).cast("string").alias("processing_result"),
        F.lit(None).cast("string").alias("error_reason"),
    )


# ---- finalization -----------------------------------------------------------


def finalize(jobs: DataFrame, finals: DataFrame) -> DataFrame:
    """Owned updates ``(job_id, attempt_id, operation, expected_updated_at,
    finished_at, ...)`` with ``operation`` complete, fail or release.

    ``result`` is applied, job_not_found, state_conflict, attempt_mismatch or
    invalid_value. A null ``expected_updated_at`` means "the version read now".
    Of several that pass for one job the earliest applies, the others are
    ``state_conflict``.
    """
    f = finals.alias("f")
    j = jobs.withColumn("job_found", F.lit(True)).alias("j")
    joined = f.join(j, F.col("f.job_id") == F.col("j.job_id"), "left")
    version = F.coalesce(F.col("f.expected_updated_at"), F.col("j.updated_at"))
    no_payload = (
        F.when(F.col("f.operation") == "complete", F.col("f.processing_result").isNull())
        .when(F.col("f.operation") == "fail", X.is_blank(F.col("f.error_reason")))
        .otherwise(F.lit(False))
    )
    result = (
        F.when(F.col("j.job_found").isNull(), JOB_NOT_FOUND)
        .when(F.col("j.status") != S.PROCESSING, "state_conflict")
        .when(F.col("j.active_attempt_id").isNull(), "state_conflict")
        .when(F.col("j.active_attempt_id") != F.col("f.attempt_id"), "attempt_mismatch")
        .when(version != F.col("j.updated_at"), "state_conflict")
        .when((F.col("f.finished_at") < F.col("j.updated_at")) | no_payload, "invalid_value")
        .otherwise("applied")
    )
    judged = joined.select("f.*", result.alias("result"))
    order = ["finished_at", "operation", "processing_result", "error_reason"]
    return _one_winner(judged, order, "state_conflict")


def finalized_rows(jobs: DataFrame, finals: DataFrame) -> DataFrame:
    """New job rows of the applied updates; at most one per job applies."""
    done = finals.where(F.col("result") == "applied").select(
        "job_id", "operation", "finished_at",
        F.col("processing_result").alias("__result"),
        X.non_blank(F.col("error_reason")).alias("__reason"),
    ).distinct()
    op = F.col("operation")
    status = (
        F.when(op == "complete", S.SUCCEEDED).when(op == "fail", S.FAILED).otherwise(S.PENDING)
    )
    return jobs.join(done, "job_id").select(
        "PK", "entity_type", "job_id", status.alias("status"), "request_id", "correlation_id",
        "created_at", F.col("finished_at").alias("updated_at"), "attempts",
        F.lit(None).cast("string").alias("active_attempt_id"),
        F.lit(None).cast("timestamp").alias("active_attempt_started_at"),
        F.lit(None).cast("timestamp").alias(LEASE),
        F.when(op == "complete", F.col("__result")).alias("processing_result"),
        F.when(op == "fail", F.col("__reason")).alias("error_reason"),
    )


def dead_route(as_of, job_found: Column = None) -> Column:
    """Reconciliation decision for a dead-lettered job row."""
    now = TM.as_timestamp(as_of)
    job_found = F.col("job_found") if job_found is None else job_found
    lease = F.col(LEASE)
    eligible = ((F.col("status") == S.PENDING) & (F.col("attempts") >= 1)) | (
        (F.col("status") == S.PROCESSING) & lease.isNotNull() & TM.lease_expired(now, lease)
    )
    return (
        F.when(~job_found, JOB_NOT_FOUND)
        .when(is_terminal(F.col("status")), ALREADY_APPLIED)
        .when(F.coalesce(eligible, F.lit(False)), "dead_recorded")
        .otherwise(CONFLICT)
    )


def mark_dead(jobs: DataFrame, marks: DataFrame) -> DataFrame:
    """Conditional dead marks ``(job_id, expected_status, expected_attempts,
    expected_updated_at, marked_at)``; adds ``result``. Of several that pass for
    one job the earliest applies and the others find its effect."""
    m = marks.alias("m")
    j = jobs.withColumn("job_found", F.lit(True)).alias("j")
    joined = m.join(j, F.col("m.job_id") == F.col("j.job_id"), "left")
    same = (
        (F.col("j.status") == F.col("m.expected_status"))
        & (F.col("j.attempts") == F.col("m.expected_attempts"))
        & (F.col("j.updated_at") == F.col("m.expected_updated_at"))
    )
    fits = (F.col("j.status") == S.PROCESSING) | (
        (F.col("j.status") == S.PENDING) & (F.col("j.attempts") >= 1)
    )
    result = (
        F.when(F.col("j.job_found").isNull(), JOB_NOT_FOUND)
        .when(is_terminal(F.col("j.status")), ALREADY_APPLIED)
        .when(~F.coalesce(same & fits, F.lit(False)), "state_conflict")
        .when(F.col("m.marked_at") < F.col("j.updated_at"), "invalid_value")
        .otherwise("applied")
    )
    return _one_winner(joined.select("m.*", result.alias("result")), ["marked_at"], ALREADY_APPLIED)


def dead_rows(jobs: DataFrame, marks: DataFrame) -> DataFrame:
    done = marks.where(F.col("result") == "applied").select("job_id", "marked_at").distinct()
    return jobs.join(done, "job_id").select(
        "PK", "entity_type", "job_id", F.lit(S.DEAD).alias("status"), "request_id",
        "correlation_id", "created_at", F.col("marked_at").alias("updated_at"), "attempts",
        F.lit(None).cast("string").alias("active_attempt_id"),
        F.lit(None).cast("timestamp").alias("active_attempt_started_at"),
        F.lit(None).cast("timestamp").alias(LEASE),
        F.lit(None).cast("string").alias("processing_result"),
        F.lit(S.RETRIES_EXHAUSTED).alias("error_reason"),
    )


def merge_rows(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Job table with changed rows replaced and new rows added.

    An anti join and a union: a small set of changes is broadcast by its real
    size and the table is not shuffled.
    """
    fresh = changes.select(*S.JOB_COLUMNS)
    kept = jobs.select(*S.JOB_COLUMNS).join(fresh.select("job_id"), "job_id", "left_anti")
    return kept.select(*S.JOB_COLUMNS).unionByName(fresh)


# ---- item decoding and audits -----------------------------------------------


def decode_items(items: DataFrame) -> DataFrame:
    """Flat external items (ISO text timestamps) to typed rows.

    Text that is not a zero-offset timestamp becomes null and is named in
    ``decode_violations``.
    """
    times = ("created_at", "updated_at", "active_attempt_started_at", LEASE)
    out = items
    checks = []
    for name in times:
        parsed = TM.utc_timestamp(F.col(name))
        out = out.withColumn(f"__{name}", parsed)
        checks.append(
            F.when(
                F.col(name).isNotNull() & F.col(f"__{name}").isNull(),
                F.lit(f"{name} is not a UTC timestamp"),
            )
        )
    out = out.withColumn("decode_violations", F.array_compact(F.array(*checks)))
    for name in times:
        out = out.withColumn(name, F.col(f"__{name}")).drop(f"__{name}")
    return out


def encode_items(jobs: DataFrame) -> DataFrame:
    """Typed rows to flat items with ISO-8601 text timestamps."""
    times = ("created_at", "updated_at", "active_attempt_started_at", LEASE)
    out = jobs.withColumn("PK", X.partition_key(F.col("job_id"))).withColumn(
        "entity_type", F.lit(S.ENTITY_TYPE)
    )
    for name in times:
        micro = F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        out = out.withColumn(
            name, F.concat(F.regexp_replace(micro, r"\.000000\z", ""), F.lit("+00:00"))
        )
    return out.select(*S.JOB_COLUMNS)


def audit(jobs: DataFrame) -> DataFrame:
    """Add ``violations``: every broken rule of a stored row, in a fixed order.

    Works on typed rows; run ``decode_items`` first for external items (its
    ``decode_violations`` are included when present).
    """
    status = F.col("status")
    attempt = F.array(
        F.col("active_attempt_id").isNull(),
        F.col("active_attempt_started_at").isNull(),
        F.col(LEASE).isNull(),
    )
    no_attempt = F.forall(attempt, lambda absent: absent)
    partial = F.exists(attempt, lambda absent: absent) & ~no_attempt
    known = status.isin(*S.STATUSES)
    ended_badly = status.isin(S.FAILED, S.DEAD)

    def rule(name: str, broken: Column) -> Column:
        return F.when(F.coalesce(broken, F.lit(True)), F.lit(name))

    checks = [
        rule("entity_type", F.col("entity_type") != S.ENTITY_TYPE),
        rule("job_id_blank", X.is_blank(F.col("job_id"))),
        rule("partition_key", F.col("PK") != X.partition_key(F.col("job_id"))),
        rule("status_unknown", ~known),
        rule("request_id_blank", X.is_blank(F.col("request_id"))),
        rule("correlation_id_blank", X.is_blank(F.col("correlation_id"))),
        rule("created_at_missing", F.col("created_at").isNull()),
        rule("updated_at_missing", F.col("updated_at").isNull()),
        F.when(F.col("updated_at") < F.col("created_at"), F.lit("updated_before_created")),
        rule("attempts_negative", F.col("attempts") < 0),
        rule("attempt_incomplete", partial),
        F.when(
            F.col("active_attempt_id").isNotNull() & X.is_blank(F.col("active_attempt_id")),
            F.lit("attempt_id_blank"),
        ),
        F.when(F.col(LEASE) <= F.col("active_attempt_started_at"), F.lit("lease_not_after_start")),
        F.when(known & (status != S.PROCESSING) & ~no_attempt, F.lit("attempt_not_allowed")),
        F.when((status == S.PROCESSING) & no_attempt, F.lit("attempt_required")),
        F.when(known & (status != S.PENDING) & (F.col("attempts") < 1), F.lit("attempts_required")),
        F.when(
            known & (status != S.SUCCEEDED) & F.col("processing_result").isNotNull(),
            F.lit("result_not_allowed"),
        ),
        F.when((status == S.SUCCEEDED) & F.col("processing_result").isNull(), F.lit("result_required")),
        F.when(
            known & ~ended_badly & F.col("error_reason").isNotNull(), F.lit("reason_not_allowed")
        ),
        F.when(ended_badly & X.is_blank(F.col("error_reason")), F.lit("reason_required")),
    ]
    broken = F.array_compact(F.array(*checks))
    if "decode_violations" in jobs.columns:
        broken = F.concat(F.col("decode_violations"), broken)
    return jobs.withColumn("violations", broken)


def illegal_transitions(
    history: DataFrame, keys: list[str], order: list[str], ts: str, **hot_options
) -> DataFrame:
    """History rows whose step from the previous status is not allowed."""
    stepped = skew.segmented_lag(history, keys, order, ["status"], ts, **hot_options)
    steps = stepped.where(F.col("prev_status").isNotNull() & (F.col("prev_status") != F.col("status")))
    allowed = transitions_table(history.sparkSession).select(
        F.col("from_status").alias("prev_status"), F.col("to_status").alias("status")
    )
    return steps.join(F.broadcast(allowed), ["prev_status", "status"], "left_anti")


def timestamp_regressions(
    history: DataFrame, keys: list[str], order: list[str], updated_at: str, ts: str, **hot_options
) -> DataFrame:
    """Mutations older than the one before them in arrival order."""
    stepped = skew.segmented_lag(history, keys, order, [updated_at], ts, **hot_options)
    return stepped.where(F.col(updated_at) < F.col(f"prev_{updated_at}"))
