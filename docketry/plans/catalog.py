"""Named queries over one scale-factor folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry import schemas as S
from docketry.config import IntakeConfig
from docketry.functions import text as X
from docketry.functions import times as TM
from docketry.operators import (
    changes, extract, history, intake, jobs as J, metrics, objects as O, outcomes as R,
    requests as RQ, skew, telemetry as TE, throttle as TH,
)
from docketry.plans import pipeline as P
from docketry.plans.fixtures import AS_OF, Tables
from docketry.session import cut_lineage, prepare_session, shared_dir
from docketry.sources import files, retention
from docketry.sources.job_store import JobStore
from docketry.streaming import alarms, ownership, redelivery, state

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

# documents are short in the test tables, so the size limit is lowered to bite
CONFIG = IntakeConfig(max_size_bytes=2048)
LEASE_SECONDS = 21_600


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Tables(prepare_session(spark), sf_dir))

    _QUERIES[fn.__name__] = run
    return fn


def all_queries() -> dict[str, Query]:
    from docketry.plans import services  # noqa: F401  registers its queries here

    return dict(_QUERIES)


def wall(col: Column | str) -> Column:
    """Timestamp without zone, as the driver tables store it."""
    return (F.col(col) if isinstance(col, str) else col).cast("timestamp_ntz")


def text_or_none(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit("-"))


# ---- intake -----------------------------------------------------------------


@query
def classify_messages(t: Tables) -> DataFrame:
    parsed = intake.parse_messages(t.messages(), CONFIG)
    job_id = F.get("events", F.lit(0))["job_id"]
    return parsed.select(
        "message_id",
        F.coalesce("error_class", F.lit("ok")).alias("error_class"),
        F.coalesce(job_id, F.lit("-")).alias("job_id"),
    )


@query
def error_class_counts(t: Tables) -> DataFrame:
    """Flagship: parsed messages, joined to jobs, counted by outcome."""
    parsed = P.parse_once(t.messages(), CONFIG)
    events = intake.flatten_events(parsed)
    routed = J.route_claims(events, t.jobs(), AS_OF, P.ARRIVAL, CONFIG)
    accepted = routed.select(F.lit("ok").alias("error_class"), "start_outcome")
    rejected = parsed.where(F.col("error_class").isNotNull()).select(
        "error_class", F.lit("-").alias("start_outcome")
    )
    return accepted.unionByName(rejected).groupBy("error_class", "start_outcome").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def flatten_two_record_messages(t: Tables) -> DataFrame:
    events = intake.flatten_events(intake.parse_messages(t.messages(two_records=True), CONFIG))
    return events.select(
        "message_id", F.col("rec_pos").cast("long").alias("rec_pos"), "job_id", "object_key",
        "object_size", text_or_none("etag").alias("etag"),
    )


@query
def event_model_checks(t: Tables) -> DataFrame:
    """Typed events with damaged fields against the event rules."""
    events = t.messages().selectExpr(
        "message_id",
        "CASE WHEN event_id % 5 = 1 THEN 'ObjectCreated:' ELSE 'ObjectCreated:Put' END AS event_name",
        "CASE WHEN event_id % 7 = 1 THEN ' ' ELSE 'docs' END AS bucket_name",
        "concat('documents/job-', doc_id, '/source.txt') AS object_key",
        "concat('job-', CASE WHEN event_id % 11 = 1 THEN doc_id + 1 ELSE doc_id END) AS job_id",
        "CASE WHEN event_id % 13 = 1 THEN -1L ELSE doc_id END AS object_size",
        "CASE WHEN event_id % 17 = 1 THEN '' END AS etag",
        "CAST(NULL AS STRING) AS sequencer",
        "CAST(NULL AS STRING) AS version_id",
    )
    checked = intake.event_violations(events)
    return checked.select("message_id", F.array_join("violations", ";").alias("violations"))


@query
def latest_by_sequencer(t: Tables) -> DataFrame:
    events = t.messages().selectExpr(
        "message_id", "0 AS rec_pos",
        "concat('documents/job-', doc_id, '/source.txt') AS object_key",
        "lower(hex(event_id * 7919 % 100003)) AS sequencer",
    )
    return intake.latest_by_sequencer(events).select("object_key", "sequencer", "message_id")


# ---- jobs -------------------------------------------------------------------


def _routed(t: Tables) -> DataFrame:
    events = intake.flatten_events(P.parse_once(t.messages(), CONFIG))
    return J.route_claims(events, t.jobs(), AS_OF, P.ARRIVAL, CONFIG)


@query
def claim_route(t: Tables) -> DataFrame:
    return _routed(t).select("message_id", "job_id", "start_outcome")


@query
def claim_winner(t: Tables) -> DataFrame:
    won = _routed(t).where(F.col("start_outcome") == J.CLAIM_ACQUIRED)
    lease = TM.plus_seconds(TM.as_timestamp(AS_OF), CONFIG.lease_seconds)
    attempt = X.opaque_id("attempt", F.col("job_id"), F.col("message_id"), F.col("receive_count").cast("string"))
    return won.select(
        "job_id", "message_id", attempt.alias("attempt_id"), wall(lease).alias("lease_expires_at"),
        (F.col("attempts") + 1).alias("attempts"),
    )


@query
def create_jobs_anti(t: Tables) -> DataFrame:
    made = P.create_jobs(t.requests(), t.jobs(), as_of=AS_OF, config=CONFIG).responses
    return made.select(
        "event_key", "job_id", "request_id", "correlation_id", "outcome",
        F.col("status_code").cast("long").alias("status_code"),
        text_or_none("error_code").alias("error_code"), text_or_none("object_key").alias("object_key"),
    )


@query
def created_rows(t: Tables) -> DataFrame:
    made = P.create_jobs(t.requests(), t.jobs(), as_of=AS_OF, config=CONFIG).created
    return made.select("PK", "job_id", "status", "attempts", "correlation_id", wall("created_at").alias("created_at"))


@query
def insert_conflicts(t: Tables) -> DataFrame:
    """Insert-if-absent with repeated new ids: one insert per id, the rest conflict."""
    rows = t.read("events").selectExpr(
        "concat('job-', event_id % 1500) AS job_id", "concat('corr-', user_id) AS correlation_id", "event_id"
    )
    inserted, conflicts = J.insert_if_absent(rows, t.jobs(), ["event_id"])
    return inserted.withColumn("result", F.lit("inserted")).unionByName(
        conflicts.withColumn("result", F.lit("conflict"))
    )


@query
def job_lookup(t: Tables) -> DataFrame:
    asked = t.read("documents").selectExpr(
        "concat('get-', doc_id) AS event_key",
        "CASE WHEN doc_id % 37 = 0 THEN map('job_id', ' ') WHEN doc_id % 37 = 1 THEN map('other', 'x') "
        "ELSE map('job_id', concat(' job-', doc_id, ' ')) END AS path_parameters",
    )
    found = P.get_jobs(asked, t.jobs(), config=CONFIG)
    return found.select(
        "event_key", text_or_none("job_id").alias("job_id"), text_or_none("status").alias("status"),
        F.coalesce("attempts", F.lit(-1)).alias("attempts"), text_or_none("error_reason").alias("error_reason"),
        "outcome", F.col("status_code").cast("long").alias("status_code"),
    )


@query
def conditional_claims(t: Tables) -> DataFrame:
    claims = t.read("documents").selectExpr(
        "concat('job-', doc_id) AS job_id", "concat('new-', doc_id) AS attempt_id",
        f"TIMESTAMP '{AS_OF}' AS claimed_at",
        f"TIMESTAMP '{AS_OF}' + INTERVAL 300 SECONDS AS lease_expires_at",
        "CASE WHEN doc_id % 12 = 5 THEN TIMESTAMP '2024-01-31 11:00:00' "
        "ELSE TIMESTAMP '2024-01-31 12:00:00' END AS expected_updated_at",
    )
    return J.claim(t.jobs(), claims).select("job_id", "attempt_id", "result")


def _contended_claims(t: Tables) -> DataFrame:
    """Two claims of one version per job, and a repeat of the first."""
    claims = t.read("documents").selectExpr(
        "concat('job-', doc_id) AS job_id", "explode(array('first', 'later', 'first')) AS who",
        "doc_id",
    )
    return claims.selectExpr(
        "job_id", "concat(who, '-', doc_id) AS attempt_id",
        f"TIMESTAMP '{AS_OF}' + CASE WHEN who = 'later' THEN INTERVAL 1 SECOND ELSE INTERVAL 0 SECOND END AS claimed_at",
        f"TIMESTAMP '{AS_OF}' + INTERVAL 300 SECONDS AS lease_expires_at",
        "TIMESTAMP '2024-01-31 12:00:00' AS expected_updated_at",
    )


@query
def contended_claims(t: Tables) -> DataFrame:
    return J.claim(t.jobs(), _contended_claims(t)).select("job_id", "attempt_id", "result")


@query
def contended_claim_rows(t: Tables) -> DataFrame:
    rows = J.claimed_rows(t.jobs(), J.claim(t.jobs(), _contended_claims(t)))
    return J.merge_rows(t.jobs(), rows).select("job_id", "status", text_or_none("active_attempt_id").alias("active_attempt_id"))


@query
def claimed_job_rows(t: Tables) -> DataFrame:
    claims = t.read("documents").selectExpr(
        "concat('job-', doc_id) AS job_id", "concat('new-', doc_id) AS attempt_id",
        f"TIMESTAMP '{AS_OF}' AS claimed_at",
        f"TIMESTAMP '{AS_OF}' + INTERVAL 300 SECONDS AS lease_expires_at",
        "TIMESTAMP '2024-01-31 12:00:00' AS expected_updated_at",
    )
    rows = J.claimed_rows(t.jobs(), J.claim(t.jobs(), claims))
    return rows.select(
        "job_id", "status", "attempts", "active_attempt_id",
        wall("active_attempt_lease_expires_at").alias("lease_expires_at"),
    )


def _finals(t: Tables) -> DataFrame:
    return t.read("documents").selectExpr(
        "concat('job-', doc_id) AS job_id",
        "CASE WHEN doc_id % 4 = 3 THEN 'stale' ELSE concat('attempt-', doc_id) END AS attempt_id",
        "CASE doc_id % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'fail' ELSE 'release' END AS operation",
        "CASE WHEN doc_id % 9 = 4 THEN TIMESTAMP '2024-01-31 11:00:00' END AS expected_updated_at",
        "CASE WHEN doc_id % 8 = 6 THEN TIMESTAMP '2024-01-31 10:00:00' "
        f"ELSE TIMESTAMP '{AS_OF}' END AS finished_at",
        "CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 2 THEN '{\"ok\":true}' END AS processing_result",
        "CASE WHEN doc_id % 3 = 1 THEN CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE ' document_not_found ' END END "
        "AS error_reason",
    )


@query
def conditional_finalize(t: Tables) -> DataFrame:
    return J.finalize(t.jobs(), _finals(t)).select("job_id", "operation", "result")


def _contended_finals(t: Tables) -> DataFrame:
    """Each update, and a later release of the same attempt."""
    late = _finals(t).withColumn("operation", F.lit("release")).withColumn(
        "finished_at", F.lit(f"{AS_OF}").cast("timestamp") + F.expr("INTERVAL 1 SECOND")
    )
    return _finals(t).withColumn("who", F.lit("first")).unionByName(late.withColumn("who", F.lit("later")))


@query
def contended_finalize(t: Tables) -> DataFrame:
    return J.finalize(t.jobs(), _contended_finals(t)).select("job_id", "who", "result")


@query
def contended_final_rows(t: Tables) -> DataFrame:
    changed = J.finalized_rows(t.jobs(), J.finalize(t.jobs(), _contended_finals(t)))
    return J.merge_rows(t.jobs(), changed).select("job_id", "status")


@query
def finalized_job_rows(t: Tables) -> DataFrame:
    changed = J.finalized_rows(t.jobs(), J.finalize(t.jobs(), _finals(t)))
    merged = J.merge_rows(t.jobs(), changed)
    return merged.select(
        "job_id", "status", "attempts", text_or_none("active_attempt_id").alias("active_attempt_id"),
        text_or_none("processing_result").alias("processing_result"),
        text_or_none("error_reason").alias("error_reason"), wall("updated_at").alias("updated_at"),
    )


@query
def conditional_dead_marks(t: Tables) -> DataFrame:
    marks = t.read("documents").selectExpr(
        "concat('job-', doc_id) AS job_id",
        "CASE WHEN doc_id % 10 IN (6, 7) THEN 'processing' ELSE 'pending_upload' END AS expected_status",
        "CASE WHEN doc_id % 10 >= 5 THEN 1L ELSE 0L END AS expected_attempts",
        "CASE WHEN doc_id % 9 = 4 THEN TIMESTAMP '2024-01-31 11:00:00' "
        "ELSE TIMESTAMP '2024-01-31 12:00:00' END AS expected_updated_at",
        f"TIMESTAMP '{AS_OF}' AS marked_at",
    )
    return J.mark_dead(t.jobs(), marks).select("job_id", "result")


@query
def contended_dead_marks(t: Tables) -> DataFrame:
    """Two marks of one version per job."""
    marks = t.read("documents").selectExpr(
        "concat('job-', doc_id) AS job_id",
        "CASE WHEN doc_id % 10 IN (6, 7) THEN 'processing' ELSE 'pending_upload' END AS expected_status",
        "CASE WHEN doc_id % 10 >= 5 THEN 1L ELSE 0L END AS expected_attempts",
        "TIMESTAMP '2024-01-31 12:00:00' AS expected_updated_at",
        f"explode(array(TIMESTAMP '{AS_OF}', TIMESTAMP '{AS_OF}' + INTERVAL 1 SECOND)) AS marked_at",
    )
    return J.mark_dead(t.jobs(), marks).select("job_id", wall("marked_at").alias("marked_at"), "result")


def _damaged(t: Tables) -> DataFrame:
    items = t.jobs().select("doc_id", *S.JOB_COLUMNS)
    encoded = J.encode_items(items).withColumn(
        "doc_id", F.regexp_extract("job_id", r"([0-9]+)\z", 1).cast("long")
    )
    d = F.col("doc_id") % 16
    return (
        encoded.withColumn("entity_type", F.when(d == 0, "other").otherwise(F.col("entity_type")))
        .withColumn("PK", F.when(d == 1, "JOB#x").otherwise(F.col("PK")))
        .withColumn("status", F.when(d == 2, "lost").otherwise(F.col("status")))
        .withColumn("request_id", F.when(d == 3, " \t").otherwise(F.col("request_id")))
        .withColumn("updated_at", F.when(d == 4, "2024-01-31T12:00:00").otherwise(F.col("updated_at")))
        .withColumn("attempts", F.when(d == 5, F.lit(-1)).otherwise(F.col("attempts")))
        .withColumn("active_attempt_id", F.when(d == 6, "a").otherwise(F.col("active_attempt_id")))
        .withColumn(
            "active_attempt_lease_expires_at",
            F.when(d == 6, F.lit(None)).otherwise(F.col("active_attempt_lease_expires_at")),
        )
        .withColumn(
            "created_at",
            F.when(d == 7, "2024-01-31T13:00:00+00:00")
            .when(d == 8, "2024-01-31T00:00:00+01:00")
            .otherwise(F.col("created_at")),
        )
        .withColumn(
            "error_reason", F.when(d == 9, "why").when(d == 10, " ").otherwise(F.col("error_reason"))
        )
    )


@query
def job_audit(t: Tables) -> DataFrame:
    audited = J.audit(J.decode_items(_damaged(t)))
    return audited.select("job_id", F.array_join("violations", ";").alias("violations"))


@query
def item_encoding(t: Tables) -> DataFrame:
    encoded = J.encode_items(t.jobs())
    return encoded.select(
        "PK", "status", "updated_at", text_or_none("active_attempt_lease_expires_at").alias("lease_expires_at")
    )


@query
def latest_state(t: Tables) -> DataFrame:
    newest = J.latest_state(t.status_history(), ["job_id"], ["ts", "event_id"])
    return newest.select("job_id", "event_id", "status")


@query
def illegal_transitions(t: Tables) -> DataFrame:
    bad = J.illegal_transitions(t.status_history(), ["job_id"], ["ts", "event_id"], "ts")
    return bad.select("job_id", "event_id", "prev_status", "status")


@query
def timestamp_regressions(t: Tables) -> DataFrame:
    bad = J.timestamp_regressions(t.status_history(), ["job_id"], ["ts", "event_id"], "updated_at", "ts")
    return bad.select(
        "job_id", "event_id", wall("updated_at").alias("updated_at"),
        wall("prev_updated_at").alias("prev_updated_at"),
    )


@query
def history_fold(t: Tables) -> DataFrame:
    final = history.replay(t.history(), ["ts", "event_id"], lease_seconds=LEASE_SECONDS)
    return final.select(
        "job_id", "status", "attempts", wall("updated_at").alias("updated_at"),
        "active", "applied", "deliveries",
    )


@query
def history_fold_hot(t: Tables) -> DataFrame:
    """The replay with a third of all deliveries on one job, cut over 24 partitions."""
    rows = t.history().withColumn(
        "job_id", F.when(F.regexp_extract("job_id", "([0-9]+)", 1).cast("long") % 3 == 0, "hot").otherwise(F.col("job_id"))
    )
    # crashes and releases go on for the whole month; jobs with other ends are short
    rows = rows.withColumn("result", F.when((F.col("job_id") == "hot") & (F.col("result") != "release"), "crash").otherwise(F.col("result")))
    final = history.replay_sorted(rows, ["ts", "event_id"], lease_seconds=LEASE_SECONDS, parts=24)
    return final.select(
        "job_id", "status", "attempts", wall("updated_at").alias("updated_at"),
        "active", "applied", "deliveries",
    )


# ---- objects and extraction ---------------------------------------------------


@query
def object_checks(t: Tables) -> DataFrame:
    events = intake.flatten_events(intake.parse_messages(t.messages(), CONFIG))
    loaded = O.load_documents(events, t.objects(), CONFIG)
    return loaded.select(
        "message_id", "job_id", F.coalesce("object_error", F.lit("usable")).alias("object_error"),
        F.coalesce(F.octet_length("document_text"), F.lit(-1)).cast("long").alias("text_bytes"),
    )


@query
def extract_rules(t: Tables) -> DataFrame:
    rows = t.rule_texts().withColumn("s", X.strip(F.col("document_text")))
    result = extract.rule_result(F.col("s"), F.col("correlation_id"), F.col("attempt_id"))
    return rows.withColumn("r", result).select(
        "doc_id", "r.document_type", "r.summary",
        F.col("r.key_fields.character_count").cast("long").alias("character_count"),
        F.col("r.key_fields.word_count").cast("long").alias("word_count"),
        "r.confidence", "r.requires_human_review",
    )


@query
def provider_prompts(t: Tables) -> DataFrame:
    prompt = X.fenced_prompt(F.col("document_text"))
    checked = t.rule_texts().withColumn("request_error", extract.request_error())
    return checked.select(
        "doc_id", F.md5(prompt).alias("prompt_md5"), text_or_none("request_error").alias("request_error")
    )


@query
def response_validation(t: Tables) -> DataFrame:
    v = extract.validate_responses(t.responses())
    return v.select(
        "doc_id", "verdict", text_or_none("invalid_step").alias("invalid_step"), "severity", "retryable",
        text_or_none("result_json").alias("result_json"), "input_tokens", "output_tokens",
        text_or_none("stop_reason").alias("stop_reason"),
    )


@query
def provider_error_taxonomy(t: Tables) -> DataFrame:
    failed = t.telemetry().where(F.col("provider_error_code").isNotNull())
    known = extract.classify_provider_errors(failed.select("provider_error_code"), "provider_error_code")
    return known.groupBy("provider_error_code", "category", "severity", "retryable").agg(
        F.count(F.lit(1)).alias("n")
    )


# ---- composite jobs -----------------------------------------------------------


def _record_view(records: DataFrame) -> DataFrame:
    return records.select(
        "message_id", F.coalesce("rec_pos", F.lit(-1)).cast("long").alias("rec_pos"),
        text_or_none("job_id").alias("job_id"), text_or_none("start_outcome").alias("start_outcome"),
        text_or_none("outcome").alias("outcome"), text_or_none("failure_reason").alias("failure_reason"),
        text_or_none("retry_reason").alias("retry_reason"), text_or_none("error_code").alias("error_code"),
        "failed",
    )


def _processed(t: Tables, two_records: bool = False) -> P.UploadResult:
    return P.process_uploads(
        t.messages(two_records), t.jobs(), t.objects(), as_of=AS_OF, config=CONFIG, plan=t.provider_plan()
    )


@query
def process_batch_outcomes(t: Tables) -> DataFrame:
    return _record_view(_processed(t).records)


@query
def process_captured_responses(t: Tables) -> DataFrame:
    """Captured responses answer the attempts; every 17th attempt has none."""
    parsed = P.parse_once(t.messages(), CONFIG)
    events = intake.flatten_events(parsed)
    attempt = X.opaque_id("attempt", F.col("job_id"), F.col("message_id"), F.col("receive_count").cast("string"))
    attempts = events.select(
        attempt.alias("attempt_id"), F.regexp_extract("job_id", r"([0-9]+)\z", 1).cast("long").alias("doc_id")
    )
    path = f"{shared_dir(t.spark)}/captured-{uuid.uuid4().hex}"
    captured = attempts.where("doc_id % 17 <> 5").join(t.responses().drop("attempt_id"), "doc_id")
    captured.select("attempt_id", "response_json", "error_code").write.parquet(path)
    run = P.process_parsed(
        parsed, t.jobs(), t.objects(), as_of=AS_OF, config=CONFIG,
        extractor=extract.captured_extractor(files.captured_responses(t.spark, path)),
    )
    return _record_view(run.records)


@query
def process_two_record_messages(t: Tables) -> DataFrame:
    return _record_view(_processed(t, two_records=True).records)


@query
def process_long_messages(t: Tables) -> DataFrame:
    """Messages of 200 records among those of single purchases."""
    single = t.messages().join(t.read("events").where("event_type = 'purchase'").select("event_id"), "event_id")
    longer = t.long_messages()
    run = P.process_uploads(
        single.select(*longer.columns).unionByName(longer), t.jobs(), t.objects(), as_of=AS_OF, config=CONFIG, plan=t.provider_plan()
    )
    return _record_view(run.records)


@query
def processed_job_table(t: Tables) -> DataFrame:
    return _processed(t).jobs.select(
        "job_id", "status", "attempts", text_or_none("error_reason").alias("error_reason"),
        wall("updated_at").alias("updated_at"),
        F.col("processing_result").isNotNull().alias("has_result"),
        F.col("active_attempt_id").isNotNull().alias("has_attempt"),
    )


@query
def batch_summary(t: Tables) -> DataFrame:
    parsed = intake.parse_messages(t.messages(), CONFIG)
    verdicts = parsed.withColumn("failed", F.col("error_class").isNotNull())
    return R.batch_summary(verdicts)


@query
def failed_message_ids(t: Tables) -> DataFrame:
    """Failures with repeated message ids: one row per id at its first position."""
    rows = t.read("events").selectExpr(
        "concat('b-', event_id div 100) AS batch_id", "event_id AS msg_pos",
        "concat('m-', event_id % 30) AS message_id", "event_type = 'error' AS failed",
    )
    return R.failed_message_ids(rows)


@query
def broken_batches(t: Tables) -> DataFrame:
    rows = t.read("events").selectExpr(
        "concat('b-', event_id div 10) AS batch_id", "event_id AS msg_pos",
        "CASE WHEN event_id % 33 = 7 THEN ' ' ELSE concat('m-', event_id) END AS message_id",
    )
    return R.reject_broken_batches(rows, CONFIG).select("msg_pos", "batch_state")


@query
def stop_after_failure(t: Tables) -> DataFrame:
    records = t.read("events").selectExpr(
        "'all' AS batch_id", "event_id div 8 AS msg_pos", "event_id % 8 AS rec_pos",
        "event_type = 'error' AS failed",
    )
    return R.stop_after_failure(records).select("msg_pos", "rec_pos", "failed", "attempted")


@query
def redrive_split(t: Tables) -> DataFrame:
    """Receive count as the rank within (user, type); errors fail."""
    events = t.read("events").select("event_id", "user_id", "event_type", F.col("ts").alias("sent_ts"))
    ranked = skew.segmented_row_number(
        events, ["user_id", "event_type"], ["sent_ts", "event_id"], "sent_ts", "receive_count"
    ).withColumn("failed", F.col("event_type") == "error")
    routed = R.route_failed(ranked, CONFIG)
    return routed.select(
        "event_id", F.col("receive_count").cast("long").alias("receive_count"), "destination",
        wall(F.coalesce("available_at", F.col("sent_ts").cast("timestamp"))).alias("available_at"),
    )


@query
def receive_counts(t: Tables) -> DataFrame:
    rows = t.read("events").selectExpr("concat('m-', event_id % 700) AS message_id")
    return R.receive_counts(rows)


@query
def reconcile_dead(t: Tables) -> DataFrame:
    done = P.reconcile_dead_letters(t.messages(two_records=True), t.jobs(), as_of=AS_OF, config=CONFIG)
    return done.records.select(
        "message_id", F.coalesce("rec_pos", F.lit(-1)).cast("long").alias("rec_pos"),
        text_or_none("job_id").alias("job_id"), "outcome", "attempted", "failed",
    )


@query
def dead_job_rows(t: Tables) -> DataFrame:
    done = P.reconcile_dead_letters(t.messages(), t.jobs(), as_of=AS_OF, config=CONFIG)
    return done.changes.select("job_id", "status", "error_reason", "attempts", wall("updated_at").alias("updated_at"))


@query
def outcome_invariants(t: Tables) -> DataFrame:
    rows = t.telemetry().selectExpr(
        "event_id", "outcome",
        "CASE WHEN event_id % 5 < 3 THEN processing_attempt_id END AS attempt_id",
        "CASE WHEN event_id % 2 = 0 THEN '{}' END AS result_json", "failure_reason",
    )
    return R.outcome_violations(rows).select("event_id", F.array_join("violations", ";").alias("violations"))


# ---- telemetry, metrics and alarms ------------------------------------------------


@query
def telemetry_allowlist(t: Tables) -> DataFrame:
    raw = t.spread("events", "event_id").selectExpr(
        "event_id", "CAST(ts AS TIMESTAMP) AS ts", "'processor' AS component", "'info' AS level",
        "CASE WHEN event_id % 13 = 0 THEN ' ' ELSE concat(' ', event_type, ' ') END AS event_name",
        "concat('{\"operation\":\"extract\",\"duration_ms\":', event_id, ',\"job_id\":{\"nested\":1},"
        "\"outcome\":null,\"retryable\":true,\"provider_latency_ms\":', "
        "CASE WHEN event_id % 6 = 0 THEN '1e400' ELSE '2.5' END, ',\"props\":', props, '}') AS fields",
    )
    kept = TE.project_events(raw, "intake")
    return kept.select(
        "event_id", "event_name", "service",
        F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("kept"),
        F.col("fields")["duration_ms"].alias("duration_ms"), "dropped_field_count",
    )


@query
def severity_by_status(t: Tables) -> DataFrame:
    code = F.col("status_code")
    levels = t.telemetry().select(
        F.when(F.col("event_id") % 50 == 0, 150).otherwise(code).alias("status_code")
    )
    return levels.groupBy(
        F.col("status_code").cast("long").alias("status_code"),
        F.coalesce(RQ.severity(code), F.lit("none")).alias("severity"),
        RQ.valid_status(code).alias("valid_status"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def union_components(t: Tables) -> DataFrame:
    log = t.telemetry().drop("component")
    parts = {
        "create_job": log.where("event_id % 4 = 0").select("event_id", "status_code"),
        "get_job": log.where("event_id % 4 = 1").select("event_id", "status_code", "job_id"),
        "processor": log.where("event_id % 4 = 2").select("event_id", "job_id", "outcome"),
        "reconciler": log.where("event_id % 4 = 3").select("event_id", "job_id", "failure_reason"),
    }
    return TE.union_components(parts).select(
        "event_id", "component", F.coalesce("status_code", F.lit(-1)).cast("long").alias("status_code"),
        text_or_none("job_id").alias("job_id"), text_or_none("outcome").alias("outcome"),
        text_or_none("failure_reason").alias("failure_reason"),
    )


@query
def metric_sums(t: Tables) -> DataFrame:
    return metrics.request_sums(t.telemetry()).withColumn("period_start", wall("period_start"))


@query
def metric_max(t: Tables) -> DataFrame:
    return metrics.latency_maximum(t.telemetry(), 60).withColumn("period_start", wall("period_start"))


@query
def metric_p95(t: Tables) -> DataFrame:
    return metrics.latency_p95(t.telemetry()).withColumn("period_start", wall("period_start"))


@query
def metric_p95_daily(t: Tables) -> DataFrame:
    return metrics.latency_p95(t.telemetry(), 86_400).withColumn("period_start", wall("period_start"))


def _deliveries(t: Tables) -> DataFrame:
    return t.read("events").selectExpr(
        "event_type AS queue", "CAST(ts AS TIMESTAMP) AS sent_ts",
        "CASE WHEN event_id % 11 <> 0 THEN CAST(ts AS TIMESTAMP) + make_dt_interval(0, 0, 0, event_id % 1800) END "
        "AS received_ts",
        "CASE WHEN event_id % 11 <> 0 AND event_id % 7 <> 0 THEN "
        "CAST(ts AS TIMESTAMP) + make_dt_interval(0, 0, 0, event_id % 1800 + event_id % 300) END AS done_ts",
    )


@query
def queue_gauges(t: Tables) -> DataFrame:
    return metrics.gauges_at(_deliveries(t), TM.as_timestamp("2024-01-20 12:00:00"))


@query
def queue_depth_series(t: Tables) -> DataFrame:
    return metrics.queue_depth(_deliveries(t)).withColumn("period_start", wall("period_start"))


# the reports cover January 2024, whatever the data holds of it
_FIRST, _LAST = "2024-01-01 00:00:00", "2024-01-31 23:59:00"


@query
def queue_age_alarm(t: Tables) -> DataFrame:
    """Oldest age per minute and queue, alarm at 300 s in 2 of 3 minutes."""
    first, last = TM.as_timestamp(_FIRST), TM.as_timestamp(_LAST)
    points = metrics.oldest_age(_deliveries(t), until=last).withColumnRenamed("oldest_age_s", "value")
    states = metrics.evaluate_alarm(
        points, ["queue"], 300.0, seconds=60, datapoints=2, evaluation_periods=3, start=first, end=last
    )
    moved = metrics.state_changes(states, ["queue"])
    return moved.select("queue", wall("period_start").alias("period_start"), "state", "previous_state")


def _event_points(t: Tables) -> DataFrame:
    start = metrics.period_start(F.col("ts"), 300)
    flags = metrics.event_flags()
    sums = t.telemetry().groupBy(start.alias("period_start")).agg(
        *[F.count_if(cond).cast("double").alias(name) for name, cond in flags.items()]
    )
    pairs = F.array(
        *[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in flags]
    )
    return sums.select("period_start", F.inline(pairs)).where("value > 0")


def _age_points(deliveries: DataFrame) -> DataFrame:
    ages = metrics.oldest_age(deliveries, until=TM.as_timestamp(_LAST))
    return ages.select(
        "period_start", F.lit("queue_oldest_age").alias("metric"), F.col("oldest_age_s").cast("double").alias("value"), "queue"
    )


def _points(t: Tables) -> DataFrame:
    # one series for all queues: the oldest message of any, also one that is never received
    ages = _age_points(_deliveries(t)).groupBy("period_start", "metric").agg(F.max("value").alias("value"))
    return _event_points(t).unionByName(ages)


def _alarm_states(t: Tables) -> DataFrame:
    return metrics.evaluate_alarms(_points(t), TM.as_timestamp(_FIRST), TM.as_timestamp(_LAST))


@query
def alarm_changes(t: Tables) -> DataFrame:
    """Every change of state of the nine alarms, back to OK included."""
    moved = metrics.state_changes(_alarm_states(t), ["alarm"])
    return moved.select("alarm", wall("period_start").alias("period_start"), "state", "previous_state")


@query
def alarm_states(t: Tables) -> DataFrame:
    """All nine alarm definitions over the metric points; periods and ALARM periods per alarm."""
    return _alarm_states(t).groupBy("alarm").agg(
        F.count(F.lit(1)).alias("periods"), F.count_if(F.col("state") == "ALARM").alias("in_alarm")
    )


def _alarm_states_by_queue(t: Tables) -> DataFrame:
    points = _event_points(t).unionByName(_age_points(_deliveries(t)), allowMissingColumns=True)
    return metrics.evaluate_alarms(points, TM.as_timestamp(_FIRST), TM.as_timestamp(_LAST), ("queue",))


@query
def alarm_changes_by_queue(t: Tables) -> DataFrame:
    """Changes of the nine alarms; the backlog of each queue is a series, messages never received included."""
    moved = metrics.state_changes(_alarm_states_by_queue(t), ["alarm", "queue"])
    return moved.select("alarm", "queue", wall("period_start").alias("period_start"), "state", "previous_state")


@query
def alarm_states_by_queue(t: Tables) -> DataFrame:
    """Periods and ALARM periods of every series of ``alarm_changes_by_queue``."""
    return _alarm_states_by_queue(t).groupBy("alarm", "queue").agg(
        F.count(F.lit(1)).alias("periods"), F.count_if(F.col("state") == "ALARM").alias("in_alarm")
    )


_LOG_COLUMNS = ("event_id", "component", "event_name", "outcome", "correlation_id", "job_id")


def _log_view(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(*_LOG_COLUMNS, wall("ts").alias("ts"), *extra)


@query
def search_failures_top100(t: Tables) -> DataFrame:
    return _log_view(TE.newest_failures(t.telemetry(), 100))


@query
def search_correlation(t: Tables) -> DataFrame:
    return _log_view(TE.by_correlation(t.telemetry(), "corr-7"))


@query
def search_terminal_outcomes(t: Tables) -> DataFrame:
    return _log_view(TE.terminal_outcomes(t.telemetry()), "failure_reason")


@query
def search_provider_failures(t: Tables) -> DataFrame:
    return _log_view(TE.provider_failures(t.telemetry()))


@query
def search_dead_reconciliations(t: Tables) -> DataFrame:
    return _log_view(TE.dead_reconciliations(t.telemetry()))


@query
def search_trace(t: Tables) -> DataFrame:
    return _log_view(TE.trace(t.telemetry(), "corr-7"), "stage")


@query
def outcome_breakdown(t: Tables) -> DataFrame:
    return TE.outcome_breakdown(t.telemetry()).select(
        "component", "event_name", "outcome", text_or_none("failure_reason").alias("failure_reason"),
        "n", wall("last_ts").alias("last_ts"),
    )


@query
def pipeline_telemetry(t: Tables) -> DataFrame:
    """What the two jobs tell about themselves: events by name, level and outcome."""
    uploads = _processed(t)
    dead = P.reconcile_dead_letters(t.messages(two_records=True), t.jobs(), as_of=AS_OF, config=CONFIG)
    events = TE.upload_events(uploads.records, uploads.messages, as_of=AS_OF).unionByName(
        TE.reconciliation_events(dead.records, dead.messages, as_of=AS_OF)
    )
    field = lambda name: F.coalesce(F.col("fields")[name], F.lit("-")).alias(name)
    return events.groupBy(
        "component", "event_name", "level", field("outcome"), field("error_code"), field("failure_reason")
    ).agg(
        F.count(F.lit(1)).alias("n"), F.count("fields.processing_attempt_id").alias("attempts"),
        F.coalesce(F.sum(F.col("fields.failed_record_count").cast("long")), F.lit(0)).alias("failed_records"),
    )


@query
def operations_report(t: Tables) -> DataFrame:
    """Traffic, latency, errors, tokens, queues, alarms and newest failures of January 2024."""
    report = metrics.operations_report(
        t.telemetry(), _deliveries(t), start=TM.as_timestamp(_FIRST), end=TM.as_timestamp(_LAST)
    )
    return report.withColumn("period_start", wall("period_start"))


@query
def throttled_requests(t: Tables) -> DataFrame:
    """The request log, played 2500 times as fast, against the limits of its routes; cuts fall inside both."""
    judged = TH.throttle(t.fast_requests(), S.ROUTE_LIMITS, parts=32)
    return judged.select("event_id", "route", "throttled")


# ---- change sets, redaction, retention ------------------------------------------------


@query
def change_set(t: Tables) -> DataFrame:
    return changes.change_set(*t.snapshots())


@query
def change_counts(t: Tables) -> DataFrame:
    return changes.action_counts(changes.change_set(*t.snapshots()))


@query
def change_fingerprint(t: Tables) -> DataFrame:
    rows = changes.change_set(*t.snapshots())
    return changes.fingerprint(rows, F.concat_ws("|", "key", "entity", "action"))


@query
def change_report(t: Tables) -> DataFrame:
    return changes.report_lines(changes.change_set(*t.snapshots()))


@query
def redact_documents(t: Tables) -> DataFrame:
    return t.spread("documents", "doc_id").select("doc_id", X.redact(F.col("text")).alias("redacted"))


@query
def retained(t: Tables) -> DataFrame:
    kept = retention.retained(t.read("events"), "ts", "logs", "2024-01-31 00:00:00")
    return kept.select("event_id", "ts", "event_type")


# ---- streams and file sources (no SQL counterpart) ---------------------------------------


@query
def stream_state_machine(t: Tables) -> DataFrame:
    """The events as a file stream through the keyed state machine."""
    root = f"{shared_dir(t.spark)}/run-{uuid.uuid4().hex}"
    t.history().repartitionByRange(4, "ts").write.parquet(f"{root}/in")
    state.use_rocksdb(t.spark)
    source = t.spark.readStream.schema(t.history().schema).parquet(f"{root}/in")
    run = (
        state.run_state_machine(source, lease_seconds=LEASE_SECONDS)
        .writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    out = t.spark.read.parquet(f"{root}/out")
    return out.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("deliveries"),
        F.max("attempts").alias("attempts"),
        F.count_if(F.col("outcome") == "processing_already_active").alias("active"),
        F.count_if(F.col("outcome") == "effect_already_applied").alias("applied"),
    )


@query
def job_store_versions(t: Tables) -> DataFrame:
    """A store after each of five versions, compacted on the way, and ids looked up in the last one."""
    store = JobStore(t.spark, f"{shared_dir(t.spark)}/store-{uuid.uuid4().hex}", compact_after=2, buckets=16)
    jobs = t.jobs()
    store.apply(jobs)
    for n, status, condition in (
        (2, "processing", "doc_id % 3 = 0"), (3, "succeeded", "doc_id % 6 = 0"), (4, "failed", "doc_id % 4 = 1"), (5, "dead", "doc_id % 50 = 7"),
    ):
        changed = jobs.where(condition).withColumns({"status": F.lit(status), "attempts": F.lit(n).cast("long")})
        store.apply(changed, batch=n, expected=n - 1)
    seen = [store.read(n).withColumn("version", F.lit(n)) for n in range(1, 6)]
    asked = t.read("documents").where("doc_id % 100 < 10").select(F.concat(F.lit("job-"), F.col("doc_id")).alias("job_id"))
    seen.append(store.lookup(asked).withColumn("version", F.lit(-1)))
    out = seen[0]
    for one in seen[1:]:
        out = out.unionByName(one)
    return out.select("version", "job_id", "status", "attempts")


@query
def redelivered_batches(t: Tables) -> DataFrame:
    """Every event as a message whose handler fails a number of times: both queues, then quarantine.

    Seven clocks, each a run of the delay queue; answers take a minute.
    """
    fails = F.when(F.col("n") % 6 == 0, F.floor(F.col("n") / 6) % 8).otherwise(0)
    n = F.substring("message_id", 3, 20).cast("long")
    earlier = F.when(F.col("level") == redelivery.DEAD_LETTER, CONFIG.max_receives).otherwise(0)

    def handle(deliveries: DataFrame, clock) -> DataFrame:
        return deliveries.withColumn("n", n).select(
            "message_id", "level", "receive_count", (F.col("receive_count") + earlier > fails).alias("ok"),
            TM.plus_seconds(F.col("at"), 60).alias("ts"),
        )

    clocks = [f"2024-02-01 00:{minute}:00" for minute in ("02", 14, 26, 38, 41, 44, 47)]
    root = f"{shared_dir(t.spark)}/redelivery-{uuid.uuid4().hex}"
    outcomes = redelivery.redeliver(t.spark, t.queued(), handle, root, clocks, CONFIG)
    settled = F.col("kind").isin("acknowledged", redelivery.QUARANTINE)
    last = F.first(F.when(settled, F.struct("kind", "level", "receive_count", "at")), ignorenulls=True)
    return outcomes.groupBy("message_id").agg(
        F.count_if(F.col("kind") == "delivery").alias("deliveries"), F.count_if(F.col("kind") == "retry").alias("retries"),
        last.alias("last"),
    ).select(
        "message_id", "deliveries", "retries", F.col("last.kind").alias("destination"), F.col("last.level").alias("level"),
        F.col("last.receive_count").alias("receive_count"), wall("last.at").alias("settled_at"),
    )


@query
def alarm_stream_states(t: Tables) -> DataFrame:
    """The alarms of ``alarm_states_by_queue`` from keyed state, over four triggers; an end of the clock closes the month."""
    root = f"{shared_dir(t.spark)}/alarms-{uuid.uuid4().hex}"
    state.use_rocksdb(t.spark)
    points = _event_points(t).unionByName(_age_points(_deliveries(t)), allowMissingColumns=True).withColumnRenamed("queue", "dim")
    clock = t.spark.range(1).select(
        TM.plus_seconds(TM.as_timestamp(_LAST), 60).alias("period_start"), F.lit("clock").alias("metric"), F.lit(0.0).alias("value"),
        F.lit(None).cast("string").alias("dim"),
    )
    names = [f.split()[0] for f in alarms.POINTS.split(", ")]
    length = F.when(F.col("metric") == "queue_oldest_age", 60).when(F.col("metric") == "clock", 0).otherwise(300)
    closed = F.col("period_start") + F.make_dt_interval(secs=length)
    points = cut_lineage(points.unionByName(clock).withColumn("closed_at", closed).select(*names))
    for first, last in ((1, 8), (8, 16), (16, 24), (24, 40)):
        days = F.datediff("closed_at", F.lit("2024-01-01").cast("date")) + 1
        points.where((days >= first) & (days < last)).write.mode("append").parquet(f"{root}/in")
        source = t.spark.readStream.schema(alarms.POINTS).parquet(f"{root}/in")
        alarms.start_alarm_changes(source, root, f"{root}/checkpoint").awaitTermination()
    moved = t.spark.read.parquet(f"{root}/alarm_changes").where("state <> 'late'")
    rules = metrics.alarms_table(t.spark).select("alarm", "metric", "period")
    series = rules.join(points.select("metric", F.coalesce("dim", F.lit("")).alias("queue")).distinct(), "metric", "left").select(
        "alarm", F.coalesce("queue", F.lit("")).alias("queue"), "period"
    )
    first, last = (F.unix_seconds(TM.as_timestamp(x)) for x in (_FIRST, _LAST))
    by_time = Window.partitionBy("alarm", "dim").orderBy("period_start")
    spans = moved.withColumn("until", F.lead("period_start").over(by_time)).where("state = 'ALARM'")
    on = spans.groupBy("alarm", F.col("dim").alias("queue")).agg(
        F.sum(F.coalesce(F.unix_seconds("until") - F.unix_seconds("period_start"), F.lit(0))).alias("closed"),
        F.max(F.when(F.col("until").isNull(), F.unix_seconds("period_start"))).alias("open"),
    )
    end = F.floor(last / F.col("period")) * F.col("period") + F.col("period")
    seconds = F.coalesce("closed", F.lit(0)) + F.coalesce(end - F.col("open"), F.lit(0))
    return series.join(on, ["alarm", "queue"], "left").select(
        "alarm", "queue", ((end - first) / F.col("period")).cast("long").alias("periods"),
        (seconds / F.col("period")).cast("long").alias("in_alarm"),
    )


@query
def stream_owner_finalize(t: Tables) -> DataFrame:
    """Claims and finalizations over three triggers: owners, takeovers, stale and late rows, ended leases."""
    root = f"{shared_dir(t.spark)}/owners-{uuid.uuid4().hex}"
    state.use_rocksdb(t.spark)
    events = t.ownership_events()
    days = [f"{day} 00:00:00" for day in ("2024-01-01", "2024-01-11", "2024-01-21", "2025-01-01")]
    for first, last in zip(days, days[1:]):
        arrived = F.col("arrived")
        events.where((arrived >= TM.as_timestamp(first)) & (arrived < TM.as_timestamp(last))).write.mode("append").parquet(f"{root}/in")
        source = t.spark.readStream.schema(events.schema).parquet(f"{root}/in")
        ownership.start_owned_jobs(source, root, f"{root}/checkpoint", lease_seconds=LEASE_SECONDS).awaitTermination()
    out = t.spark.read.parquet(f"{root}/outcomes")
    return out.select("job_id", "attempt_id", "kind", "outcome", "side", "status", F.col("attempts").cast("long").alias("attempts"))


@query
def binary_file_source(t: Tables) -> DataFrame:
    """Documents written as text objects and read back with the size filter."""
    root = f"{shared_dir(t.spark)}/objects-{uuid.uuid4().hex}"
    rows = t.read("documents").select(F.concat(F.lit("job-"), F.col("doc_id")).alias("owner"), F.col("text").alias("value"))
    folders = files.write_text_objects(rows, root)
    found = files.text_objects(t.spark, folders, max_size_bytes=CONFIG.max_size_bytes, owner_pattern=files.OWNER_FOLDER)
    return found.select(
        "object_key", "size_bytes", text_or_none("etag").alias("etag"),
        F.col("content").isNotNull().alias("has_body"),
    )
