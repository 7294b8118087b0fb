"""Telemetry events: allowlist, searches, traces and breakdowns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from docketry import schemas as S
from docketry.functions import text as X
from docketry.functions import times as TM
from docketry.functions import variants as V
from docketry.operators import outcomes as R


def safe_fields(fields: Column, allowed: tuple[str, ...] = S.TELEMETRY_FIELDS) -> Column:
    """Allowed flat fields of a ``map<string,variant>`` as text.

    Nested values and non-finite numbers are dropped; JSON null stays.
    """
    names = F.array(*[F.lit(n) for n in allowed])

    def safe(key: Column, value: Column) -> Column:
        flat = V.as_object(value).isNull() & V.as_array(value).isNull()
        finite = (V.kind(value) != "DOUBLE") | V.is_finite(F.try_variant_get(value, "$", "double"))
        return F.array_contains(names, key) & flat & F.coalesce(finite, F.lit(True))

    kept = F.map_filter(fields, safe)
    return F.transform_values(kept, lambda k, v: F.try_variant_get(v, "$", "string"))


def project_events(raw: DataFrame, service: str, allowed: tuple[str, ...] = S.TELEMETRY_FIELDS) -> DataFrame:
    """Raw events ``(ts, component, level, event_name, fields json)`` to stored rows.

    Events with a blank name are dropped; fields outside the allowlist are
    counted in ``dropped_field_count``.
    """
    entries = F.coalesce(
        V.as_object(F.try_parse_json("fields")), F.create_map().cast("map<string,variant>")
    )
    staged = (
        raw.withColumn("event_name", X.non_blank(F.col("event_name")))
        .where(F.col("event_name").isNotNull())
        .withColumn("__entries", entries)
        .withColumn("__safe", safe_fields(F.col("__entries"), allowed))
    )
    dropped = (F.size(F.map_keys("__entries")) - F.size("__safe")).cast("long")
    return (
        staged.withColumn("fields", F.col("__safe"))
        .withColumn("dropped_field_count", dropped)
        .withColumn("service", F.lit(service))
        .drop("__entries", "__safe")
    )


# ---- events of the own jobs ----------------------------------------------------

PROCESSOR, RECONCILER = "processor", "reconciler"
REJECTED, RETRYABLE = "event_rejected", "retryable_failure"


def _event(rows: DataFrame, as_of, service: str, component: str, level: Column, name: Column, fields: dict[str, Column]) -> DataFrame:
    """Rows of the telemetry table; fields without a value are left out."""
    texts = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))])
    return rows.select(
        TM.as_timestamp(as_of).alias("ts"), F.lit(service).alias("service"), F.lit(component).alias("component"),
        level.alias("level"), name.alias("event_name"), F.map_filter(texts, lambda k, v: v.isNotNull()).alias("fields"),
        F.lit(0).cast("long").alias("dropped_field_count"),
    )


def _record_events(records: DataFrame, as_of, service: str, component: str, stage: str, operation: str, fields: dict[str, Column]) -> DataFrame:
    """One event per record that was run: completed, or failed with its error."""
    failed = F.col("failed")
    parsing = F.col("error_code").endswith("event_parsing_error")
    level = F.when(failed, F.when(parsing, "warning").otherwise("error")).when(
        F.col("outcome").isin("terminal_failure_recorded", "dead_recorded"), "warning"
    ).otherwise("info")
    outcome = F.when(failed, F.when(parsing, REJECTED).otherwise(RETRYABLE)).otherwise(F.col("outcome"))
    name = F.when(failed, f"{stage}.record_failed").otherwise(f"{stage}.record_completed")
    own = {
        "operation": F.lit(operation), "outcome": outcome, "job_id": F.col("job_id"), "sqs_message_id": F.col("message_id"),
        "error_code": F.when(failed, F.col("error_code")), "retryable": F.when(failed, F.lit("true")),
    }
    done = records.where(failed | F.col("outcome").isNotNull())
    return _event(done, as_of, service, component, level, name, own | fields)


def _batch_events(messages: DataFrame, as_of, service: str, component: str, stage: str, operation: str) -> DataFrame:
    names = ("outcome", "batch_size", "processed_record_count", "failed_record_count")
    level = F.when(F.col("failed_record_count") > 0, "warning").otherwise("info")
    fields = {"operation": F.lit(operation)} | {n: F.col(n) for n in names}
    return _event(R.batch_summary(messages), as_of, service, component, level, F.lit(f"{stage}.batch_completed"), fields)


def upload_events(records: DataFrame, messages: DataFrame, *, as_of, service: str = "intake") -> DataFrame:
    """Telemetry of ``process_uploads``: an event for each record that was run, and one for each batch."""
    own = {
        "processing_attempt_id": F.when(~F.col("failed"), F.col("attempt_id")),
        "failure_reason": F.when(~F.col("failed"), F.col("failure_reason")),
    }
    ran = _record_events(records, as_of, service, PROCESSOR, "processing", "process_document", own)
    return ran.unionByName(_batch_events(messages, as_of, service, PROCESSOR, "processing", "process_document_batch"))


def reconciliation_events(records: DataFrame, messages: DataFrame, *, as_of, service: str = "intake") -> DataFrame:
    """Telemetry of ``reconcile_dead_letters``."""
    code = F.when(F.col("rec_pos").isNull(), "dead_letter_event_parsing_error").otherwise("dead_lettered_document_processing_error")
    ran = records.where("attempted").withColumn("error_code", F.when(F.col("failed"), code))
    events = _record_events(ran, as_of, service, RECONCILER, "reconciliation", "reconcile_dead_lettered_document", {})
    return events.unionByName(_batch_events(messages, as_of, service, RECONCILER, "reconciliation", "reconcile_dead_letter_batch"))


def observed(events: DataFrame) -> tuple[DataFrame, Observation]:
    """The events with totals that whoever writes them gets for nothing, without another pass."""
    totals = Observation("telemetry")
    named = lambda end: F.col("event_name").endswith(end)
    return events.observe(
        totals, F.count(F.lit(1)).alias("events"), F.count_if(named("record_completed")).alias("completed"),
        F.count_if(named("record_failed")).alias("failed"), F.count_if(named("batch_completed")).alias("batches"),
    ), totals


def union_components(parts: dict[str, DataFrame]) -> DataFrame:
    """One event log from the logs of several components."""
    named = [df.withColumn("component", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


# ---- saved searches ---------------------------------------------------------


def by_correlation(telemetry: DataFrame, correlation_id: str) -> DataFrame:
    return telemetry.where(F.col("correlation_id") == correlation_id).orderBy("ts", "event_id")


def newest_failures(telemetry: DataFrame, n: int = 100) -> DataFrame:
    return (
        telemetry.where(F.col("event_name") == "processing.record_failed")
        .orderBy(F.col("ts").desc(), F.col("event_id").desc())
        .limit(n)
    )


def terminal_outcomes(telemetry: DataFrame) -> DataFrame:
    return telemetry.where(
        (F.col("event_name") == "processing.record_completed")
        & (F.col("outcome") == "terminal_failure_recorded")
    ).orderBy(F.col("ts").desc(), F.col("event_id").desc())


def provider_failures(telemetry: DataFrame) -> DataFrame:
    return telemetry.where(
        (F.col("event_name") == "ai_provider.invocation_completed") & (F.col("outcome") != "succeeded")
    ).orderBy(F.col("ts").desc(), F.col("event_id").desc())


def dead_reconciliations(telemetry: DataFrame) -> DataFrame:
    return telemetry.where(
        (F.col("event_name") == "reconciliation.record_completed") & (F.col("outcome") == "dead_recorded")
    ).orderBy(F.col("ts").desc(), F.col("event_id").desc())


def trace(telemetry: DataFrame, correlation_id: str) -> DataFrame:
    """All events of one request flow, over three kinds of identifiers.

    Request events lead to job ids, job ids to attempts, attempts to provider
    events. The ids of one flow are few, but nothing relies on it: the
    semi joins pick their strategy from the real sizes.
    """
    requests = telemetry.where(
        (F.col("event_name") == "request.completed") & (F.col("correlation_id") == correlation_id)
    )
    job_ids = requests.select("job_id").where("job_id IS NOT NULL").distinct()
    records = telemetry.where(F.col("event_name").startswith("processing.")).join(job_ids, "job_id", "left_semi")
    attempts = records.select("processing_attempt_id").where("processing_attempt_id IS NOT NULL").distinct()
    provider = telemetry.where(
        (F.col("event_name") == "ai_provider.invocation_completed")
        & (F.col("correlation_id") == correlation_id)
    ).join(attempts, "processing_attempt_id", "left_semi")
    stages = (
        requests.withColumn("stage", F.lit("request")),
        records.withColumn("stage", F.lit("record")),
        provider.withColumn("stage", F.lit("provider")),
    )
    return reduce(lambda a, b: a.unionByName(b), stages).orderBy("ts", "event_id")


def outcome_breakdown(telemetry: DataFrame) -> DataFrame:
    return telemetry.groupBy("component", "event_name", "outcome", "failure_reason").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts")
    )
