"""Row shapes and fixed value domains."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values -----------------------------------------------------------
# State names, transitions, reasons, error codes and field names are part of the
# stored data and must keep these exact spellings.

PENDING = "pending_upload"
PROCESSING = "processing"
SUCCEEDED = "succeeded"
FAILED = "failed"
DEAD = "dead"

STATUSES = (PENDING, PROCESSING, SUCCEEDED, FAILED, DEAD)
TERMINAL_STATUSES = (SUCCEEDED, FAILED, DEAD)

TRANSITIONS = (
    (PENDING, PROCESSING),
    (PROCESSING, PENDING),
    (PROCESSING, SUCCEEDED),
    (PROCESSING, FAILED),
    (PROCESSING, DEAD),
)

FAILURE_REASONS = (
    "document_not_found",
    "document_validation_failed",
    "invalid_document_reference",
    "invalid_provider_request",
    "ai_provider_invalid_response",
)
RETRIES_EXHAUSTED = "processing_retries_exhausted"

DOCUMENT_TYPES = ("contract", "invoice", "report", "internal_note", "unknown")

# (service error code, category, outcome, severity, retryable)
PROVIDER_ERRORS = (
    ("ModelTimeoutException", "timeout", "timed_out", "error", True),
    ("RequestTimeout", "timeout", "timed_out", "error", True),
    ("RequestTimeoutException", "timeout", "timed_out", "error", True),
    ("ServiceQuotaExceededException", "throttling", "throttled", "warning", True),
    ("ThrottlingException", "throttling", "throttled", "warning", True),
    ("TooManyRequestsException", "throttling", "throttled", "warning", True),
    ("InternalServerException", "unavailable", "unavailable", "error", True),
    ("ModelErrorException", "unavailable", "unavailable", "error", True),
    ("ModelNotReadyException", "unavailable", "unavailable", "error", True),
    ("ServiceUnavailableException", "unavailable", "unavailable", "error", True),
    ("AccessDeniedException", "configuration", "configuration_error", "error", True),
    ("ExpiredTokenException", "configuration", "configuration_error", "error", True),
    ("InvalidSignatureException", "configuration", "configuration_error", "error", True),
    ("ResourceNotFoundException", "configuration", "configuration_error", "error", True),
    ("UnauthorizedException", "configuration", "configuration_error", "error", True),
    ("UnrecognizedClientException", "configuration", "configuration_error", "error", True),
    ("ValidationException", "configuration", "configuration_error", "error", True),
)
PROVIDER_ERROR_DEFAULT = ("unavailable", "unavailable", "error", True)

TELEMETRY_FIELDS = (
    "batch_size",
    "correlation_id",
    "duration_ms",
    "error_code",
    "exception_type",
    "failed_record_count",
    "failure_reason",
    "input_tokens",
    "job_id",
    "model_id",
    "operation",
    "outcome",
    "output_tokens",
    "processed_record_count",
    "processing_attempt_id",
    "provider_error_code",
    "provider_latency_ms",
    "provider_name",
    "provider_request_id",
    "request_id",
    "retryable",
    "sqs_message_id",
    "status_code",
    "stop_reason",
    "total_tokens",
)

CHANGE_ACTIONS = ("create", "update", "delete", "replace", "no-op")
DESTRUCTIVE_ACTIONS = ("delete", "replace")

SUMMARY_MAX_CHARS = 2_000
KEY_MAX_CHARS = 100
OBJECT_MAX_ENTRIES = 50
LIST_MAX_ITEMS = 50
MAX_NESTING = 5
RESULT_MAX_BYTES = 32 * 1024

# Alarm definitions: name, metric, statistic, threshold, period s, datapoints M of N.
ALARMS = (
    ("control-plane-5xx", "api_5xx", "sum", 1.0, 300, 1, 1),
    ("processor-errors", "processor_errors", "sum", 1.0, 300, 1, 1),
    ("reconciler-errors", "reconciler_errors", "sum", 1.0, 300, 1, 1),
    ("processing-queue-age", "queue_oldest_age", "max", 300.0, 60, 2, 3),
    ("processing-dlq-visible", "dlq_visible", "max", 1.0, 60, 1, 1),
    ("quarantine-visible", "quarantine_visible", "max", 1.0, 60, 1, 1),
    ("provider-client-errors", "provider_client_errors", "sum", 1.0, 300, 1, 1),
    ("provider-server-errors", "provider_server_errors", "sum", 1.0, 300, 1, 1),
    ("provider-throttles", "provider_throttles", "sum", 1.0, 300, 1, 1),
)
# ---- end of fixed values ----------------------------------------------------

ATTEMPT = T.StructType(
    [
        T.StructField("attempt_id", T.StringType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("lease_expires_at", T.TimestampType()),
    ]
)

MESSAGE = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField("msg_pos", T.LongType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("sent_ts", T.TimestampType()),
        T.StructField("receive_count", T.IntegerType()),
    ]
)

# Stored job item: one flat row per job, timestamps typed.
JOB = T.StructType(
    [
        T.StructField("PK", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("correlation_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("attempts", T.LongType()),
        T.StructField("active_attempt_id", T.StringType()),
        T.StructField("active_attempt_started_at", T.TimestampType()),
        T.StructField("active_attempt_lease_expires_at", T.TimestampType()),
        T.StructField("processing_result", T.StringType()),
        T.StructField("error_reason", T.StringType()),
    ]
)
JOB_COLUMNS = tuple(JOB.fieldNames())
ENTITY_TYPE = "document_job"

# Job item as it arrives from outside: timestamps still ISO-8601 text.
RAW_JOB = T.StructType(
    [
        T.StructField(
            f.name,
            T.StringType() if isinstance(f.dataType, T.TimestampType) else f.dataType,
        )
        for f in JOB.fields
    ]
)

STORED_OBJECT = T.StructType(
    [
        T.StructField("object_key", T.StringType()),
        T.StructField("version_id", T.StringType()),
        T.StructField("is_latest", T.BooleanType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("etag", T.StringType()),
        T.StructField("load_error", T.StringType()),
    ]
)

ACCESS_LOG = T.StructType(
    [
        T.StructField("requestId", T.StringType()),
        T.StructField("requestTimeEpoch", T.StringType()),
        T.StructField("routeKey", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("responseLength", T.StringType()),
        T.StructField("integrationStatus", T.StringType()),
        T.StructField("integrationLatency", T.StringType()),
        T.StructField("integrationErrorMessage", T.StringType()),
        T.StructField("sourceIp", T.StringType()),
        T.StructField("userAgent", T.StringType()),
    ]
)

CAPTURED_RESPONSE = T.StructType(
    [
        T.StructField("attempt_id", T.StringType()),
        T.StructField("response_json", T.StringType()),
        T.StructField("error_code", T.StringType()),
    ]
)

TELEMETRY = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("service", T.StringType()),
        T.StructField("component", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("dropped_field_count", T.LongType()),
    ]
)

# fixed values: tokens a second and burst of the two routes
ROUTE_LIMITS = {"create_job": (2, 5), "get_job": (10, 20)}
