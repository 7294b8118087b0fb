"""Extraction stage: rule extractor, pluggable extractors, response checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import schemas as S
from docketry.functions import text as X
from docketry.functions import variants as V

# An extractor takes rows with document_text, correlation_id and attempt_id and
# adds result_json (compact JSON, null when there is none) and provider_outcome.
Extractor = Callable[[DataFrame], DataFrame]

PROVIDER_OUTCOMES = ("success", "timeout", "throttled", "unavailable", "configuration_error",
                     "invalid_response", "unexpected")
RETRYABLE_OUTCOMES = ("timeout", "throttled", "unavailable", "configuration_error")


def request_error() -> Column:
    """Provider requests need text and both identifiers."""
    return F.when(
        X.is_blank(F.col("document_text"))
        | X.is_blank(F.col("correlation_id"))
        | X.is_blank(F.col("attempt_id")),
        "invalid_provider_request",
    )


def rule_result(text: Column, correlation_id: Column, attempt_id: Column) -> Column:
    """Result struct of the keyword rules for already stripped text."""
    return F.struct(
        X.classify_document(text).alias("document_type"),
        X.bounded_summary(text).alias("summary"),
        F.struct(
            F.length(text).alias("character_count"),
            X.word_count(text).alias("word_count"),
            correlation_id.alias("correlation_id"),
            attempt_id.alias("processing_attempt_id"),
        ).alias("key_fields"),
        F.lit(0.85).alias("confidence"),
        F.lit(False).alias("requires_human_review"),
    )


def bounded(extractor: Extractor, tasks: int) -> Extractor:
    """The extractor in at most ``tasks`` tasks at a time, for a provider that takes so many calls at once.

    Rows are dealt by job id; a number of partitions that is asked for is neither
    merged nor split when the plan adapts.
    """
    if tasks < 1:
        raise ValueError("at least one task")
    return lambda rows: extractor(rows.repartition(tasks, "job_id"))


def rule_extractor(rows: DataFrame) -> DataFrame:
    """Deterministic extractor; a ``planned_outcome`` column, when present, can
    replace success by any other provider outcome."""
    outcome = F.lit("success")
    if "planned_outcome" in rows.columns:
        outcome = F.coalesce(F.col("planned_outcome"), outcome)
    stripped = rows.withColumn("__text", X.strip(F.col("document_text")))
    result = rule_result(F.col("__text"), F.col("correlation_id"), F.col("attempt_id"))
    return (
        stripped.withColumn("provider_outcome", outcome)
        .withColumn("result_json", F.when(F.col("provider_outcome") == "success", F.to_json(result)))
        .drop("__text")
    )


def checked(rows: DataFrame) -> DataFrame:
    """One vocabulary of outcomes, and no success without a valid result.

    A result that breaks the contract is an invalid response; an outcome that is
    null or unknown is unexpected. A valid result is kept in its canonical text.
    """
    said = F.col("provider_outcome")
    outcome = F.when(said == "succeeded", "success").when(said == "timed_out", "timeout").otherwise(said)
    staged = rows.withColumn("provider_outcome", outcome).withColumn(
        "__payload", F.when(F.col("provider_outcome") == "success", V.parse_strict(F.col("result_json")))
    )
    judged = with_contract(staged, "__payload")
    broken = (said == "success") & F.col("contract_error").isNotNull()
    final = F.when(broken, "invalid_response").when(said.isin(*PROVIDER_OUTCOMES), said).otherwise("unexpected")
    return judged.withColumn("provider_outcome", final).drop("__payload", "contract_error")


def captured_extractor(captured: DataFrame) -> Extractor:
    """An extractor that answers each attempt with its captured response.

    ``captured`` is what ``validate_responses`` takes; of repeated attempts the
    smallest response counts. An attempt without a response has no outcome,
    which the pipeline takes as unexpected. Only the responses of the attempts
    that are made are grouped and validated.
    """

    def answer(rows: DataFrame) -> DataFrame:
        asked = captured.join(rows.select("attempt_id").distinct(), "attempt_id", "left_semi")
        one = asked.groupBy("attempt_id").agg(F.min(F.struct("response_json", "error_code")).alias("r"))
        verdicts = validate_responses(one.select("attempt_id", "r.*")).select(
            "attempt_id", F.col("verdict").alias("provider_outcome"), "result_json"
        )
        return rows.join(verdicts, "attempt_id", "left")

    return answer


# ---- captured responses -----------------------------------------------------


def _sections(response: Column) -> Column:
    """Text of a completed assistant response with exactly one text block."""
    blocks = V.as_array(response, "$.output.message.content")
    block = V.as_object(response, "$.output.message.content[0]")
    text = V.string(response, "$.output.message.content[0].text")
    good = (
        (V.string(response, "$.stopReason") == "end_turn")
        & (V.string(response, "$.output.message.role") == "assistant")
        & (F.size(blocks) == 1)
        & V.same_keys(block, ("text",))
        & ~X.is_blank(text)
    )
    return F.when(good, text)


def _result_fields(payload: Column) -> Column:
    return F.struct(
        V.string(payload, "$.document_type").alias("document_type"),
        X.strip_unicode(V.string(payload, "$.summary")).alias("summary"),
        V.get(payload, "$.key_fields").alias("key_fields"),
        V.number(payload, "$.confidence").alias("confidence"),
        F.when(
            V.kind(V.get(payload, "$.requires_human_review")) == "BOOLEAN",
            F.try_variant_get(payload, "$.requires_human_review", "boolean"),
        ).alias("requires_human_review"),
    )


_RESULT_NAMES = ("document_type", "summary", "key_fields", "confidence", "requires_human_review")


def with_contract(df: DataFrame, payload: str) -> DataFrame:
    """Check a result payload (VARIANT) against the contract.

    Adds ``result_json`` (canonical text when valid) and ``contract_error``.
    """
    p = F.col(payload)
    staged = df.withColumn("__f", _result_fields(p)).withColumn(
        "__json", F.to_json(F.col("__f"))
    )
    f = F.col("__f")
    broken = (
        F.when(~V.is_object(p), "not_an_object")
        .when(~V.same_keys(V.as_object(p), _RESULT_NAMES), "fields")
        .when(~F.coalesce(f["document_type"].isin(*S.DOCUMENT_TYPES), F.lit(False)), "document_type")
        .when(
            ~F.coalesce(F.length(f["summary"]).between(1, S.SUMMARY_MAX_CHARS), F.lit(False)),
            "summary",
        )
        .when(~V.within_bounds(f["key_fields"]), "key_fields")
        .when(~F.coalesce(f["confidence"].between(0.0, 1.0), F.lit(False)), "confidence")
        .when(f["requires_human_review"].isNull(), "requires_human_review")
        .when(F.octet_length("__json") > S.RESULT_MAX_BYTES, "serialized_size")
    )
    return (
        staged.withColumn("contract_error", F.when(p.isNull(), "json").otherwise(broken))
        .withColumn("result_json", F.when(F.col("contract_error").isNull(), F.col("__json")))
        .drop("__f", "__json")
    )


def response_metadata(response: Column) -> dict[str, Column]:
    """Tolerant metadata of an envelope: any part of the wrong shape is null."""
    return {
        "provider_request_id": X.non_blank(V.string(response, "$.ResponseMetadata.RequestId")),
        "stop_reason": X.non_blank(V.string(response, "$.stopReason")),
        "input_tokens": V.non_negative_int(response, "$.usage.inputTokens"),
        "output_tokens": V.non_negative_int(response, "$.usage.outputTokens"),
        "total_tokens": V.non_negative_int(response, "$.usage.totalTokens"),
        "provider_latency_ms": F.when(
            V.number(response, "$.metrics.latencyMs") >= 0, V.number(response, "$.metrics.latencyMs")
        ),
    }


def provider_error_table(spark: SparkSession) -> DataFrame:
    """Service error codes as a fixed 17-row dimension."""
    return spark.createDataFrame(
        list(S.PROVIDER_ERRORS),
        "error_code string, category string, outcome string, severity string, retryable boolean",
    )


def classify_provider_errors(rows: DataFrame, code: str = "error_code") -> DataFrame:
    """Add category, outcome, severity and retryable of a service error code."""
    table = provider_error_table(rows.sparkSession).withColumnRenamed("error_code", code)
    names = ("category", "outcome", "severity", "retryable")
    joined = rows.join(F.broadcast(table), code, "left")
    for name, default in zip(names, S.PROVIDER_ERROR_DEFAULT):
        joined = joined.withColumn(name, F.coalesce(F.col(name), F.lit(default)))
    return joined


def validate_responses(captured: DataFrame) -> DataFrame:
    """Verdict per captured response ``(attempt_id, response_json, error_code)``.

    Adds verdict (succeeded, invalid_response, or the outcome of the error
    code), invalid_step, result_json, severity, retryable and the metadata.
    """
    envelope = F.try_parse_json(F.col("response_json"))
    staged = captured.withColumn("__response", envelope).withColumn(
        "__text", _sections(F.col("__response"))
    )
    for name, value in response_metadata(F.col("__response")).items():
        staged = staged.withColumn(name, value)
    staged = staged.withColumn("__payload", V.parse_strict(F.col("__text")))
    checked = with_contract(staged, "__payload")
    failed_call = F.col("error_code").isNotNull()
    step = F.when(
        ~failed_call,
        F.when(F.col("__text").isNull(), "envelope").otherwise(F.col("contract_error")),
    )
    known = classify_provider_errors(checked.withColumn("invalid_step", step))
    verdict = (
        F.when(failed_call, F.col("outcome"))
        .when(F.col("invalid_step").isNotNull(), "invalid_response")
        .otherwise("succeeded")
    )
    severity = (
        F.when(failed_call, F.col("severity"))
        .when(F.col("invalid_step").isNotNull(), "warning")
        .otherwise("info")
    )
    return (
        known.withColumn("verdict", verdict)
        .withColumn("severity", severity)
        .withColumn("retryable", failed_call)
        .withColumn("result_json", F.when(~failed_call, F.col("result_json")))
        .drop("__response", "__text", "__payload", "contract_error", "outcome", "category")
    )
