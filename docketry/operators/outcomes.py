"""Message verdicts, batch summaries, redelivery and redrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.config import IntakeConfig
from docketry.functions import times as TM
from docketry.functions import text as X
from docketry.operators import skew

# fixed values: record and batch outcomes
PROCESSED = "processed"
TERMINAL_FAILURE = "terminal_failure_recorded"
EFFECT_APPLIED = "effect_already_applied"
DEAD_RECORDED = "dead_recorded"

MESSAGE_KEY = ["batch_id", "msg_pos"]


def stop_after_failure(records: DataFrame, failed: str = "failed") -> DataFrame:
    """Add ``attempted``: records behind the first failure of their message are not run.

    A message is one queue row, so the window group is bounded by one body.
    """
    before = Window.partitionBy(*MESSAGE_KEY).orderBy("rec_pos").rowsBetween(
        Window.unboundedPreceding, -1
    )
    failed_before = F.max(F.col(failed).cast("int")).over(before)
    return records.withColumn("attempted", F.coalesce(failed_before, F.lit(0)) == 0)


def message_verdicts(records: DataFrame, failed: str = "failed") -> DataFrame:
    """One row per message: failed when any of its records failed."""
    return records.groupBy(*MESSAGE_KEY, "message_id").agg(F.bool_or(failed).alias("failed"))


def failed_message_ids(messages: DataFrame) -> DataFrame:
    """Distinct failed message ids per batch with their first position."""
    return (
        messages.where(F.col("failed"))
        .groupBy("batch_id", "message_id")
        .agg(F.min("msg_pos").alias("first_pos"))
    )


def batch_summary(messages: DataFrame) -> DataFrame:
    """Counts and outcome per batch; failures count distinct message ids."""
    sizes = messages.groupBy("batch_id").agg(F.count(F.lit(1)).alias("batch_size"))
    failures = failed_message_ids(messages).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("failed_record_count")
    )
    failed = F.coalesce("failed_record_count", F.lit(0))
    return sizes.join(failures, "batch_id", "left").select(
        "batch_id",
        "batch_size",
        (F.col("batch_size") - failed).alias("processed_record_count"),
        failed.alias("failed_record_count"),
        F.when(failed > 0, "completed_with_failures").otherwise("succeeded").alias("outcome"),
    )


def reject_broken_batches(messages: DataFrame, config: IntakeConfig = IntakeConfig()) -> DataFrame:
    """Add ``batch_state``: a message without an id fails its whole batch.

    ``processed``: handled as usual; ``handled_then_retried``: before the broken
    message, effects stay but the message comes again; ``not_handled``: the
    broken message and everything after it.
    """
    broken = (
        messages.where(X.is_blank(F.col("message_id")))
        .groupBy("batch_id")
        .agg(F.min("msg_pos").alias("__broken"))
    )
    looked = skew.salted_lookup(
        messages, broken, ["batch_id"], ["msg_pos"], **config.hot_options()
    )
    return (
        looked.withColumn(
            "batch_state",
            F.when(F.col("__broken").isNull(), "processed")
            .when(F.col("msg_pos") < F.col("__broken"), "handled_then_retried")
            .otherwise("not_handled"),
        )
        .drop("__broken")
    )


def route_failed(
    deliveries: DataFrame, config: IntakeConfig, *, dead_letter_queue: bool = False
) -> DataFrame:
    """Destination of each delivery ``(failed, receive_count, sent_ts)``.

    acknowledged, retry (with ``available_at``), dead_letter, or quarantine for
    deliveries that come from the dead-letter queue.
    """
    exhausted = F.col("receive_count") >= config.max_receives
    wait = config.dead_letter_visibility_seconds if dead_letter_queue else config.visibility_seconds
    last = "quarantine" if dead_letter_queue else "dead_letter"
    return deliveries.withColumn(
        "destination",
        F.when(~F.col("failed"), "acknowledged").when(exhausted, last).otherwise("retry"),
    ).withColumn(
        "available_at",
        F.when(
            F.col("destination") == "retry",
            TM.plus_seconds(F.col("sent_ts").cast("timestamp"), wait),
        ),
    )


def due(retries: DataFrame, as_of) -> DataFrame:
    """Retry rows whose visibility wait is over."""
    return retries.where(F.col("available_at") <= TM.as_timestamp(as_of))


def receive_counts(deliveries: DataFrame) -> DataFrame:
    return deliveries.groupBy("message_id").agg(F.count(F.lit(1)).alias("receive_count"))


def outcome_violations(records: DataFrame) -> DataFrame:
    """Rules that tie outcome, attempt, result and reason of one record."""
    outcome = F.col("outcome")
    has_attempt = F.col("attempt_id").isNotNull()
    has_result = F.col("result_json").isNotNull()
    has_reason = F.col("failure_reason").isNotNull()
    checks = [
        F.when((outcome == PROCESSED) & ~(has_attempt & has_result & ~has_reason), "processed"),
        F.when(
            (outcome == TERMINAL_FAILURE) & ~(has_attempt & has_reason & ~has_result),
            "terminal_failure",
        ),
        F.when((outcome == EFFECT_APPLIED) & (has_attempt | has_result | has_reason), "applied"),
    ]
    return records.withColumn("violations", F.array_compact(F.array(*checks)))
