"""Streams that run the composite jobs per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketry.config import IntakeConfig
from docketry.operators import extract, metrics, outcomes as R, telemetry
from docketry.plans import pipeline as P
from docketry.sources import sinks
from docketry.sources.job_store import JobStore, VersionConflict

RETRIES = 8


def _route(messages: DataFrame, verdicts: DataFrame, config: IntakeConfig, dead_letter_queue: bool) -> DataFrame:
    joined = messages.join(verdicts.select(*R.MESSAGE_KEY, "failed"), R.MESSAGE_KEY)
    return R.route_failed(joined, config, dead_letter_queue=dead_letter_queue)


def publish_once(
    store: JobStore, stream: str, batch_id: int, compute: Callable[[DataFrame], tuple[DataFrame, Callable[[], None]]]
) -> None:
    """Run one batch on the newest version until its changes are published on that version.

    ``compute`` takes the job table and gives the changes and a function that
    writes everything else the batch owns. A batch that is part of the store
    already is skipped, so what it wrote stays as it is. When another writer
    published in between, the batch is computed again on what that writer left.
    """
    for _ in range(RETRIES):
        version = store.version()
        if batch_id <= store.last_batch(stream, version):
            return
        changes, write_rest = compute(store.read(version))
        write_rest()
        try:
            store.apply(changes, batch=batch_id, expected=version, stream=stream)
            return
        except VersionConflict:
            continue
    raise VersionConflict(f"batch {batch_id} of {stream} met another writer {RETRIES} times")


def start_intake(
    messages: DataFrame,
    store: JobStore,
    objects: Callable[[SparkSession], DataFrame],
    out: str,
    checkpoint: str,
    *,
    as_of: Callable[[int], object],
    config: IntakeConfig = IntakeConfig(),
    plan: DataFrame | None = None,
    extractor: extract.Extractor = extract.rule_extractor,
    available_now: bool = True,
) -> StreamingQuery:
    """Process a message stream against a job store; ``plan`` and ``extractor`` as in ``process_uploads``.

    Outcomes, failures and undelivered messages are written first, into folders
    owned by the batch; publishing the job version is the last step and names
    the batch. A batch that fails before it is run again from the start and
    replaces its folders; a batch that is already published is skipped.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        def compute(jobs: DataFrame):
            result = P.process_uploads(
                batch, jobs, objects(batch.sparkSession), as_of=as_of(batch_id), config=config, plan=plan, extractor=extractor
            )

            def write_rest() -> None:
                sinks.write_batch(result.records, out, "records", batch_id)
                events = telemetry.upload_events(result.records, result.messages, as_of=as_of(batch_id), service=config.service)
                sinks.write_telemetry(events, out, batch_id)
                sinks.write_failures(result.messages, out, batch_id)
                sinks.write_routed(_route(batch, result.messages, config, False), out, batch_id)

            return result.changes, write_rest

        publish_once(store, "intake", batch_id, compute)

    writer = messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_reconciliation(
    messages: DataFrame,
    store: JobStore,
    out: str,
    checkpoint: str,
    *,
    as_of: Callable[[int], object],
    config: IntakeConfig = IntakeConfig(),
) -> StreamingQuery:
    """Dead-letter stream: mark jobs dead, quarantine what keeps failing."""

    def run(batch: DataFrame, batch_id: int) -> None:
        def compute(jobs: DataFrame):
            result = P.reconcile_dead_letters(batch, jobs, as_of=as_of(batch_id), config=config)

            def write_rest() -> None:
                sinks.write_batch(result.records, out, "dead_letter_records", batch_id)
                events = telemetry.reconciliation_events(
                    result.records, result.messages, as_of=as_of(batch_id), service=config.service
                )
                sinks.write_telemetry(events, out + "/dead_letters", batch_id)
                sinks.write_routed(_route(batch, result.messages, config, True), out + "/dead_letters", batch_id)

            return result.changes, write_rest

        publish_once(store, "reconciliation", batch_id, compute)

    return (
        messages.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def windowed_requests(events: DataFrame, seconds: int = 300, delay: str = "10 minutes") -> DataFrame:
    """Streaming request metrics; the watermark only bounds the window state."""
    return metrics.request_sums(events.withWatermark("ts", delay), seconds)


def start_alarms(points: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep metric points of a stream and re-evaluate the alarms after each batch.

    ``points`` holds windowed aggregates in update mode ``(metric,
    period_start, value)``; a later value of a period replaces the earlier one.
    A batch writes the states from its own first period on; points are read
    from as far before it as the longest alarm looks back, and only the days
    of that stretch are opened. ``alarms.start_alarm_changes`` keeps final points
    in state and reads nothing again.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        dated = batch.withColumn("event_date", F.to_date("period_start"))
        sinks.write_batch(dated, out, "points", batch_id, ["event_date"])
        first = batch.agg(F.min("period_start")).first()[0]
        if first is None:
            return
        since = F.lit(first) - F.make_dt_interval(secs=F.lit(metrics.longest_look_back()))
        points_kept = spark.read.parquet(f"{out}/points").where(F.col("event_date") >= F.to_date(since))
        kept = points_kept.where(F.col("period_start") >= since)
        newest = kept.groupBy("metric", "period_start").agg(
            F.max_by("value", "stream_batch").alias("value")
        )
        states = metrics.evaluate_alarms(newest, start=since)
        sinks.write_batch(states.where(F.col("period_start") >= F.lit(first)), out, "alarm_states", batch_id)

    return (
        points.writeStream.outputMode("update")
        .foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
