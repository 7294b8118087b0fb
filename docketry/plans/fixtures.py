"""Intake tables derived from the driver tables, as Spark expressions.

The rules are deterministic functions of row ids, so a second engine can build
the same rows without this library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"


class Tables:
    """Lazy access to one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str, key: str) -> DataFrame:
        """A table for CPU-heavy rows: few files are spread over all cores.

        A table with at least as many files as cores is read as it is, without
        a shuffle.
        """
        return self._spread(self.read(name), key)

    def _spread(self, df: DataFrame, key: str) -> DataFrame:
        cores = self.spark.sparkContext.defaultParallelism
        return df if len(df.inputFiles()) >= cores else df.repartition(cores, key)

    def _documents_n(self):
        return self.read("documents").agg(F.count(F.lit(1))).scalar()

    # ---- objects, jobs, messages ----------------------------------------

    def objects(self) -> DataFrame:
        d = self.read("documents").where("doc_id % 29 <> 0")
        return d.select(
            "doc_id",
            F.expr("concat('job-', doc_id)").alias("job_id"),
            F.expr("concat('documents/job-', doc_id, '/source.txt')").alias("object_key"),
            F.lit(None).cast("string").alias("version_id"),
            F.lit(True).alias("is_latest"),
            F.col("text").cast("binary").alias("content"),
            F.octet_length("text").cast("long").alias("size_bytes"),
            F.expr("CASE WHEN doc_id % 23 = 0 THEN 'application/pdf' ELSE 'text/plain' END").alias("content_type"),
            F.expr("concat('\"', md5(text), '\"')").alias("etag"),
            F.expr("CASE WHEN doc_id % 97 = 5 THEN 'timeout' END").alias("load_error"),
        )

    def jobs(self) -> DataFrame:
        return self.read("documents").where("doc_id % 31 <> 0").selectExpr(
            "doc_id",
            "concat('JOB#job-', doc_id) AS PK",
            "'document_job' AS entity_type",
            "concat('job-', doc_id) AS job_id",
            "CASE doc_id % 10 WHEN 6 THEN 'processing' WHEN 7 THEN 'processing' "
            "WHEN 8 THEN 'succeeded' WHEN 9 THEN 'failed' ELSE 'pending_upload' END AS status",
            "concat('req-', doc_id) AS request_id",
            "concat('corr-', doc_id % 100) AS correlation_id",
            "TIMESTAMP '2024-01-31 00:00:00' AS created_at",
            "TIMESTAMP '2024-01-31 12:00:00' AS updated_at",
            "CASE WHEN doc_id % 10 >= 5 THEN 1L ELSE 0L END AS attempts",
            "CASE WHEN doc_id % 10 IN (6, 7) THEN concat('attempt-', doc_id) END AS active_attempt_id",
            "CASE doc_id % 10 WHEN 6 THEN TIMESTAMP '2024-02-01 00:00:00' "
            "WHEN 7 THEN TIMESTAMP '2024-01-31 23:55:00' END AS active_attempt_started_at",
            "CASE doc_id % 10 WHEN 6 THEN TIMESTAMP '2024-02-01 00:05:00' "
            "WHEN 7 THEN TIMESTAMP '2024-02-01 00:00:00' END AS active_attempt_lease_expires_at",
            "CASE WHEN doc_id % 10 = 8 THEN '{}' END AS processing_result",
            "CASE WHEN doc_id % 10 = 9 THEN 'document_not_found' END AS error_reason",
        )

    def messages(self, two_records: bool = False) -> DataFrame:
        """One queue message per event; optionally a second record for some."""
        d = self.read("documents").select(
            "doc_id", F.octet_length("text").alias("n_bytes"), F.md5("text").alias("etag")
        )
        e = self.read("events").select(
            "event_id", "ts", "event_type", (F.col("event_id") % self._documents_n()).alias("doc_id")
        )
        rows = e.join(d, "doc_id")
        first = self._record_json("event_id", "doc_id", "n_bytes", "etag")
        body = F.concat(F.lit('{"Records":['), first, F.lit("]}"))
        if two_records:
            d2 = d.select(
                F.col("doc_id").alias("doc2"), F.col("n_bytes").alias("n2"), F.col("etag").alias("etag2")
            )
            # most events have no second document: a second key spreads them, else one task of the join takes them all
            rows = rows.withColumn(
                "doc2", F.when(F.col("event_id") % 7 == 0, (F.col("event_id") + 1) % self._documents_n())
            ).withColumn("spread", F.coalesce("doc2", "event_id")).join(d2.withColumn("spread", F.col("doc2")), ["doc2", "spread"], "left")
            second = self._record_json("event_id", "doc2", "n2", "etag2", plain=True)
            body = F.when(
                F.col("doc2").isNotNull(),
                F.concat(F.lit('{"Records":['), first, F.lit(","), second, F.lit("]}")),
            ).otherwise(body)
        return self._spread(rows, "event_id").select(
            "event_id",
            "doc_id",
            F.expr("concat('b-', event_id div 10)").alias("batch_id"),
            F.col("event_id").alias("msg_pos"),
            F.expr("concat('m-', event_id)").alias("message_id"),
            F.col("ts").cast("timestamp").alias("sent_ts"),
            (F.col("event_id") % 4 + 1).cast("int").alias("receive_count"),
            F.when(F.col("event_id") % 47 == 0, F.lit("{broken")).otherwise(body).alias("body"),
        )

    def long_messages(self, records: int = 200) -> DataFrame:
        """One message for ``records`` documents each, later than all others; the records that can fail come last."""
        d = self.read("documents").select(
            "doc_id", (F.col("doc_id") / records).cast("long").alias("g"),
            F.octet_length("text").alias("n_bytes"), F.md5("text").alias("etag"),
            F.expr(
                "CASE WHEN doc_id % 31 <> 0 AND doc_id % 10 >= 8 THEN 0 WHEN doc_id % 31 = 0 OR doc_id % 10 = 6 "
                "OR doc_id % 17 IN (0, 1, 2, 4) OR doc_id % 97 = 5 THEN 2 ELSE 1 END"
            ).alias("place"),
        )
        record = self._record_json("1", "doc_id", "n_bytes", "etag", plain=True)
        listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id", record.alias("r")))), lambda x: x["r"])
        return d.groupBy("g").agg(F.array_join(listed, ",").alias("r")).select(
            F.expr("concat('long-', g)").alias("batch_id"), F.expr("g + 1000000000").alias("msg_pos"),
            F.expr("concat('long-', g)").alias("message_id"), F.expr("TIMESTAMP '2024-01-31 12:00:00'").alias("sent_ts"),
            F.lit(1).alias("receive_count"), F.concat(F.lit('{"Records":['), "r", F.lit("]}")).alias("body"),
        )

    @staticmethod
    def _record_json(event_id: str, doc: str, n_bytes: str, etag: str, plain: bool = False):
        name = f"CASE WHEN {event_id} % 37 = 0 THEN 'ObjectRemoved:Delete' ELSE 'ObjectCreated:Put' END"
        bucket = f"CASE WHEN {event_id} % 41 = 0 THEN 'other' ELSE 'docs' END"
        nested = f"CASE WHEN {event_id} % 43 = 0 THEN '%2Fnested' ELSE '' END"
        extra = f"CASE WHEN {event_id} % 59 = 0 THEN 1 ELSE 0 END"
        tag = f"CASE WHEN {event_id} % 53 = 0 THEN '' ELSE concat(',\"eTag\":\"', {etag}, '\"') END"
        if plain:
            name, bucket, nested, extra = "'ObjectCreated:Put'", "'docs'", "''", "0"
            tag = f"concat(',\"eTag\":\"', {etag}, '\"')"
        return F.expr(
            f"""concat('{{"eventName":"', {name}, '","s3":{{"bucket":{{"name":"', {bucket},
            '"}},"object":{{"key":"documents%2Fjob-', {doc}, {nested}, '%2Fsource.txt","size":',
            {n_bytes} + {extra}, {tag}, '}}}}}}')"""
        )

    def provider_plan(self) -> DataFrame:
        return self.read("documents").selectExpr(
            "concat('job-', doc_id) AS job_id",
            "CASE doc_id % 17 WHEN 0 THEN 'timeout' WHEN 1 THEN 'throttled' WHEN 2 THEN 'unavailable' "
            "WHEN 3 THEN 'invalid_response' WHEN 4 THEN 'unexpected' ELSE 'success' END AS planned_outcome",
        )

    # ---- texts, responses, requests --------------------------------------

    def rule_texts(self) -> DataFrame:
        prefix = (
            "CASE doc_id % 5 WHEN 0 THEN 'Invoice ' WHEN 1 THEN 'Service contract ' "
            "WHEN 2 THEN 'Quarterly report ' WHEN 3 THEN 'Internal note ' ELSE '' END"
        )
        return self.spread("documents", "doc_id").selectExpr(
            "doc_id",
            f"concat('  ', {prefix}, text, '\\n') AS document_text",
            "concat('corr-', doc_id % 100) AS correlation_id",
            "concat('attempt-', doc_id) AS attempt_id",
        )

    def responses(self) -> DataFrame:
        """Captured responses; ``doc_id % 13`` selects the defect of the payload."""
        good = (
            '\'{"document_type":"report","summary":"doc \' || doc_id || \'",'
            '"key_fields":{"lang":"\' || lang || \'"},"confidence":0.5,"requires_human_review":true}\''
        )

        def payload(kind="report", summary="doc", fields='{"a":1}', conf="0.5", review="true", tail="", extra=""):
            return (
                "'" + f'{{"document_type":"{kind}","summary":"{summary}","key_fields":{fields},'
                f'"confidence":{conf},"requires_human_review":{review}{extra}}}{tail}' + "'"
            )

        long_text = "' || repeat('x', 2001) || '"
        many = "{' || array_join(transform(sequence(0, 50), i -> concat('\"k', i, '\":1')), ',') || '}"
        deep = '{"a":{"a":{"a":{"a":{"a":{}}}}}}'
        cases = [
            good,
            payload(extra=',"summary":"again"'),
            payload(conf="NaN"),
            payload(tail=" trailing"),
            "'[1,2]'",
            payload(extra=',"other":1'),
            payload(summary=long_text),
            payload(kind="letter"),
            payload(review="1"),
            payload(conf='"0.9"'),
            payload(fields=many),
            payload(fields=deep),
            payload(fields='{" ":1}'),
        ]
        text = "CASE doc_id % 13 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END"
        envelope = (
            "concat('{\"stopReason\":\"', CASE WHEN doc_id % 19 = 7 THEN 'max_tokens' ELSE 'end_turn' END, "
            "'\",\"output\":{\"message\":{\"role\":\"assistant\",\"content\":[{\"text\":', to_json_text(payload), "
            "'}]}},\"usage\":{\"inputTokens\":', n_chars, ',\"outputTokens\":', doc_id % 50, '}}')"
        )
        d = self.spread("documents", "doc_id").withColumn("payload", F.expr(text))
        quoted = F.regexp_replace(F.to_json(F.struct("payload")), r'^\{"payload":|\}\z', "")
        return d.withColumn("quoted", quoted).selectExpr(
            "doc_id",
            "concat('attempt-', doc_id) AS attempt_id",
            envelope.replace("to_json_text(payload)", "quoted") + " AS response_json",
            "CASE WHEN doc_id % 23 = 11 THEN 'ThrottlingException' END AS error_code",
        )

    def requests(self) -> DataFrame:
        """Create requests: headers, gateway id and body by document id."""
        return self.read("documents").selectExpr(
            "doc_id",
            "concat('job-', CASE WHEN doc_id % 6 = 0 THEN doc_id ELSE doc_id + 1000000000 END) AS job_id",
            "concat('key-', doc_id) AS event_key",
            "CASE doc_id % 4 WHEN 0 THEN map('X-Request-Id', concat(' rid-', doc_id, ' '), 'Accept', '*/*') "
            "WHEN 1 THEN map('x-request-id', '  ', 'X-CORRELATION-ID', concat('cid-', doc_id)) "
            "WHEN 2 THEN map('X-Correlation-Id', concat('cid-', doc_id), 'x-correlation-id', ' ') END AS headers",
            "CASE WHEN doc_id % 3 = 0 THEN concat('gw-', doc_id) END AS gateway_request_id",
            "CASE doc_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '{}' WHEN 3 THEN ' {} ' "
            "WHEN 4 THEN '[]' WHEN 5 THEN '{\"a\":1}' WHEN 6 THEN '{bad' ELSE '   ' END AS body",
            "doc_id % 40 = 2 AS is_base64",
        )

    # ---- histories and telemetry -----------------------------------------

    def history(self) -> DataFrame:
        """Delivery history per user: the event type is the delivery outcome."""
        return self.read("events").selectExpr(
            "concat('u-', user_id) AS job_id", "event_id", "CAST(ts AS TIMESTAMP) AS ts",
            "CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'signup' THEN 'fail' "
            "WHEN 'error' THEN 'release' ELSE 'crash' END AS result",
        )

    def queued(self) -> DataFrame:
        """Messages sent within 100 seconds, one per event."""
        return self.read("events").selectExpr(
            "concat('m-', event_id) AS message_id",
            "TIMESTAMP '2024-02-01 00:00:00' + make_dt_interval(0, 0, 0, event_id % 100) AS sent_ts",
        )

    def ownership_events(self) -> DataFrame:
        """Each event claims a job; most finalize it hours later, some rows arrive days late."""
        e = self.read("events").selectExpr(
            "event_id", "concat('u-', user_id, '-', event_id % 7) AS job_id", "concat('a-', event_id) AS attempt_id",
            "CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'signup' THEN 'fail' WHEN 'error' THEN 'release' END AS result",
            "CAST(ts AS TIMESTAMP) AS claimed",
            "CAST(ts AS TIMESTAMP) + make_dt_interval(0, event_id * 37 % 9) AS ended",
        )
        claims = e.selectExpr(
            "job_id", "attempt_id", "'claim' AS kind", "claimed AS ts",
            "CASE WHEN event_id % 17 = 0 THEN claimed + INTERVAL 3 DAYS ELSE claimed END AS arrived",
        )
        ends = e.where("result is not null").selectExpr(
            "job_id", "attempt_id", "result AS kind", "ended AS ts",
            "CASE WHEN event_id % 13 = 0 THEN ended + INTERVAL 2 DAYS ELSE ended END AS arrived",
        )
        return claims.unionByName(ends)

    def status_history(self) -> DataFrame:
        return self.read("events").selectExpr(
            "concat('u-', user_id) AS job_id", "event_id", "CAST(ts AS TIMESTAMP) AS ts",
            "CASE event_type WHEN 'click' THEN 'pending_upload' WHEN 'view' THEN 'processing' "
            "WHEN 'purchase' THEN 'succeeded' WHEN 'signup' THEN 'failed' ELSE 'dead' END AS status",
            "timestampadd(HOUR, CAST(event_id % 10 * 12 AS INT), CAST(ts AS TIMESTAMP)) AS updated_at",
        )

    def telemetry(self) -> DataFrame:
        return self.read("events").selectExpr(
            "event_id",
            "CAST(ts AS TIMESTAMP) AS ts",
            "CASE event_id % 4 WHEN 0 THEN 'create_job' WHEN 1 THEN 'get_job' "
            "WHEN 2 THEN 'processor' ELSE 'reconciler' END AS component",
            "CASE event_id % 4 WHEN 0 THEN 'request.completed' WHEN 1 THEN 'request.completed' "
            "WHEN 2 THEN CASE WHEN event_type = 'error' THEN 'processing.record_failed' "
            "WHEN event_id % 3 = 0 THEN 'ai_provider.invocation_completed' "
            "ELSE 'processing.record_completed' END "
            "ELSE 'reconciliation.record_completed' END AS event_name",
            "CASE event_type WHEN 'purchase' THEN 'processed' WHEN 'signup' THEN 'terminal_failure_recorded' "
            "WHEN 'error' THEN 'retryable_failure' WHEN 'click' THEN 'effect_already_applied' "
            "ELSE 'dead_recorded' END AS outcome",
            "CASE WHEN event_type = 'signup' THEN "
            "CASE WHEN user_id % 2 = 0 THEN 'document_not_found' ELSE 'document_validation_failed' END END "
            "AS failure_reason",
            "round(value * 10, 3) AS duration_ms",
            "CASE event_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 201 WHEN 2 THEN 404 WHEN 3 THEN 409 ELSE 503 END "
            "AS status_code",
            "concat('corr-', user_id) AS correlation_id",
            "concat('job-', user_id) AS job_id",
            "concat('attempt-', user_id) AS processing_attempt_id",
            "CAST(event_id % 1000 AS BIGINT) AS input_tokens",
            "CAST(event_id % 77 AS BIGINT) AS output_tokens",
            "CASE event_id % 19 WHEN 0 THEN 'ModelTimeoutException' WHEN 1 THEN 'ThrottlingException' "
            "WHEN 2 THEN 'AccessDeniedException' WHEN 3 THEN 'SomethingElse' "
            "WHEN 4 THEN 'ServiceUnavailableException' END AS provider_error_code",
        )

    def fast_requests(self) -> DataFrame:
        return self.read("events").where("event_id % 4 < 2").selectExpr(
            "event_id", "CASE event_id % 4 WHEN 0 THEN 'create_job' ELSE 'get_job' END AS route",
            "timestamp_micros(1704067200000000 + (unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000) div 2500) AS ts",
        )

    def snapshots(self) -> tuple[DataFrame, DataFrame]:
        """Two snapshots of documents: ``(key, entity, payload, identity)``."""
        d = self.read("documents")
        before = d.where("doc_id % 5 <> 0").selectExpr(
            "concat('doc.', doc_id) AS key", "source AS entity", "md5(text) AS payload", "lang AS identity"
        )
        after = d.where("doc_id % 7 <> 0").selectExpr(
            "concat('doc.', doc_id) AS key", "source AS entity",
            "CASE WHEN doc_id % 11 = 0 THEN md5(concat(text, '!')) ELSE md5(text) END AS payload",
            "CASE WHEN doc_id % 13 = 0 THEN concat(lang, '-new') ELSE lang END AS identity",
        )
        return before, after
