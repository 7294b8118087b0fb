"""Queries over streams, sinks and the small rules of the service, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions import text as X
from docketry.functions import times as TM
from docketry.functions import variants as V
from docketry.operators import changes, extract, intake, jobs as J, metrics, objects as O_, requests as RQ
from docketry.plans import oracles as O
from docketry.plans import pipeline as P
from docketry.plans.catalog import CONFIG, _processed, _record_view, query, text_or_none, wall
from docketry.plans.fixtures import AS_OF, Tables
from docketry.session import shared_dir
from docketry.sources import files, queue_source as queue_files, snapshots
from docketry.sources.job_store import JobStore
from docketry.streaming import intake as SI

SQL: dict[str, str] = {}


def _folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


# ---- streams ------------------------------------------------------------------


# messages of a queue file: a file is one JSON document, read and parsed whole by one task
FILE_MESSAGES = 20_000


def _queue_files(t: Tables, path: str) -> None:
    """The messages as queue batches, one JSON document a file; their number grows with the events."""
    attributes = F.struct(
        F.unix_millis("sent_ts").cast("string").alias("SentTimestamp"), F.col("receive_count").cast("string").alias("ApproximateReceiveCount")
    )
    one = F.struct(F.col("message_id").alias("messageId"), "body", attributes.alias("attributes"))
    n = max(40, -(-t.read("events").count() // FILE_MESSAGES))
    batches = t.messages().groupBy((F.col("event_id") % n).alias("b")).agg(F.sort_array(F.collect_list(one)).alias("Records"))
    batches.select("b", F.to_json(F.struct("Records")).alias("value")).repartition("b").write.partitionBy("b").text(path)


@query
def intake_stream(t: Tables) -> DataFrame:
    """Queue files through the intake stream into a store: its records, failed ids, undelivered messages and jobs."""
    root = _folder(t, "intake")
    _queue_files(t, f"{root}/queue")
    store = JobStore(t.spark, f"{root}/store")
    store.apply(t.jobs())
    SI.start_intake(
        files.queue_batches(t.spark, f"{root}/queue", streaming=True).drop("batch_error"), store, lambda spark: t.objects(),
        f"{root}/out", f"{root}/checkpoint", as_of=lambda batch: AS_OF, config=CONFIG, plan=t.provider_plan(),
    ).awaitTermination()
    read = lambda name: t.spark.read.parquet(f"{root}/out/{name}")
    records = _record_view(read("records")).select(
        F.lit("record").alias("kind"), F.col("message_id").alias("id"), F.col("start_outcome").alias("state"),
        F.concat_ws("/", "outcome", "failure_reason", "retry_reason").alias("detail"),
    )
    failures = read("item_failures").selectExpr("'failure' AS kind", "message_id AS id", "'-' AS state", "'-' AS detail")
    again = read("undelivered").selectExpr("'undelivered' AS kind", "message_id AS id", "destination AS state", "'-' AS detail")
    jobs = store.read().selectExpr("'job' AS kind", "job_id AS id", "status AS state", "CAST(attempts AS STRING) AS detail")
    return records.unionByName(failures).unionByName(again).unionByName(jobs)


_JOB_TABLE = O._SQL["processed_job_table"]
SQL["intake_stream"] = f"""WITH {O._MSG}, {O._ROUTED}, {O._CLAIMED}, {O._JOBS}, every AS (
  SELECT message_id, job_id, start_outcome, failure_reason, retry_reason FROM ran
  UNION ALL {O._REST.format(source='routed')}
), ups AS (
  SELECT message_id, CAST(0 AS BIGINT) AS rec_pos, job_id, start_outcome, {O._RECORD_COLUMNS} FROM every
  UNION ALL {O._REJECTED}
)
SELECT 'record' AS kind, message_id AS id, start_outcome AS state, outcome || '/' || failure_reason || '/' || retry_reason AS detail FROM ups
UNION ALL SELECT 'failure', message_id, '-', '-' FROM ups WHERE failed
UNION ALL SELECT 'undelivered', message_id, CASE WHEN event_id % 4 + 1 >= 3 THEN 'dead_letter' ELSE 'retry' END, '-'
  FROM ups JOIN msg USING (message_id) WHERE failed
UNION ALL SELECT 'job', job_id, status, CAST(attempts AS VARCHAR) FROM ({_JOB_TABLE[_JOB_TABLE.index("SELECT j.job_id"):]})"""


@query
def queue_source(t: Tables) -> DataFrame:
    """The queue files, and some damaged ones, through the data source, in partitions of 256 KB."""
    root = _folder(t, "queue-source")
    _queue_files(t, f"{root}/queue")
    damaged = t.read("documents").where("doc_id < 10").select(
        F.col("doc_id").alias("b"), F.concat(F.lit('{"Records":['), F.to_json(F.struct("text")), F.lit(",")).alias("value")
    )
    damaged.repartition("b").write.partitionBy("b").text(f"{root}/queue/damaged")
    t.spark.dataSource.register(queue_files.QueueSource)
    read = t.spark.read.format("docketry_queue").option("partitionBytes", str(256 << 10)).load(f"{root}/queue")
    named = read.select(
        F.coalesce("message_id", F.regexp_extract("batch_id", "b=([0-9]+)/[^/]*$", 1)).alias("id"), wall("sent_ts").alias("sent_ts"),
        F.col("receive_count").cast("long").alias("receive_count"), text_or_none("batch_error").alias("batch_error"),
        F.coalesce(F.md5("body"), F.lit("-")).alias("body"),
    )
    bodies = t.messages().select(F.col("message_id").alias("id"), F.md5("body").alias("sent_body"))
    return named.join(bodies, "id", "left").select(
        "id", F.when(F.col("batch_error") == "-", F.col("sent_ts")).alias("sent_ts"), "receive_count", "batch_error",
        (F.col("body") == F.coalesce("sent_body", F.lit("-"))).alias("same_body"),
    )


SQL["queue_source"] = """
SELECT 'm-' || event_id AS id, date_trunc('millisecond', ts) AS sent_ts, event_id % 4 + 1 AS receive_count, '-' AS batch_error, true AS same_body FROM events
UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, 1, 'malformed_queue_event', true FROM documents WHERE doc_id < 10"""


@query
def reconciliation_stream(t: Tables) -> DataFrame:
    """Dead letters through their stream: its records, and the jobs it marked in the store."""
    root = _folder(t, "reconciliation")
    two = t.messages(two_records=True)
    two.select("batch_id", "msg_pos", "message_id", "body", "sent_ts", "receive_count").write.parquet(f"{root}/queue")
    store = JobStore(t.spark, f"{root}/store")
    store.apply(t.jobs())
    SI.start_reconciliation(
        files.messages(t.spark, f"{root}/queue", streaming=True), store, f"{root}/out", f"{root}/checkpoint",
        as_of=lambda batch: AS_OF, config=CONFIG,
    ).awaitTermination()
    records = t.spark.read.parquet(f"{root}/out/dead_letter_records").select(
        "message_id", F.coalesce("rec_pos", F.lit(-1)).cast("long").alias("rec_pos"), text_or_none("job_id").alias("job_id"), "outcome", "failed"
    )
    dead = store.read().where("status = 'dead'").select(
        F.lit("-").alias("message_id"), F.lit(-2).cast("long").alias("rec_pos"), "job_id", F.col("error_reason").alias("outcome"),
        F.lit(False).alias("failed"),
    )
    return records.unionByName(dead)


_DEAD_SQL = O._SQL["reconcile_dead"]
SQL["reconciliation_stream"] = f"""{_DEAD_SQL[:_DEAD_SQL.index("SELECT s.message_id")]}, r AS ({_DEAD_SQL[_DEAD_SQL.index("SELECT s.message_id"):]})
SELECT message_id, rec_pos, job_id, outcome, failed FROM r
UNION ALL
SELECT DISTINCT '-', CAST(-2 AS BIGINT), job_id, 'processing_retries_exhausted', false FROM r WHERE attempted AND outcome = 'dead_recorded'"""


@query
def request_windows_stream(t: Tables) -> DataFrame:
    """Windowed request metrics of the log in four triggers; a window's last update counts."""
    root = _folder(t, "windows")
    telemetry = t.telemetry()
    days = F.dayofmonth("ts")
    for first, last in ((1, 8), (8, 16), (16, 24), (24, 32)):
        telemetry.where((days >= first) & (days < last)).write.mode("append").parquet(f"{root}/in")
        source = t.spark.readStream.schema(telemetry.schema).parquet(f"{root}/in")

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{root}/out/stream_batch={number}")

        run = (
            SI.windowed_requests(source).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        )
        run.awaitTermination()
    out = t.spark.read.parquet(f"{root}/out")
    names = [c for c in out.columns if c not in ("component", "period_start", "stream_batch")]
    newest = out.groupBy("component", "period_start").agg(F.max_by(F.struct(*names), "stream_batch").alias("r"))
    return newest.select("component", wall("period_start").alias("period_start"), "r.*")


SQL["request_windows_stream"] = O._SQL["metric_sums"]


@query
def metric_p95_rollup(t: Tables) -> DataFrame:
    """95th percentiles of five minutes and of days from stored minute summaries, held against the exact ones."""
    path = _folder(t, "latency")
    metrics.latency_summary(t.telemetry(), 60).write.parquet(path)
    minutes = t.spark.read.parquet(path)
    five = metrics.roll_up(minutes, 300)
    out = None
    for seconds, summary in ((300, five), (86_400, metrics.roll_up(five, 86_400))):
        exact = t.telemetry().groupBy("component", metrics.period_start(F.col("ts"), seconds).alias("period_start")).agg(
            F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_ms)").alias("exact")
        )
        found = metrics.summary_quantile(summary, 0.95).join(exact, ["component", "period_start"], "full")
        near = F.abs(F.col("value") - F.col("exact")) <= 0.01 * F.abs(F.col("exact")) + 1e-9
        part = found.select(
            "component", F.lit(seconds).alias("seconds"), wall("period_start").alias("period_start"), "n", "exact",
            F.coalesce(near, F.lit(False)).alias("within"),
        )
        out = part if out is None else out.unionByName(part)
    return out


SQL["metric_p95_rollup"] = f"""WITH {O._TELE}
SELECT component, CAST(300 AS INTEGER) AS seconds, time_bucket(INTERVAL 5 MINUTE, ts) AS period_start, count(*) AS n,
  quantile_disc(duration_ms, 0.95) AS exact, true AS within FROM tele GROUP BY 1, 3
UNION ALL
SELECT component, 86400, time_bucket(INTERVAL 1 DAY, ts), count(*), quantile_disc(duration_ms, 0.95), true FROM tele GROUP BY 1, 3"""


# ---- files and requests ---------------------------------------------------------


@query
def access_log_rows(t: Tables) -> DataFrame:
    """Access-log lines written as JSON and read back typed; some fields are dashes, as the gateway writes them."""
    path = _folder(t, "access-log")
    t.read("events").selectExpr(
        "concat('r-', event_id) AS requestId", "CAST(unix_millis(CAST(ts AS TIMESTAMP)) AS STRING) AS requestTimeEpoch",
        "CASE WHEN event_id % 2 = 0 THEN 'POST /jobs' ELSE 'GET /jobs/{job_id}' END AS routeKey", "'dev' AS stage",
        "CASE event_id % 5 WHEN 0 THEN '200' WHEN 1 THEN '404' WHEN 2 THEN '-' ELSE '503' END AS status",
        "CAST(event_id % 900 AS STRING) AS responseLength",
        "CASE WHEN event_id % 6 = 0 THEN '-' ELSE CAST(event_id % 77 AS STRING) END AS integrationLatency",
    ).write.json(path)
    return files.access_log(t.spark, path).select(
        F.col("requestId").alias("request_id"), wall("ts").alias("ts"), F.col("routeKey").alias("route"),
        F.coalesce(F.col("status_code"), F.lit(-1)).cast("long").alias("status_code"),
        F.col("response_bytes").cast("long").alias("response_bytes"), F.coalesce("integration_latency_ms", F.lit(-1.0)).alias("latency_ms"),
        F.coalesce("integrationErrorMessage", F.lit("-")).alias("error"),
    )


SQL["access_log_rows"] = """
SELECT 'r-' || event_id AS request_id, date_trunc('millisecond', ts) AS ts, CASE WHEN event_id % 2 = 0 THEN 'POST /jobs' ELSE 'GET /jobs/{job_id}' END AS route,
  CAST(CASE event_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN -1 ELSE 503 END AS BIGINT) AS status_code,
  event_id % 900 AS response_bytes, CAST(CASE WHEN event_id % 6 = 0 THEN -1 ELSE event_id % 77 END AS DOUBLE) AS latency_ms, '-' AS error
FROM events"""


@query
def response_headers(t: Tables) -> DataFrame:
    """Default response headers with those of the request in their place."""
    defaults = F.create_map(*[F.lit(x) for x in ("content-type", "application/json", "accept", "none")])
    merged = RQ.merge_headers(defaults, RQ.normalize_headers(F.col("headers")))
    pairs = F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return t.requests().select("doc_id", F.array_join(pairs, ";").alias("headers"))


SQL["response_headers"] = """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'accept=*/*;content-type=application/json;x-request-id=rid-' || doc_id
  WHEN 1 THEN 'accept=none;content-type=application/json;x-correlation-id=cid-' || doc_id
  WHEN 2 THEN 'accept=none;content-type=application/json;x-correlation-id=cid-' || doc_id
  ELSE 'accept=none;content-type=application/json' END AS headers FROM documents"""


@query
def request_errors(t: Tables) -> DataFrame:
    """The error document of every failed read, and how long it took; dependencies fail for some."""
    rows = t.read("events").selectExpr(
        "event_id", "value",
        "CASE event_id % 6 WHEN 0 THEN 'invalid_request' WHEN 1 THEN 'not_found' WHEN 2 THEN 'dependency_failure' "
        "WHEN 3 THEN 'internal_error' ELSE 'succeeded' END AS result",
    )
    found = RQ.classify(rows, "get", F.col("result"))
    request, correlation = F.concat(F.lit("r-"), F.col("event_id")), F.concat(F.lit("c-"), F.col("event_id"))
    document = RQ.error_payload(F.col("error_code"), F.initcap(F.col("result")), request, correlation)
    return found.where("error_code is not null").select(
        "event_id", F.col("status_code").cast("long").alias("status_code"), document.alias("document"),
        TM.duration_ms(F.col("value") / 7 - 1).alias("duration_ms"),
    )


SQL["request_errors"] = """
SELECT event_id, CAST(CASE event_id % 6 WHEN 0 THEN 400 WHEN 1 THEN 404 WHEN 2 THEN 503 ELSE 500 END AS BIGINT) AS status_code,
  '{"error":{"code":"' || CASE event_id % 6 WHEN 0 THEN 'invalid_request' WHEN 1 THEN 'job_not_found' WHEN 2 THEN 'service_unavailable' ELSE 'internal_error' END
    || '","message":"' || CASE event_id % 6 WHEN 0 THEN 'Invalid_request' WHEN 1 THEN 'Not_found' WHEN 2 THEN 'Dependency_failure' ELSE 'Internal_error' END
    || '","request_id":"r-' || event_id || '","correlation_id":"c-' || event_id || '"}}' AS document,
  round(greatest(0, value / 7 - 1) * 1000, 3) AS duration_ms
FROM events WHERE event_id % 6 < 4"""


@query
def change_set_pruned(t: Tables) -> DataFrame:
    """The change set of two stored snapshots, from the leaves of their trees that differ."""
    paths = [_folder(t, n) for n in ("before", "after")]
    for snapshot, path in zip(t.snapshots(), paths):
        snapshots.write_snapshot(snapshot, path, leaves=4096, folders=32)
    return snapshots.changes_between(t.spark, *paths)


SQL["change_set_pruned"] = f"WITH {O._CHANGES} SELECT key, entity, action FROM chg WHERE action <> 'no-op'"


@query
def object_versions(t: Tables) -> DataFrame:
    """References by version and to the latest: two versions of each object, one of them not UTF-8 here and there."""
    d = t.read("documents")
    size = F.octet_length("content").cast("long")

    def version(name: str, content, latest) -> DataFrame:
        return d.select(
            "doc_id", F.expr("concat('documents/job-', doc_id, '/source.txt')").alias("object_key"), F.lit(name).alias("version_id"),
            latest.alias("is_latest"), content.alias("content"),
        ).select("*", size.alias("size_bytes"), F.lit("text/plain").alias("content_type"), F.md5("content").alias("etag"),
                 F.lit(None).cast("string").alias("load_error"))

    broken = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("fffe")))
    first = version("v1", F.when(F.col("doc_id") % 19 == 0, broken).otherwise(F.col("text").cast("binary")), F.col("doc_id") % 5 == 0)
    second = version("v2", F.concat(F.col("text"), F.lit("!")).cast("binary"), F.col("doc_id") % 5 != 0)
    stored = first.unionByName(second)
    asked = F.expr("CASE doc_id % 4 WHEN 0 THEN 'v1' WHEN 1 THEN 'v2' WHEN 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'v9' END END")
    named = d.select("doc_id", F.expr("concat('documents/job-', doc_id, '/source.txt')").alias("object_key"), asked.alias("version_id"))
    sizes = first.select("doc_id", F.col("size_bytes").alias("s1"), F.col("etag").alias("e1")).join(
        second.select("doc_id", F.col("size_bytes").alias("s2"), F.col("etag").alias("e2")), "doc_id"
    )
    one = (F.col("version_id") == "v1") | (F.col("version_id").isNull() & (F.col("doc_id") % 5 == 0))
    references = named.join(sizes, "doc_id").select(
        "doc_id", "object_key", "version_id", F.when(one, F.col("s1")).otherwise(F.col("s2")).alias("object_size"),
        F.when(one, F.col("e1")).otherwise(F.col("e2")).alias("etag"),
    )
    loaded = O_.load_documents(references, stored.drop("doc_id"), CONFIG)
    return loaded.select(
        "doc_id", F.coalesce("version_id", F.lit("latest")).alias("asked"), F.coalesce("object_error", F.lit("usable")).alias("object_error"),
        F.coalesce(F.md5("document_text"), F.lit("-")).alias("text"),
    )


SQL["object_versions"] = """WITH r AS (
  SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN 'v1' WHEN 1 THEN 'v2' WHEN 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'v9' END END AS asked,
    strlen(text) AS n FROM documents
), s AS (
  SELECT *, coalesce(asked, CASE WHEN doc_id % 5 = 0 THEN 'v1' ELSE 'v2' END) AS stored FROM r
), e AS (
  SELECT *, CASE WHEN n + CASE WHEN stored = 'v1' THEN CASE WHEN doc_id % 19 = 0 THEN 2 ELSE 0 END ELSE 1 END > 2048 THEN 'document_validation_failed'
    WHEN stored = 'v9' THEN 'document_not_found' WHEN stored = 'v1' AND doc_id % 19 = 0 THEN 'document_validation_failed' ELSE 'usable' END AS object_error FROM s
)
SELECT doc_id, coalesce(asked, 'latest') AS asked, object_error,
  CASE WHEN object_error <> 'usable' THEN '-' WHEN stored = 'v1' THEN md5(text) ELSE md5(text || '!') END AS text FROM e"""


@query
def process_bounded(t: Tables) -> DataFrame:
    """The batch with an extractor that runs in five tasks at most."""
    run = P.process_uploads(
        t.messages(), t.jobs(), t.objects(), as_of=AS_OF, config=CONFIG, plan=t.provider_plan(),
        extractor=extract.bounded(extract.rule_extractor, 5),
    )
    return _record_view(run.records)


SQL["process_bounded"] = O._SQL["process_batch_outcomes"]


# ---- rules that few rows reach --------------------------------------------------


@query
def serialized_sizes(t: Tables) -> DataFrame:
    """Results about the size limit: a long field, in characters of one and of two bytes."""
    rows = t.read("documents").selectExpr(
        "doc_id",
        "concat('{\"document_type\":\"report\",\"summary\":\"s\",\"key_fields\":{\"t\":\"', "
        "repeat(CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE 'é' END, 32500 - doc_id % 2 * 16250 + doc_id % 300), "
        "'\"},\"confidence\":0.5,\"requires_human_review\":false}') AS text",
    )
    judged = extract.with_contract(rows.withColumn("payload", V.parse_strict(F.col("text"))), "payload")
    return judged.select("doc_id", text_or_none("contract_error").alias("contract_error"), F.octet_length("result_json").cast("long").alias("bytes"))


_SIZE = "octet_length(encode('{\"document_type\":\"report\",\"summary\":\"s\",\"key_fields\":{\"t\":\"\"},\"confidence\":0.5,\"requires_human_review\":false}'))"
SQL["serialized_sizes"] = f"""WITH s AS (
  SELECT doc_id, {_SIZE} + CASE WHEN doc_id % 2 = 0 THEN 32500 + doc_id % 300 ELSE 2 * (16250 + doc_id % 300) END AS n FROM documents
)
SELECT doc_id, CASE WHEN n > 32768 THEN 'serialized_size' ELSE '-' END AS contract_error, CAST(CASE WHEN n <= 32768 THEN n END AS BIGINT) AS bytes FROM s"""


@query
def canonical_rows(t: Tables) -> DataFrame:
    rows = changes.change_set(*t.snapshots())
    return rows.select("key", changes.row_text(rows).alias("line"))


SQL["canonical_rows"] = f"""WITH {O._CHANGES}
SELECT key, '{{"action":"' || action || '","entity":"' || entity || '","key":"' || key || '"}}' AS line FROM chg"""


@query
def number_texts(t: Tables) -> DataFrame:
    """Numbers as the item store returns them: integral values lose their fraction, others keep it."""
    halves = F.round(F.col("value") * 2) / 2
    return t.read("events").select("event_id", V.normalize_number(halves).alias("number"))


SQL["number_texts"] = """
SELECT event_id, CASE WHEN h = floor(h) THEN CAST(CAST(h AS BIGINT) AS VARCHAR) ELSE CAST(h AS VARCHAR) END AS number
FROM (SELECT event_id, round(value * 2) / 2 AS h FROM events)"""


@query
def foreign_objects(t: Tables) -> DataFrame:
    """Events that name another job's object: no claim, and no say in who wins."""
    events = intake.flatten_events(P.parse_once(t.messages(), CONFIG)).withColumn("n", F.substring("message_id", 3, 20).cast("long"))
    other = F.when(F.col("n") % 5 == 0, F.lit("documents/job-other/source.txt")).otherwise(F.col("object_key"))
    routed = J.route_claims(events.withColumn("object_key", other), t.jobs(), AS_OF, P.ARRIVAL, CONFIG)
    return routed.select("message_id", "start_outcome")


SQL["foreign_objects"] = f"""WITH {O._MSG}, w AS (
  SELECT doc_id, arg_min(event_id, ts) AS winner FROM msg WHERE error_class = 'ok' AND event_id % 5 <> 0 GROUP BY doc_id
)
SELECT message_id, CASE WHEN doc_id % 31 = 0 THEN 'job_not_found' WHEN event_id % 5 = 0 THEN 'conflict'
  WHEN doc_id % 10 IN (8, 9) THEN 'effect_already_applied' WHEN doc_id % 10 = 6 THEN 'processing_already_active'
  WHEN event_id = winner THEN 'claim_acquired' ELSE 'processing_already_active' END AS start_outcome
FROM msg LEFT JOIN w USING (doc_id) WHERE error_class = 'ok'"""


@query
def message_verdicts(t: Tables) -> DataFrame:
    """Messages of up to two records: failed if any record failed."""
    return _processed(t, two_records=True).messages.select("message_id", "failed")


SQL["message_verdicts"] = f"""WITH {O._MSG}, {O._ROUTED}, {O._CLAIMED}, {O._SECOND}
SELECT m.message_id, m.error_class <> 'ok' OR coalesce(bool_or(f.retry_reason IS NOT NULL), false) AS failed
FROM msg m LEFT JOIN (SELECT message_id, retry_reason FROM first_every UNION ALL SELECT message_id, retry_reason FROM second_every) f USING (message_id)
GROUP BY m.message_id, m.error_class"""


@query
def redact_foreign_digits(t: Tables) -> DataFrame:
    """Account numbers in other digits, of twelve and of thirteen, and a resource name before a wide space."""
    number = "lpad(CAST(doc_id AS STRING), 12 + CAST(doc_id % 3 = 0 AS INT), '1')"
    made = t.read("documents").selectExpr(
        "doc_id",
        f"concat('id ', CASE WHEN doc_id % 2 = 0 THEN translate({number}, '0123456789', '\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669') "
        f"ELSE translate({number}, '0123456789', '\u0966\u0967\u0968\u0969\u096a\u096b\u096c\u096d\u096e\u096f') END, "
        "' arn:aws:s3:::', doc_id, '\u2003end') AS text",
    )
    return made.select("doc_id", X.redact(F.col("text")).alias("redacted"))


SQL["redact_foreign_digits"] = """
SELECT doc_id, 'id ' || CASE WHEN doc_id % 3 <> 0 THEN '<account-id>'
  WHEN doc_id % 2 = 0 THEN translate(lpad(CAST(doc_id AS VARCHAR), 13, '1'), '0123456789', '\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669')
  ELSE translate(lpad(CAST(doc_id AS VARCHAR), 13, '1'), '0123456789', '\u0966\u0967\u0968\u0969\u096a\u096b\u096c\u096d\u096e\u096f') END
  || ' <arn>\u2003end' AS redacted FROM documents"""
