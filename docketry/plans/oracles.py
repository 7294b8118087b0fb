"""DuckDB SQL for the catalogue, built from row-id arithmetic.

The SQL does not parse messages or call library rules where the expected value
follows from how a row was made; shared pieces are common table expressions.
"""

from __future__ import annotations

_SQL: dict[str, str] = {}

_JOBS = """
jobs AS (
  SELECT doc_id, 'job-' || doc_id AS job_id,
    CASE WHEN doc_id % 10 IN (6, 7) THEN 'processing' WHEN doc_id % 10 = 8 THEN 'succeeded'
         WHEN doc_id % 10 = 9 THEN 'failed' ELSE 'pending_upload' END AS status,
    CAST(CASE WHEN doc_id % 10 >= 5 THEN 1 ELSE 0 END AS BIGINT) AS attempts
  FROM documents WHERE doc_id % 31 <> 0
)"""

# one row per message: what it holds and how it must be classified
_MSG = """
msg AS MATERIALIZED (
  SELECT e.event_id, e.ts, e.event_type, d.doc_id, 'm-' || e.event_id AS message_id,
    'job-' || d.doc_id AS job_id, md5(d.text) AS etag, d.text,
    CAST(strlen(d.text) + CASE WHEN e.event_id % 59 = 0 THEN 1 ELSE 0 END AS BIGINT) AS object_size,
    e.event_id % 53 <> 0 AS has_etag,
    CASE WHEN e.event_id % 47 = 0 THEN 'malformed_queue_message'
         WHEN e.event_id % 37 = 0 THEN 'unsupported_s3_event'
         WHEN e.event_id % 41 = 0 THEN 'unexpected_s3_bucket'
         WHEN e.event_id % 43 = 0 THEN 'invalid_document_object_key'
         ELSE 'ok' END AS error_class,
    (e.event_id + 1) % e.n AS doc2
  FROM (SELECT event_id, ts, event_type, n, event_id % n AS doc_id FROM events, (SELECT count(*) AS n FROM documents)) e
  JOIN documents d USING (doc_id)
)"""

# start outcome of the (first) record of each accepted message
_ROUTED = """
claim_first AS (
  SELECT doc_id, arg_min(event_id, ts) AS winner FROM msg WHERE error_class = 'ok' GROUP BY doc_id
),
routed AS (
  SELECT m.*,
    CASE WHEN m.doc_id % 31 = 0 THEN 'job_not_found'
         WHEN m.doc_id % 10 IN (8, 9) THEN 'effect_already_applied'
         WHEN m.doc_id % 10 = 6 THEN 'processing_already_active'
         WHEN m.event_id = c.winner THEN 'claim_acquired'
         ELSE 'processing_already_active' END AS start_outcome
  FROM msg m JOIN claim_first c USING (doc_id) WHERE m.error_class = 'ok'
)"""


def _object_error(size: str, has_etag: str, doc: str, wrong_size: str, text: str) -> str:
    return f"""CASE WHEN NOT ({has_etag}) THEN 'invalid_document_reference'
         WHEN {size} > 2048 THEN 'document_validation_failed'
         WHEN {doc} % 29 = 0 THEN 'document_not_found'
         WHEN {doc} % 97 = 5 THEN 'document_dependency_error'
         WHEN strlen({text}) > 2048 OR {doc} % 23 = 0 OR {wrong_size} THEN 'document_validation_failed' END"""


def _effect(prefix: str, doc: str, text: str) -> str:
    """Failure reason and retry reason of an acquired claim."""
    return f"""
    CASE WHEN {prefix}object_error IS NOT NULL THEN NULLIF({prefix}object_error, 'document_dependency_error')
         WHEN NOT regexp_matches({text}, '[^\\s]') THEN 'invalid_provider_request'
         WHEN {doc} % 17 = 3 THEN 'ai_provider_invalid_response' END AS failure_reason,
    CASE WHEN {prefix}object_error = 'document_dependency_error' THEN 'document_dependency_error'
         WHEN {prefix}object_error IS NOT NULL OR NOT regexp_matches({text}, '[^\\s]') THEN NULL
         WHEN {doc} % 17 = 0 THEN 'provider_timeout' WHEN {doc} % 17 = 1 THEN 'provider_throttled'
         WHEN {doc} % 17 = 2 THEN 'provider_unavailable' WHEN {doc} % 17 = 4 THEN 'unexpected' END AS retry_reason"""


_CLAIMED = f"""
checked AS (
  SELECT *, {_object_error('object_size', 'has_etag', 'doc_id', 'event_id % 59 = 0', 'text')} AS object_error
  FROM routed
),
ran AS (
  SELECT *, {_effect('', 'doc_id', 'text')} FROM checked WHERE start_outcome = 'claim_acquired'
)"""

_RECORD_COLUMNS = """
  CASE WHEN start_outcome = 'effect_already_applied' THEN 'effect_already_applied'
       WHEN start_outcome <> 'claim_acquired' OR retry_reason IS NOT NULL THEN '-'
       WHEN failure_reason IS NOT NULL THEN 'terminal_failure_recorded' ELSE 'processed' END AS outcome,
  coalesce(failure_reason, '-') AS failure_reason, coalesce(retry_reason, '-') AS retry_reason,
  CASE WHEN retry_reason IS NULL THEN '-' WHEN retry_reason = 'unexpected' THEN 'unexpected_processing_error'
       ELSE 'uploaded_document_processing_error' END AS error_code,
  retry_reason IS NOT NULL AS failed"""

_REST = """
  SELECT message_id, job_id, start_outcome, NULL AS failure_reason,
    CASE WHEN start_outcome = 'effect_already_applied' THEN NULL ELSE start_outcome END AS retry_reason
  FROM {source} WHERE start_outcome <> 'claim_acquired'"""

_REJECTED = """
SELECT message_id, CAST(-1 AS BIGINT) AS rec_pos, '-' AS job_id, '-' AS start_outcome, '-' AS outcome,
  '-' AS failure_reason, error_class AS retry_reason, 'event_parsing_error' AS error_code, true AS failed
FROM msg WHERE error_class <> 'ok'"""

_SQL["classify_messages"] = f"""WITH {_MSG}
SELECT message_id, error_class, CASE WHEN error_class = 'ok' THEN job_id ELSE '-' END AS job_id FROM msg"""

_SQL["error_class_counts"] = f"""WITH {_MSG}, {_ROUTED}
SELECT 'ok' AS error_class, start_outcome, count(*) AS n FROM routed GROUP BY start_outcome
UNION ALL
SELECT error_class, '-' AS start_outcome, count(*) AS n FROM msg WHERE error_class <> 'ok' GROUP BY error_class"""

_SQL["flatten_two_record_messages"] = f"""WITH {_MSG}
SELECT message_id, CAST(0 AS BIGINT) AS rec_pos, job_id, 'documents/' || job_id || '/source.txt' AS object_key,
  object_size, CASE WHEN has_etag THEN etag ELSE '-' END AS etag FROM msg WHERE error_class = 'ok'
UNION ALL
SELECT m.message_id, CAST(1 AS BIGINT), 'job-' || d.doc_id, 'documents/job-' || d.doc_id || '/source.txt',
  CAST(strlen(d.text) AS BIGINT), md5(d.text)
FROM msg m JOIN documents d ON d.doc_id = m.doc2 WHERE m.error_class = 'ok' AND m.event_id % 7 = 0"""

_SQL["event_model_checks"] = f"""WITH {_MSG}
SELECT message_id, concat_ws(';',
  CASE WHEN event_id % 7 = 1 THEN 'bucket_name is blank' END,
  CASE WHEN event_id % 17 = 1 THEN 'etag is blank' END,
  CASE WHEN event_id % 5 = 1 THEN 'event_name is not a creation' END,
  CASE WHEN event_id % 13 = 1 THEN 'object_size is negative' END,
  CASE WHEN event_id % 11 = 1 THEN 'object_key has another owner' END) AS violations
FROM msg"""

_SQL["latest_by_sequencer"] = """
SELECT 'documents/job-' || doc || '/source.txt' AS object_key,
  lower(format('{:x}', max(seq))) AS sequencer, 'm-' || arg_max(event_id, seq) AS message_id
FROM (SELECT event_id, event_id % (SELECT count(*) FROM documents) AS doc, event_id * 7919 % 100003 AS seq FROM events)
GROUP BY doc"""

_SQL["claim_route"] = f"""WITH {_MSG}, {_ROUTED} SELECT message_id, job_id, start_outcome FROM routed"""

_SQL["claim_winner"] = f"""WITH {_MSG}, {_ROUTED}
SELECT job_id, message_id,
  'attempt_' || md5(job_id || '|' || message_id || '|' || (event_id % 4 + 1)) AS attempt_id,
  TIMESTAMP '2024-02-01 00:05:00' AS lease_expires_at,
  CAST(CASE WHEN doc_id % 10 >= 5 THEN 2 ELSE 1 END AS BIGINT) AS attempts
FROM routed WHERE start_outcome = 'claim_acquired'"""

_REQ = """
req AS (
  SELECT doc_id, 'key-' || doc_id AS event_key,
    'job-' || CASE WHEN doc_id % 6 = 0 THEN doc_id ELSE doc_id + 1000000000 END AS job_id,
    CASE WHEN doc_id % 4 = 0 THEN 'rid-' || doc_id WHEN doc_id % 3 = 0 THEN 'gw-' || doc_id
         ELSE 'req_' || sha256('key-' || doc_id) END AS request_id,
    CASE WHEN doc_id % 40 = 2 OR doc_id % 8 IN (4, 5, 6) THEN 'invalid_request'
         WHEN doc_id % 6 = 0 AND doc_id % 31 <> 0 THEN 'conflict' ELSE 'succeeded' END AS outcome
  FROM documents
)"""

_SQL["create_jobs_anti"] = f"""WITH {_REQ}
SELECT event_key, job_id, request_id,
  CASE WHEN doc_id % 4 IN (1, 2) THEN 'cid-' || doc_id ELSE request_id END AS correlation_id, outcome,
  CAST(CASE outcome WHEN 'invalid_request' THEN 400 WHEN 'conflict' THEN 409 ELSE 201 END AS BIGINT) AS status_code,
  CASE outcome WHEN 'invalid_request' THEN 'invalid_request' WHEN 'conflict' THEN 'job_conflict' ELSE '-' END AS error_code,
  CASE outcome WHEN 'succeeded' THEN 'documents/' || job_id || '/source.txt' ELSE '-' END AS object_key
FROM req"""

_SQL["created_rows"] = f"""WITH {_REQ}
SELECT 'JOB#' || job_id AS "PK", job_id, 'pending_upload' AS status, CAST(0 AS BIGINT) AS attempts,
  CASE WHEN doc_id % 4 IN (1, 2) THEN 'cid-' || doc_id ELSE request_id END AS correlation_id,
  TIMESTAMP '2024-02-01 00:00:00' AS created_at
FROM req WHERE outcome = 'succeeded'"""

_SQL["insert_conflicts"] = f"""WITH {_JOBS}, rows AS (
  SELECT event_id, user_id, 'job-' || (event_id % 1500) AS job_id FROM events
), first AS (SELECT job_id, min(event_id) AS f FROM rows GROUP BY job_id)
SELECT r.job_id, 'corr-' || r.user_id AS correlation_id, r.event_id,
  CASE WHEN r.event_id = first.f AND r.job_id NOT IN (SELECT job_id FROM jobs) THEN 'inserted' ELSE 'conflict' END AS result
FROM rows r JOIN first USING (job_id)"""

_SQL["job_lookup"] = f"""WITH {_JOBS}, asked AS (
  SELECT doc_id, 'get-' || doc_id AS event_key, CASE WHEN doc_id % 37 > 1 THEN 'job-' || doc_id END AS job_id FROM documents
)
SELECT a.event_key, coalesce(a.job_id, '-') AS job_id, coalesce(j.status, '-') AS status,
  coalesce(j.attempts, -1) AS attempts,
  CASE WHEN j.status = 'failed' THEN 'document_not_found' ELSE '-' END AS error_reason,
  CASE WHEN a.job_id IS NULL THEN 'invalid_request' WHEN j.job_id IS NULL THEN 'not_found' ELSE 'succeeded' END AS outcome,
  CAST(CASE WHEN a.job_id IS NULL THEN 400 WHEN j.job_id IS NULL THEN 404 ELSE 200 END AS BIGINT) AS status_code
FROM asked a LEFT JOIN jobs j USING (job_id)"""

_SQL["conditional_claims"] = """
SELECT 'job-' || doc_id AS job_id, 'new-' || doc_id AS attempt_id,
  CASE WHEN doc_id % 31 = 0 THEN 'job_not_found' WHEN doc_id % 10 = 6 THEN 'claim_conflict'
       WHEN doc_id % 10 IN (8, 9) OR doc_id % 12 = 5 THEN 'state_conflict' ELSE 'applied' END AS result
FROM documents"""

_SQL["claimed_job_rows"] = f"""WITH {_JOBS}
SELECT job_id, 'processing' AS status, attempts + 1 AS attempts, 'new-' || doc_id AS active_attempt_id,
  TIMESTAMP '2024-02-01 00:05:00' AS lease_expires_at
FROM jobs WHERE doc_id % 10 NOT IN (6, 8, 9)"""

_SQL["contended_claims"] = """
SELECT 'job-' || doc_id AS job_id, who || '-' || doc_id AS attempt_id,
  CASE WHEN doc_id % 31 = 0 THEN 'job_not_found' WHEN doc_id % 10 = 6 THEN 'claim_conflict'
       WHEN doc_id % 10 IN (8, 9) THEN 'state_conflict' WHEN who = 'later' THEN 'claim_conflict' ELSE 'applied' END AS result
FROM documents, (VALUES ('first'), ('later'), ('first')) w(who)"""

_SQL["contended_claim_rows"] = f"""WITH {_JOBS}
SELECT job_id, CASE WHEN doc_id % 10 IN (8, 9) THEN status ELSE 'processing' END AS status,
  CASE WHEN doc_id % 10 IN (8, 9) THEN '-' WHEN doc_id % 10 = 6 THEN 'attempt-' || doc_id ELSE 'first-' || doc_id END AS active_attempt_id
FROM jobs"""

_FINAL_RESULT = """
final AS (
  SELECT doc_id, 'job-' || doc_id AS job_id,
    CASE doc_id % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'fail' ELSE 'release' END AS operation,
    CASE WHEN doc_id % 31 = 0 THEN 'job_not_found'
         WHEN doc_id % 10 NOT IN (6, 7) THEN 'state_conflict'
         WHEN doc_id % 4 = 3 THEN 'attempt_mismatch'
         WHEN doc_id % 9 = 4 THEN 'state_conflict'
         WHEN doc_id % 8 = 6 OR (doc_id % 3 = 0 AND doc_id % 5 = 2) OR (doc_id % 3 = 1 AND doc_id % 7 = 0)
           THEN 'invalid_value' ELSE 'applied' END AS result
  FROM documents
)"""

_SQL["conditional_finalize"] = f"WITH {_FINAL_RESULT} SELECT job_id, operation, result FROM final"

# a later release applies only where the first update had a value at fault
_SQL["contended_finalize"] = f"""WITH {_FINAL_RESULT}
SELECT job_id, 'first' AS who, result FROM final
UNION ALL
SELECT job_id, 'later', CASE result WHEN 'applied' THEN 'state_conflict' WHEN 'invalid_value' THEN 'applied' ELSE result END FROM final"""

_SQL["contended_final_rows"] = f"""WITH {_JOBS}, {_FINAL_RESULT}
SELECT j.job_id, CASE WHEN f.result = 'invalid_value' THEN 'pending_upload' WHEN f.result <> 'applied' THEN j.status
  WHEN operation = 'complete' THEN 'succeeded' WHEN operation = 'fail' THEN 'failed' ELSE 'pending_upload' END AS status
FROM jobs j JOIN final f USING (doc_id)"""

_SQL["finalized_job_rows"] = f"""WITH {_JOBS}, {_FINAL_RESULT}
SELECT j.job_id,
  CASE WHEN f.result <> 'applied' THEN j.status WHEN operation = 'complete' THEN 'succeeded'
       WHEN operation = 'fail' THEN 'failed' ELSE 'pending_upload' END AS status,
  j.attempts,
  CASE WHEN j.status = 'processing' AND f.result <> 'applied' THEN 'attempt-' || j.doc_id ELSE '-' END AS active_attempt_id,
  CASE WHEN f.result = 'applied' AND operation = 'complete' THEN '{{"ok":true}}'
       WHEN j.status = 'succeeded' THEN '{{}}' ELSE '-' END AS processing_result,
  CASE WHEN f.result = 'applied' AND operation = 'fail' OR j.status = 'failed' THEN 'document_not_found' ELSE '-' END AS error_reason,
  CASE WHEN f.result = 'applied' THEN TIMESTAMP '2024-02-01 00:00:00' ELSE TIMESTAMP '2024-01-31 12:00:00' END AS updated_at
FROM jobs j JOIN final f USING (doc_id)"""

_SQL["conditional_dead_marks"] = """
SELECT 'job-' || doc_id AS job_id,
  CASE WHEN doc_id % 31 = 0 THEN 'job_not_found' WHEN doc_id % 10 IN (8, 9) THEN 'effect_already_applied'
       WHEN doc_id % 9 = 4 OR doc_id % 10 < 5 THEN 'state_conflict' ELSE 'applied' END AS result
FROM documents"""

_SQL["contended_dead_marks"] = """
SELECT 'job-' || doc_id AS job_id, TIMESTAMP '2024-02-01' + late * INTERVAL 1 SECOND AS marked_at,
  CASE WHEN doc_id % 31 = 0 THEN 'job_not_found' WHEN doc_id % 10 IN (8, 9) THEN 'effect_already_applied'
       WHEN doc_id % 10 < 5 THEN 'state_conflict' WHEN late = 1 THEN 'effect_already_applied' ELSE 'applied' END AS result
FROM documents, (VALUES (0), (1)) l(late)"""

_SQL["job_audit"] = f"""WITH {_JOBS}, k AS (
  SELECT job_id, doc_id % 16 AS d, doc_id % 10 AS r, status FROM jobs
)
SELECT job_id, concat_ws(';',
  CASE WHEN d = 8 THEN 'created_at is not a UTC timestamp' END,
  CASE WHEN d = 4 THEN 'updated_at is not a UTC timestamp' END,
  CASE WHEN d = 0 THEN 'entity_type' END,
  CASE WHEN d = 1 THEN 'partition_key' END,
  CASE WHEN d = 2 THEN 'status_unknown' END,
  CASE WHEN d = 3 THEN 'request_id_blank' END,
  CASE WHEN d = 8 THEN 'created_at_missing' END,
  CASE WHEN d = 4 THEN 'updated_at_missing' END,
  CASE WHEN d = 7 THEN 'updated_before_created' END,
  CASE WHEN d = 5 THEN 'attempts_negative' END,
  CASE WHEN d = 6 THEN 'attempt_incomplete' END,
  CASE WHEN d = 6 AND status <> 'processing' THEN 'attempt_not_allowed' END,
  CASE WHEN d = 5 AND status <> 'pending_upload' THEN 'attempts_required' END,
  CASE WHEN d IN (9, 10) AND status <> 'failed' AND d <> 2 THEN 'reason_not_allowed' END,
  CASE WHEN d = 10 AND status = 'failed' THEN 'reason_required' END) AS violations
FROM k"""

_SQL["item_encoding"] = f"""WITH {_JOBS}
SELECT 'JOB#' || job_id AS "PK", status, '2024-01-31T12:00:00+00:00' AS updated_at,
  CASE doc_id % 10 WHEN 6 THEN '2024-02-01T00:05:00+00:00' WHEN 7 THEN '2024-02-01T00:00:00+00:00' ELSE '-' END AS lease_expires_at
FROM jobs"""

_STATUS = """
steps AS (
  SELECT 'u-' || user_id AS job_id, user_id, event_id, ts,
    CASE event_type WHEN 'click' THEN 'pending_upload' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'succeeded'
      WHEN 'signup' THEN 'failed' ELSE 'dead' END AS status,
    ts + to_hours(event_id % 10 * 12) AS updated_at
  FROM events
)"""

_SQL["latest_state"] = f"""WITH {_STATUS}
SELECT job_id, arg_max(event_id, ts) AS event_id, arg_max(status, ts) AS status FROM steps GROUP BY job_id"""

_SQL["illegal_transitions"] = f"""WITH {_STATUS}, s AS (
  SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_status FROM steps
)
SELECT job_id, event_id, prev_status, status FROM s
WHERE prev_status IS NOT NULL AND prev_status <> status AND NOT (
  (prev_status = 'pending_upload' AND status = 'processing')
  OR (prev_status = 'processing' AND status IN ('pending_upload', 'succeeded', 'failed', 'dead')))"""

_SQL["timestamp_regressions"] = f"""WITH {_STATUS}, s AS (
  SELECT *, lag(updated_at) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_updated_at FROM steps
)
SELECT job_id, event_id, updated_at, prev_updated_at FROM s WHERE updated_at < prev_updated_at"""

_SQL["history_fold"] = """WITH RECURSIVE d AS (
  SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
    count(*) OVER (PARTITION BY user_id) AS total FROM events
), f AS (
  SELECT user_id, CAST(0 AS BIGINT) AS rn, 'pending_upload' AS status, CAST(0 AS BIGINT) AS attempts,
    CAST(NULL AS TIMESTAMP) AS lease, CAST(NULL AS TIMESTAMP) AS updated_at, CAST(0 AS BIGINT) AS active,
    CAST(0 AS BIGINT) AS applied, any_value(total) AS deliveries FROM d GROUP BY user_id
  UNION ALL
  SELECT f.user_id, d.rn,
    CASE WHEN f.status IN ('succeeded', 'failed') OR f.lease > d.ts THEN f.status
         WHEN d.event_type = 'purchase' THEN 'succeeded' WHEN d.event_type = 'signup' THEN 'failed'
         WHEN d.event_type = 'error' THEN 'pending_upload' ELSE 'processing' END,
    f.attempts + CASE WHEN f.status IN ('succeeded', 'failed') OR f.lease > d.ts THEN 0 ELSE 1 END,
    CASE WHEN f.status IN ('succeeded', 'failed') OR f.lease > d.ts THEN f.lease
         WHEN d.event_type IN ('click', 'view') THEN d.ts + INTERVAL 21600 SECOND END,
    CASE WHEN f.status IN ('succeeded', 'failed') OR f.lease > d.ts THEN f.updated_at ELSE d.ts END,
    f.active + CASE WHEN f.status NOT IN ('succeeded', 'failed') AND f.lease > d.ts THEN 1 ELSE 0 END,
    f.applied + CASE WHEN f.status IN ('succeeded', 'failed') THEN 1 ELSE 0 END,
    f.deliveries
  FROM f JOIN d ON d.user_id = f.user_id AND d.rn = f.rn + 1
)
SELECT 'u-' || user_id AS job_id, status, attempts, updated_at, active, applied, deliveries FROM f WHERE rn = deliveries"""

_SQL["object_checks"] = f"""WITH {_MSG}, c AS (
  SELECT *, {_object_error('object_size', 'has_etag', 'doc_id', 'event_id % 59 = 0', 'text')} AS e FROM msg WHERE error_class = 'ok'
)
SELECT message_id, job_id, coalesce(e, 'usable') AS object_error,
  CASE WHEN e IS NULL THEN CAST(strlen(text) AS BIGINT) ELSE -1 END AS text_bytes FROM c"""

_SPACE = r"[\x1c-\x1f\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NOT_SPACE = _SPACE.replace("[", "[^", 1)
_TEXTS = f"""
texts AS (
  SELECT doc_id, '  ' || CASE doc_id % 5 WHEN 0 THEN 'Invoice ' WHEN 1 THEN 'Service contract '
    WHEN 2 THEN 'Quarterly report ' WHEN 3 THEN 'Internal note ' ELSE '' END || text || chr(10) AS document_text
  FROM documents
), stripped AS (
  SELECT doc_id, regexp_replace(regexp_replace(document_text, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS s FROM texts
)"""

_SQL["extract_rules"] = f"""WITH {_TEXTS}
SELECT doc_id,
  CASE WHEN contains(lower(s), 'invoice') THEN 'invoice'
       WHEN contains(lower(s), 'contract') OR contains(lower(s), 'agreement') THEN 'contract'
       WHEN contains(lower(s), 'report') THEN 'report' WHEN contains(lower(s), 'internal note') THEN 'internal_note'
       ELSE 'unknown' END AS document_type,
  CASE WHEN length(s) <= 200 THEN s ELSE regexp_replace(s[1:197], '{_SPACE}+$', '') || '...' END AS summary,
  CAST(length(s) AS BIGINT) AS character_count,
  CAST(len(regexp_extract_all(s, '{_NOT_SPACE}+')) AS BIGINT) AS word_count,
  CAST(0.85 AS DOUBLE) AS confidence, false AS requires_human_review
FROM stripped"""

_SQL["provider_prompts"] = f"""WITH {_TEXTS}
SELECT doc_id, md5('Analyze the untrusted document below according to the required output contract.' || chr(10) || chr(10)
  || '<untrusted_document>' || chr(10) || document_text || chr(10) || '</untrusted_document>') AS prompt_md5,
  CASE WHEN regexp_matches(document_text, '{_NOT_SPACE}') THEN '-' ELSE 'invalid_provider_request' END AS request_error
FROM texts"""

_SQL["response_validation"] = """WITH r AS (
  SELECT *, CASE WHEN doc_id % 23 = 11 THEN NULL WHEN doc_id % 19 = 7 THEN 'envelope'
    ELSE CASE doc_id % 13 WHEN 1 THEN 'json' WHEN 2 THEN 'json' WHEN 3 THEN 'json' WHEN 4 THEN 'not_an_object'
      WHEN 5 THEN 'fields' WHEN 6 THEN 'summary' WHEN 7 THEN 'document_type' WHEN 8 THEN 'requires_human_review'
      WHEN 9 THEN 'confidence' WHEN 10 THEN 'key_fields' WHEN 11 THEN 'key_fields' WHEN 12 THEN 'key_fields' END END AS step,
    doc_id % 23 = 11 AS failed_call FROM documents
)
SELECT doc_id,
  CASE WHEN failed_call THEN 'throttled' WHEN step IS NOT NULL THEN 'invalid_response' ELSE 'succeeded' END AS verdict,
  coalesce(step, '-') AS invalid_step,
  CASE WHEN failed_call OR step IS NOT NULL THEN 'warning' ELSE 'info' END AS severity, failed_call AS retryable,
  CASE WHEN NOT failed_call AND step IS NULL THEN '{"document_type":"report","summary":"doc ' || doc_id
    || '","key_fields":{"lang":"' || lang || '"},"confidence":0.5,"requires_human_review":true}' ELSE '-' END AS result_json,
  n_chars AS input_tokens, CAST(doc_id % 50 AS BIGINT) AS output_tokens,
  CASE WHEN doc_id % 19 = 7 THEN 'max_tokens' ELSE 'end_turn' END AS stop_reason
FROM r"""

_TELE = """
tele AS (
  SELECT event_id, ts, event_type, user_id,
    CASE event_id % 4 WHEN 0 THEN 'create_job' WHEN 1 THEN 'get_job' WHEN 2 THEN 'processor' ELSE 'reconciler' END AS component,
    CASE WHEN event_id % 4 IN (0, 1) THEN 'request.completed'
      WHEN event_id % 4 = 3 THEN 'reconciliation.record_completed'
      WHEN event_type = 'error' THEN 'processing.record_failed'
      WHEN event_id % 3 = 0 THEN 'ai_provider.invocation_completed' ELSE 'processing.record_completed' END AS event_name,
    CASE event_type WHEN 'purchase' THEN 'processed' WHEN 'signup' THEN 'terminal_failure_recorded'
      WHEN 'error' THEN 'retryable_failure' WHEN 'click' THEN 'effect_already_applied' ELSE 'dead_recorded' END AS outcome,
    CASE WHEN event_type = 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 'document_not_found'
      ELSE 'document_validation_failed' END END AS failure_reason,
    round(value * 10, 3) AS duration_ms,
    CASE event_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 201 WHEN 2 THEN 404 WHEN 3 THEN 409 ELSE 503 END AS status_code,
    'corr-' || user_id AS correlation_id, 'job-' || user_id AS job_id, 'attempt-' || user_id AS processing_attempt_id,
    CASE event_id % 19 WHEN 0 THEN 'ModelTimeoutException' WHEN 1 THEN 'ThrottlingException'
      WHEN 2 THEN 'AccessDeniedException' WHEN 3 THEN 'SomethingElse' WHEN 4 THEN 'ServiceUnavailableException' END AS provider_error_code
  FROM events
)"""

_SQL["provider_error_taxonomy"] = f"""WITH {_TELE}
SELECT provider_error_code,
  CASE provider_error_code WHEN 'ModelTimeoutException' THEN 'timeout' WHEN 'ThrottlingException' THEN 'throttling'
    WHEN 'AccessDeniedException' THEN 'configuration' ELSE 'unavailable' END AS category,
  CASE WHEN provider_error_code = 'ThrottlingException' THEN 'warning' ELSE 'error' END AS severity,
  true AS retryable, count(*) AS n
FROM tele WHERE provider_error_code IS NOT NULL GROUP BY 1, 2, 3"""

_SQL["process_batch_outcomes"] = f"""WITH {_MSG}, {_ROUTED}, {_CLAIMED}, every AS (
  SELECT message_id, job_id, start_outcome, failure_reason, retry_reason FROM ran
  UNION ALL {_REST.format(source='routed')}
)
SELECT message_id, CAST(0 AS BIGINT) AS rec_pos, job_id, start_outcome, {_RECORD_COLUMNS} FROM every
UNION ALL {_REJECTED}"""

_SQL["process_captured_responses"] = f"""WITH {_MSG}, {_ROUTED},
checked AS (
  SELECT *, {_object_error('object_size', 'has_etag', 'doc_id', 'event_id % 59 = 0', 'text')} AS object_error,
    NOT regexp_matches(text, '[^\\s]') AS blank FROM routed
),
ran AS (
  SELECT *,
    CASE WHEN object_error IS NOT NULL THEN NULLIF(object_error, 'document_dependency_error')
         WHEN blank THEN 'invalid_provider_request' WHEN doc_id % 17 = 5 OR doc_id % 23 = 11 THEN NULL
         WHEN doc_id % 19 = 7 OR doc_id % 13 <> 0 THEN 'ai_provider_invalid_response' END AS failure_reason,
    CASE WHEN object_error = 'document_dependency_error' THEN object_error WHEN object_error IS NOT NULL OR blank THEN NULL
         WHEN doc_id % 17 = 5 THEN 'unexpected' WHEN doc_id % 23 = 11 THEN 'provider_throttled' END AS retry_reason
  FROM checked WHERE start_outcome = 'claim_acquired'
), every AS (
  SELECT message_id, job_id, start_outcome, failure_reason, retry_reason FROM ran
  UNION ALL {_REST.format(source='routed')}
)
SELECT message_id, CAST(0 AS BIGINT) AS rec_pos, job_id, start_outcome, {_RECORD_COLUMNS} FROM every
UNION ALL {_REJECTED}"""

# second records run on the job table left by the first ones
_SECOND = f"""
first_every AS (
  SELECT message_id, job_id, start_outcome, failure_reason, retry_reason FROM ran
  UNION ALL {_REST.format(source='routed')}
),
after_first AS (
  SELECT d.doc_id,
    CASE WHEN d.doc_id % 31 = 0 THEN 'missing'
         WHEN d.doc_id % 10 IN (8, 9) THEN 'ended' WHEN d.doc_id % 10 = 6 THEN 'live'
         WHEN r.job_id IS NULL THEN 'open' WHEN r.retry_reason = 'unexpected' THEN 'live'
         WHEN r.retry_reason IS NOT NULL THEN 'open' ELSE 'ended' END AS state
  FROM documents d LEFT JOIN ran r ON r.doc_id = d.doc_id
),
second AS (
  SELECT m.message_id, m.ts, m.event_id, d.doc_id, 'job-' || d.doc_id AS job_id, d.text, a.state
  FROM msg m JOIN first_every f ON f.message_id = m.message_id AND f.retry_reason IS NULL
  JOIN documents d ON d.doc_id = m.doc2 JOIN after_first a ON a.doc_id = d.doc_id
  WHERE m.error_class = 'ok' AND m.event_id % 7 = 0
),
second_first AS (SELECT doc_id, arg_min(event_id, ts) AS winner FROM second GROUP BY doc_id),
second_routed AS (
  SELECT s.*, CASE s.state WHEN 'missing' THEN 'job_not_found' WHEN 'ended' THEN 'effect_already_applied'
      WHEN 'live' THEN 'processing_already_active'
      ELSE CASE WHEN s.event_id = w.winner THEN 'claim_acquired' ELSE 'processing_already_active' END END AS start_outcome
  FROM second s JOIN second_first w USING (doc_id)
),
second_checked AS (
  SELECT *, {_object_error('strlen(text)', 'true', 'doc_id', 'false', 'text')} AS object_error FROM second_routed
),
second_ran AS (
  SELECT *, {_effect('', 'doc_id', 'text')} FROM second_checked WHERE start_outcome = 'claim_acquired'
),
second_every AS (
  SELECT message_id, job_id, start_outcome, failure_reason, retry_reason FROM second_ran
  UNION ALL {_REST.format(source='second_routed')}
)"""

_SQL["process_two_record_messages"] = f"""WITH {_MSG}, {_ROUTED}, {_CLAIMED}, {_SECOND}
SELECT message_id, CAST(0 AS BIGINT) AS rec_pos, job_id, start_outcome, {_RECORD_COLUMNS} FROM first_every
UNION ALL
SELECT message_id, CAST(1 AS BIGINT) AS rec_pos, job_id, start_outcome, {_RECORD_COLUMNS} FROM second_every
UNION ALL {_REJECTED}"""

# documents of the long messages are distinct, so each record sees its job as the single messages left it
_SQL["process_long_messages"] = f"""WITH {_MSG},
single AS (SELECT * FROM msg WHERE event_type = 'purchase'),
{_ROUTED.replace("FROM msg", "FROM single")}, {_CLAIMED},
{_SECOND[_SECOND.index("after_first AS"):_SECOND.index("second AS (")]}
second AS (
  SELECT 'long-' || d.doc_id // 200 AS message_id, d.doc_id, 'job-' || d.doc_id AS job_id, d.text, a.state, 0 AS event_id,
    row_number() OVER (PARTITION BY d.doc_id // 200 ORDER BY CASE WHEN d.doc_id % 31 <> 0 AND d.doc_id % 10 >= 8 THEN 0
      WHEN d.doc_id % 31 = 0 OR d.doc_id % 10 = 6 OR d.doc_id % 17 IN (0, 1, 2, 4) OR d.doc_id % 97 = 5 THEN 2 ELSE 1 END, d.doc_id) - 1 AS rec_pos
  FROM documents d JOIN after_first a USING (doc_id)
),
second_first AS (SELECT doc_id, 0 AS winner FROM second),
{_SECOND[_SECOND.index("second_routed AS ("):_SECOND.index("second_every AS (")]}
placed AS (
  SELECT message_id, job_id, start_outcome, failure_reason, retry_reason FROM second_ran
  UNION ALL {_REST.format(source='second_routed')}
),
stops AS (
  SELECT message_id, min(rec_pos) AS stop FROM placed JOIN second USING (message_id, job_id) WHERE retry_reason IS NOT NULL GROUP BY 1
),
every AS (
  SELECT message_id, CAST(0 AS BIGINT) AS rec_pos, job_id, start_outcome, failure_reason, retry_reason FROM ran
  UNION ALL SELECT message_id, 0, job_id, start_outcome, failure_reason, retry_reason FROM ({_REST.format(source='routed')})
  UNION ALL SELECT p.message_id, s.rec_pos, p.job_id, p.start_outcome, p.failure_reason, p.retry_reason
  FROM placed p JOIN second s USING (message_id, job_id) LEFT JOIN stops t ON t.message_id = p.message_id WHERE s.rec_pos <= coalesce(t.stop, 1000000)
)
SELECT message_id, rec_pos, job_id, start_outcome, {_RECORD_COLUMNS} FROM every
UNION ALL {_REJECTED.replace("FROM msg", "FROM single")}"""

_SQL["processed_job_table"] = f"""WITH {_MSG}, {_ROUTED}, {_CLAIMED}, {_JOBS}
SELECT j.job_id,
  CASE WHEN r.job_id IS NULL THEN j.status WHEN retry_reason = 'unexpected' THEN 'processing'
       WHEN retry_reason IS NOT NULL THEN 'pending_upload' WHEN failure_reason IS NOT NULL THEN 'failed' ELSE 'succeeded' END AS status,
  j.attempts + CASE WHEN r.job_id IS NULL THEN 0 ELSE 1 END AS attempts,
  CASE WHEN r.job_id IS NULL THEN CASE WHEN j.status = 'failed' THEN 'document_not_found' ELSE '-' END
       ELSE coalesce(failure_reason, '-') END AS error_reason,
  CASE WHEN r.job_id IS NULL THEN TIMESTAMP '2024-01-31 12:00:00' ELSE TIMESTAMP '2024-02-01 00:00:00' END AS updated_at,
  CASE WHEN r.job_id IS NULL THEN j.status = 'succeeded' ELSE retry_reason IS NULL AND failure_reason IS NULL END AS has_result,
  CASE WHEN r.job_id IS NULL THEN j.status = 'processing' ELSE coalesce(retry_reason = 'unexpected', false) END AS has_attempt
FROM jobs j LEFT JOIN ran r ON r.doc_id = j.doc_id"""

_SQL["batch_summary"] = f"""WITH {_MSG}, b AS (
  SELECT 'b-' || (event_id // 10) AS batch_id, count(*) AS batch_size,
    count(*) FILTER (error_class <> 'ok') AS failed_record_count FROM msg GROUP BY 1
)
SELECT batch_id, batch_size, batch_size - failed_record_count AS processed_record_count, failed_record_count,
  CASE WHEN failed_record_count > 0 THEN 'completed_with_failures' ELSE 'succeeded' END AS outcome FROM b"""

_SQL["failed_message_ids"] = """
SELECT 'b-' || (event_id // 100) AS batch_id, 'm-' || (event_id % 30) AS message_id, min(event_id) AS first_pos
FROM events WHERE event_type = 'error' GROUP BY 1, 2"""

_SQL["broken_batches"] = """WITH b AS (
  SELECT event_id // 10 AS b, min(event_id) AS broken FROM events WHERE event_id % 33 = 7 GROUP BY 1
)
SELECT event_id AS msg_pos, CASE WHEN broken IS NULL THEN 'processed' WHEN event_id < broken THEN 'handled_then_retried'
  ELSE 'not_handled' END AS batch_state FROM events LEFT JOIN b ON b.b = event_id // 10"""

_SQL["stop_after_failure"] = """
SELECT event_id // 8 AS msg_pos, event_id % 8 AS rec_pos, event_type = 'error' AS failed,
  coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (
    PARTITION BY event_id // 8 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS attempted
FROM events"""

_SQL["redrive_split"] = """WITH r AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS receive_count FROM events
), d AS (
  SELECT *, CASE WHEN event_type <> 'error' THEN 'acknowledged' WHEN receive_count >= 3 THEN 'dead_letter' ELSE 'retry' END AS destination FROM r
)
SELECT event_id, receive_count, destination,
  CASE WHEN destination = 'retry' THEN ts + INTERVAL 720 SECOND ELSE ts END AS available_at FROM d"""

_SQL["receive_counts"] = """
SELECT 'm-' || (event_id % 700) AS message_id, count(*) AS receive_count FROM events GROUP BY 1"""

_DEAD = f"""
rec AS MATERIALIZED (
  SELECT message_id, event_id, ts, 0 AS rec_pos, doc_id FROM msg WHERE error_class = 'ok'
  UNION ALL
  SELECT message_id, event_id, ts, 1, doc2 FROM msg WHERE error_class = 'ok' AND event_id % 7 = 0
),
judged AS (
  SELECT *, CASE WHEN doc_id % 31 = 0 THEN 'job_not_found' WHEN doc_id % 10 IN (8, 9) THEN 'effect_already_applied'
    WHEN doc_id % 10 IN (5, 7) THEN 'dead_recorded' ELSE 'conflict' END AS o FROM rec
),
stopped AS MATERIALIZED (
  SELECT *, coalesce(max(CASE WHEN o IN ('job_not_found', 'conflict') THEN 1 ELSE 0 END) OVER (
    PARTITION BY message_id ORDER BY rec_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS attempted FROM judged
),
firsts AS (
  SELECT doc_id, arg_min(event_id * 2 + rec_pos, (ts, message_id, rec_pos)) AS f FROM stopped WHERE attempted AND o = 'dead_recorded' GROUP BY doc_id
)"""

_SQL["reconcile_dead"] = f"""WITH {_MSG}, {_DEAD}
SELECT s.message_id, CAST(s.rec_pos AS BIGINT) AS rec_pos, 'job-' || s.doc_id AS job_id,
  CASE WHEN s.o = 'dead_recorded' AND attempted AND s.event_id * 2 + s.rec_pos <> f.f THEN 'effect_already_applied' ELSE s.o END AS outcome,
  attempted, attempted AND s.o IN ('job_not_found', 'conflict') AS failed
FROM stopped s LEFT JOIN firsts f USING (doc_id)
UNION ALL
SELECT message_id, CAST(-1 AS BIGINT), '-', error_class, true, true FROM msg WHERE error_class <> 'ok'"""

_SQL["dead_job_rows"] = f"""WITH {_MSG}, {_JOBS}
SELECT job_id, 'dead' AS status, 'processing_retries_exhausted' AS error_reason, attempts,
  TIMESTAMP '2024-02-01 00:00:00' AS updated_at
FROM jobs WHERE doc_id % 10 IN (5, 7) AND doc_id IN (SELECT doc_id FROM msg WHERE error_class = 'ok')"""

_SQL["outcome_invariants"] = f"""WITH {_TELE}, o AS (
  SELECT *, event_id % 5 < 3 AS att, event_id % 2 = 0 AS res, failure_reason IS NOT NULL AS rea FROM tele
)
SELECT event_id, CASE WHEN outcome = 'processed' AND NOT (att AND res AND NOT rea) THEN 'processed'
  WHEN outcome = 'terminal_failure_recorded' AND NOT (att AND rea AND NOT res) THEN 'terminal_failure'
  WHEN outcome = 'effect_already_applied' AND (att OR res OR rea) THEN 'applied' ELSE '' END AS violations FROM o"""

_SQL["telemetry_allowlist"] = """
SELECT event_id, event_type AS event_name, 'intake' AS service,
  CASE WHEN event_id % 6 = 0 THEN 'duration_ms,operation,outcome,retryable'
       ELSE 'duration_ms,operation,outcome,provider_latency_ms,retryable' END AS kept,
  CAST(event_id AS VARCHAR) AS duration_ms, CAST(CASE WHEN event_id % 6 = 0 THEN 3 ELSE 2 END AS BIGINT) AS dropped_field_count
FROM events WHERE event_id % 13 <> 0"""

_SQL["severity_by_status"] = f"""WITH {_TELE}, s AS (
  SELECT CASE WHEN event_id % 50 = 0 THEN 150 ELSE status_code END AS c FROM tele
)
SELECT CAST(c AS BIGINT) AS status_code, CASE WHEN c BETWEEN 200 AND 399 THEN 'info' WHEN c BETWEEN 400 AND 499 THEN 'warning'
  WHEN c >= 500 THEN 'error' ELSE 'none' END AS severity, c BETWEEN 100 AND 599 AS valid_status, count(*) AS n
FROM s GROUP BY 1, 2, 3"""

_SQL["union_components"] = f"""WITH {_TELE}
SELECT event_id, component, CAST(CASE WHEN event_id % 4 < 2 THEN status_code ELSE -1 END AS BIGINT) AS status_code,
  CASE WHEN event_id % 4 = 0 THEN '-' ELSE job_id END AS job_id,
  CASE WHEN event_id % 4 = 2 THEN outcome ELSE '-' END AS outcome,
  CASE WHEN event_id % 4 = 3 THEN coalesce(failure_reason, '-') ELSE '-' END AS failure_reason FROM tele"""

_SQL["metric_sums"] = f"""WITH {_TELE}
SELECT component, time_bucket(INTERVAL 5 MINUTE, ts) AS period_start, count(*) AS requests,
  count(*) FILTER (status_code BETWEEN 400 AND 499) AS errors_4xx, count(*) FILTER (status_code >= 500) AS errors_5xx,
  count(*) FILTER (provider_error_code = 'ThrottlingException') AS throttles,
  CAST(sum(event_id % 1000) AS BIGINT) AS input_tokens, CAST(sum(event_id % 77) AS BIGINT) AS output_tokens
FROM tele GROUP BY 1, 2"""

_SQL["metric_max"] = f"""WITH {_TELE}
SELECT component, time_bucket(INTERVAL 1 MINUTE, ts) AS period_start, max(duration_ms) AS max_duration_ms FROM tele GROUP BY 1, 2"""

_SQL["metric_p95"] = f"""WITH {_TELE}
SELECT component, time_bucket(INTERVAL 5 MINUTE, ts) AS period_start, quantile_disc(duration_ms, 0.95) AS p95_duration_ms,
  count(*) AS n FROM tele GROUP BY 1, 2"""

_SQL["metric_p95_daily"] = f"""WITH {_TELE}
SELECT component, time_bucket(INTERVAL 1 DAY, ts) AS period_start, quantile_disc(duration_ms, 0.95) AS p95_duration_ms,
  count(*) AS n FROM tele GROUP BY 1, 2"""

_DELIVERIES = """
dlv AS (
  SELECT event_type AS queue, ts AS sent_ts,
    CASE WHEN event_id % 11 <> 0 THEN ts + to_seconds(event_id % 1800) END AS received_ts,
    CASE WHEN event_id % 11 <> 0 AND event_id % 7 <> 0 THEN ts + to_seconds(event_id % 1800 + event_id % 300) END AS done_ts
  FROM events
)"""

_SQL["queue_gauges"] = f"""WITH {_DELIVERIES}, g AS (
  SELECT *, TIMESTAMP '2024-01-20 12:00:00' AS now FROM dlv
)
SELECT queue, count(*) FILTER (sent_ts <= now AND (received_ts IS NULL OR received_ts > now)) AS visible,
  count(*) FILTER (received_ts <= now AND (done_ts IS NULL OR done_ts > now)) AS in_flight,
  max(epoch_us(now) - epoch_us(sent_ts)) FILTER (sent_ts <= now AND (received_ts IS NULL OR received_ts > now)) / 1000000 AS oldest_age_s
FROM g GROUP BY queue"""

_SQL["queue_depth_series"] = f"""WITH {_DELIVERIES}, s AS (
  SELECT queue, sent_ts AS moved, 1 AS v, 0 AS f FROM dlv
  UNION ALL SELECT queue, received_ts, -1, 1 FROM dlv WHERE received_ts IS NOT NULL
  UNION ALL SELECT queue, done_ts, 0, -1 FROM dlv WHERE done_ts IS NOT NULL
), p AS (
  SELECT queue, time_bucket(INTERVAL 1 MINUTE, moved) AS period_start, sum(v) AS v, sum(f) AS f FROM s GROUP BY 1, 2
)
SELECT queue, period_start, CAST(sum(v) OVER w AS BIGINT) AS visible, CAST(sum(f) OVER w AS BIGINT) AS in_flight
FROM p WINDOW w AS (PARTITION BY queue ORDER BY period_start ROWS UNBOUNDED PRECEDING)"""

# minutes of January 2024 in which a message waits at the end of the minute; of
# messages that are never received the first of each queue is enough
_WAITS = """
waits AS (
  SELECT queue, sent_ts, unnest(generate_series(time_bucket(INTERVAL 1 MINUTE, sent_ts),
    least(time_bucket(INTERVAL 1 MINUTE, received_ts) - INTERVAL 1 MINUTE, TIMESTAMP '2024-01-31 23:59:00'), INTERVAL 1 MINUTE)) AS m
  FROM dlv WHERE received_ts IS NOT NULL
  UNION ALL
  SELECT queue, s, unnest(generate_series(time_bucket(INTERVAL 1 MINUTE, s), TIMESTAMP '2024-01-31 23:59:00', INTERVAL 1 MINUTE))
  FROM (SELECT queue, min(sent_ts) AS s FROM dlv WHERE received_ts IS NULL GROUP BY queue)
),
minutes AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31 23:59:00', INTERVAL 1 MINUTE)) AS m)"""


def _two_of_three(late: str, key: str) -> str:
    """A minute is in ALARM when it or a neighbour before it is late, two of the three in all."""
    return f"""SELECT g.{key}, g.m, CASE WHEN (SELECT count(*) FROM {late} l WHERE l.{key} = g.{key}
      AND l.m BETWEEN g.m - INTERVAL 2 MINUTE AND g.m) >= 2 THEN 'ALARM' ELSE 'OK' END AS state FROM"""


_SQL["queue_age_alarm"] = f"""WITH {_DELIVERIES}, {_WAITS},
late AS (SELECT DISTINCT queue, m FROM waits WHERE m + INTERVAL 1 MINUTE - sent_ts >= INTERVAL 300 SECOND),
grid AS (SELECT queue, m FROM (SELECT DISTINCT queue FROM dlv), minutes),
s AS ({_two_of_three("late", "queue")} grid g),
c AS (SELECT queue, m AS period_start, state, coalesce(lag(state) OVER (PARTITION BY queue ORDER BY m), 'OK') AS previous_state FROM s)
SELECT * FROM c WHERE state <> previous_state"""

_ALARMS = f"""{_WAITS}, hit AS (
  SELECT 'control-plane-5xx' AS alarm, ts FROM tele WHERE event_name = 'request.completed' AND status_code >= 500
  UNION ALL SELECT 'processor-errors', ts FROM tele WHERE event_name = 'processing.record_failed'
  UNION ALL SELECT 'provider-throttles', ts FROM tele WHERE provider_error_code = 'ThrottlingException'
  UNION ALL SELECT 'provider-client-errors', ts FROM tele WHERE provider_error_code = 'AccessDeniedException'
  UNION ALL SELECT 'provider-server-errors', ts FROM tele WHERE provider_error_code = 'ServiceUnavailableException'
), five AS (
  SELECT alarm, m, m IN (SELECT time_bucket(INTERVAL 5 MINUTE, ts) FROM hit h WHERE h.alarm = a.alarm) AS on_
  FROM (SELECT unnest(['control-plane-5xx', 'processor-errors', 'reconciler-errors', 'provider-throttles',
    'provider-client-errors', 'provider-server-errors']) AS alarm) a, minutes WHERE minute(m) % 5 = 0
), late AS (
  SELECT DISTINCT 'processing-queue-age' AS alarm, w.m FROM waits w WHERE w.m + INTERVAL 1 MINUTE - w.sent_ts >= INTERVAL 300 SECOND
), one AS (
  SELECT 'processing-queue-age' AS alarm, m FROM minutes
), st AS (
  SELECT alarm, m, CASE WHEN on_ THEN 'ALARM' ELSE 'OK' END AS state FROM five
  UNION ALL {_two_of_three("late", "alarm")} one g
  UNION ALL SELECT a, m, 'OK' FROM (SELECT unnest(['processing-dlq-visible', 'quarantine-visible']) AS a), minutes
)"""
_SQL["alarm_states"] = f"""WITH {_TELE}, {_DELIVERIES}, {_ALARMS}
SELECT alarm, count(*) AS periods, count(*) FILTER (state = 'ALARM') AS in_alarm FROM st GROUP BY alarm"""
_SQL["alarm_changes"] = f"""WITH {_TELE}, {_DELIVERIES}, {_ALARMS}, c AS (
  SELECT alarm, m AS period_start, state, coalesce(lag(state) OVER (PARTITION BY alarm ORDER BY m), 'OK') AS previous_state FROM st
)
SELECT * FROM c WHERE state <> previous_state"""

# every queue is a series, and messages that are never received count
_ALARMS_BY_QUEUE = f"""{_ALARMS}, late_q AS (
  SELECT DISTINCT queue, m FROM waits WHERE m + INTERVAL 1 MINUTE - sent_ts >= INTERVAL 300 SECOND
), one_q AS (SELECT queue, m FROM (SELECT DISTINCT queue FROM dlv), minutes),
stq AS (
  SELECT alarm, '' AS queue, m, state FROM st WHERE alarm <> 'processing-queue-age'
  UNION ALL SELECT 'processing-queue-age', queue, m, state FROM ({_two_of_three("late_q", "queue")} one_q g)
)"""
_SQL["alarm_states_by_queue"] = f"""WITH {_TELE}, {_DELIVERIES}, {_ALARMS_BY_QUEUE}
SELECT alarm, queue, count(*) AS periods, count(*) FILTER (state = 'ALARM') AS in_alarm FROM stq GROUP BY alarm, queue"""
_SQL["alarm_changes_by_queue"] = f"""WITH {_TELE}, {_DELIVERIES}, {_ALARMS_BY_QUEUE}, c AS (
  SELECT alarm, queue, m AS period_start, state,
    coalesce(lag(state) OVER (PARTITION BY alarm, queue ORDER BY m), 'OK') AS previous_state FROM stq
)
SELECT * FROM c WHERE state <> previous_state"""

_LOG = "event_id, component, event_name, outcome, correlation_id, job_id, ts"
_SQL["search_failures_top100"] = f"""WITH {_TELE} SELECT {_LOG} FROM tele WHERE event_name = 'processing.record_failed'
ORDER BY ts DESC, event_id DESC LIMIT 100"""
_SQL["search_correlation"] = f"""WITH {_TELE} SELECT {_LOG} FROM tele WHERE correlation_id = 'corr-7' ORDER BY ts"""
_SQL["search_terminal_outcomes"] = f"""WITH {_TELE} SELECT {_LOG}, failure_reason FROM tele
WHERE event_name = 'processing.record_completed' AND outcome = 'terminal_failure_recorded'"""
_SQL["search_provider_failures"] = f"""WITH {_TELE} SELECT {_LOG} FROM tele
WHERE event_name = 'ai_provider.invocation_completed' AND outcome <> 'succeeded'"""
_SQL["search_dead_reconciliations"] = f"""WITH {_TELE} SELECT {_LOG} FROM tele
WHERE event_name = 'reconciliation.record_completed' AND outcome = 'dead_recorded'"""
_SQL["search_trace"] = f"""WITH {_TELE},
rq AS (SELECT * FROM tele WHERE event_name = 'request.completed' AND correlation_id = 'corr-7'),
rc AS (SELECT * FROM tele WHERE event_name LIKE 'processing.%' AND job_id IN (SELECT job_id FROM rq)),
pv AS (SELECT * FROM tele WHERE event_name = 'ai_provider.invocation_completed' AND correlation_id = 'corr-7'
  AND processing_attempt_id IN (SELECT processing_attempt_id FROM rc))
SELECT {_LOG}, 'request' AS stage FROM rq UNION ALL SELECT {_LOG}, 'record' FROM rc UNION ALL SELECT {_LOG}, 'provider' FROM pv"""

_SQL["outcome_breakdown"] = f"""WITH {_TELE}
SELECT component, event_name, outcome, coalesce(failure_reason, '-') AS failure_reason, count(*) AS n, max(ts) AS last_ts
FROM tele GROUP BY 1, 2, 3, 4"""

_CHANGES = """
chg AS (
  SELECT 'doc.' || doc_id AS key, source AS entity,
    CASE WHEN doc_id % 5 = 0 THEN 'create' WHEN doc_id % 7 = 0 THEN 'delete' WHEN doc_id % 13 = 0 THEN 'replace'
         WHEN doc_id % 11 = 0 THEN 'update' ELSE 'no-op' END AS action
  FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 7 <> 0
)"""
_SQL["change_set"] = f"WITH {_CHANGES} SELECT key, entity, action FROM chg"
_SQL["change_counts"] = f"""WITH {_CHANGES}, a AS (
  SELECT unnest(['create', 'update', 'delete', 'replace', 'no-op']) AS action
)
SELECT (SELECT count(*) > 0 FROM chg WHERE action <> 'no-op') AS has_changes,
  (SELECT count(*) > 0 FROM chg WHERE action IN ('delete', 'replace')) AS destructive, a.action, count(c.key) AS n
FROM a LEFT JOIN chg c ON c.action = a.action GROUP BY a.action"""
_SQL["change_fingerprint"] = f"""WITH {_CHANGES},
r AS (SELECT sha256(concat_ws('|', key, entity, action)) AS d, count(*) AS n FROM chg GROUP BY 1),
l4 AS (SELECT d[1:4] AS k, sha256(string_agg(d || ':' || n, chr(10) ORDER BY d || ':' || n)) AS h FROM r GROUP BY 1),
l2 AS (SELECT k[1:2] AS k, sha256(string_agg(k || ':' || h, chr(10) ORDER BY k || ':' || h)) AS h FROM l4 GROUP BY k[1:2])
SELECT sha256(string_agg(k || ':' || h, chr(10) ORDER BY k || ':' || h)) AS fingerprint FROM l2"""
_SQL["change_report"] = f"""WITH {_CHANGES}
SELECT CASE action WHEN 'no-op' THEN 'No-op' ELSE upper(action[1]) || action[2:] END AS action,
  '`' || entity || '`' AS entity, '`' || key || '`' AS key FROM chg"""


def _redact_sql() -> str:
    """RE2 has no look-around: neighbours are captured, and applied twice since
    two matches may share one neighbour."""
    text = r"regexp_replace(text, '[\x00-\x1f\x7f]', '?', 'g')"
    text = rf"""regexp_replace({text}, '\["(\\.|[^"\\])*"\]', '["<redacted>"]', 'g')"""
    text = rf"""regexp_replace({text}, 'arn:(aws|aws-us-gov|aws-cn):[^\s\]\)"'']+', '<arn>', 'g')"""
    near = "A-Za-z0-9._%+-"
    for _ in range(2):
        text = (
            rf"regexp_replace({text}, '(^|[^{near}])[{near}]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}($|[^{near}])', "
            r"'\1<email>\2', 'g')"
        )
    for _ in range(2):
        text = rf"regexp_replace({text}, '(^|[^0-9])[0-9]{{12}}($|[^0-9])', '\1<account-id>\2', 'g')"
    for _ in range(2):
        text = (
            rf"regexp_replace({text}, '(?i)(^|[^0-9a-f])[0-9a-f]{{8}}-[0-9a-f]{{4}}-[1-5][0-9a-f]{{3}}-"
            rf"[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}($|[^0-9a-f])', '\1<uuid>\2', 'g')"
        )
    return f"SELECT doc_id, {text} AS redacted FROM documents"


_SQL["redact_documents"] = _redact_sql()

_SQL["retained"] = """SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-17 00:00:00'"""

_SQL["binary_file_source"] = """
SELECT 'documents/job-' || doc_id || '/source.txt' AS object_key, CAST(strlen(text) + 1 AS BIGINT) AS size_bytes,
  CASE WHEN strlen(text) + 1 <= 2048 THEN md5(text || chr(10)) ELSE '-' END AS etag,
  strlen(text) + 1 <= 2048 AS has_body FROM documents"""

_SQL["stream_state_machine"] = _SQL["history_fold"].replace(
    "SELECT 'u-' || user_id AS job_id, status, attempts, updated_at, active, applied, deliveries FROM f",
    "SELECT 'u-' || user_id AS job_id, deliveries, attempts, active, applied FROM f",
)

_SQL["job_store_versions"] = f"""WITH {_JOBS}, v AS (SELECT unnest([1, 2, 3, 4, 5, -1]) AS version),
c AS (SELECT j.*, version, CASE WHEN version = -1 THEN 5 ELSE version END AS n FROM jobs j, v WHERE version > 0 OR doc_id % 100 < 10),
newest AS (
  SELECT *, CASE WHEN n >= 5 AND doc_id % 50 = 7 THEN 5 WHEN n >= 4 AND doc_id % 4 = 1 THEN 4 WHEN n >= 3 AND doc_id % 6 = 0 THEN 3
    WHEN n >= 2 AND doc_id % 3 = 0 THEN 2 ELSE 1 END AS written FROM c
)
SELECT CAST(version AS INTEGER) AS version, job_id,
  CASE written WHEN 1 THEN status WHEN 2 THEN 'processing' WHEN 3 THEN 'succeeded' WHEN 4 THEN 'failed' ELSE 'dead' END AS status,
  CAST(CASE WHEN written = 1 THEN attempts ELSE written END AS BIGINT) AS attempts
FROM newest"""

# one step of the recursion is one request of each route
_SQL["throttled_requests"] = """WITH RECURSIVE r AS (
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'create_job' ELSE 'get_job' END AS route, CASE event_id % 4 WHEN 0 THEN 2 ELSE 10 END AS rate,
    CASE event_id % 4 WHEN 0 THEN 5000000 ELSE 20000000 END AS cap, (epoch_us(ts) - 1704067200000000) // 2500 AS us
  FROM events WHERE event_id % 4 < 2
), n AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY route ORDER BY us, event_id) AS rn FROM r
), b AS (
  SELECT event_id, route, rn, us, CAST(cap - 1000000 AS BIGINT) AS tokens, false AS throttled FROM n WHERE rn = 1
  UNION ALL
  SELECT event_id, route, rn, us, CASE WHEN have >= 1000000 THEN have - 1000000 ELSE have END, have < 1000000
  FROM (
    SELECT n.event_id, n.route, n.rn, n.us, CAST(least(n.cap, b.tokens + n.rate * (n.us - b.us)) AS BIGINT) AS have
    FROM b JOIN n ON n.route = b.route AND n.rn = b.rn + 1
  )
)
SELECT event_id, route, throttled FROM b"""

_EVENTS_OF = """
  SELECT 'processor' AS component, CASE WHEN failed THEN 'processing.record_failed' ELSE 'processing.record_completed' END AS event_name,
    CASE WHEN error_code = 'event_parsing_error' OR outcome = 'terminal_failure_recorded' THEN 'warning' WHEN failed THEN 'error' ELSE 'info' END AS level,
    CASE WHEN error_code = 'event_parsing_error' THEN 'event_rejected' WHEN failed THEN 'retryable_failure' ELSE outcome END AS outcome,
    error_code, CASE WHEN failed THEN '-' ELSE failure_reason END AS failure_reason,
    CASE WHEN NOT failed AND start_outcome = 'claim_acquired' THEN 1 ELSE 0 END AS attempt, 0 AS failed_records
  FROM ups"""
_BATCHES_OF = """
  SELECT '{component}', '{stage}.batch_completed', CASE WHEN bad > 0 THEN 'warning' ELSE 'info' END,
    CASE WHEN bad > 0 THEN 'completed_with_failures' ELSE 'succeeded' END, '-', '-', 0, bad
  FROM (SELECT count(DISTINCT message_id) FILTER (failed) AS bad FROM {source} JOIN msg USING (message_id) GROUP BY event_id // 10)"""
_SQL["pipeline_telemetry"] = f"""WITH {_MSG}, {_ROUTED}, {_CLAIMED}, every AS (
  SELECT message_id, job_id, start_outcome, failure_reason, retry_reason FROM ran
  UNION ALL {_REST.format(source='routed')}
), ups AS (
  SELECT message_id, CAST(0 AS BIGINT) AS rec_pos, job_id, start_outcome, {_RECORD_COLUMNS} FROM every
  UNION ALL {_REJECTED}
), {_DEAD}, deads AS (
  SELECT message_id, outcome, failed, false AS parsing FROM ({_SQL["reconcile_dead"][_SQL["reconcile_dead"].index("SELECT s.message_id"):_SQL["reconcile_dead"].rindex("UNION ALL")]}) WHERE attempted
  UNION ALL SELECT message_id, error_class, true, true FROM msg WHERE error_class <> 'ok'
), ev AS ({_EVENTS_OF}
  UNION ALL {_BATCHES_OF.format(component='processor', stage='processing', source='ups')}
  UNION ALL
  SELECT 'reconciler', CASE WHEN failed THEN 'reconciliation.record_failed' ELSE 'reconciliation.record_completed' END,
    CASE WHEN parsing OR outcome = 'dead_recorded' THEN 'warning' WHEN failed THEN 'error' ELSE 'info' END,
    CASE WHEN parsing THEN 'event_rejected' WHEN failed THEN 'retryable_failure' ELSE outcome END,
    CASE WHEN parsing THEN 'dead_letter_event_parsing_error' WHEN failed THEN 'dead_lettered_document_processing_error' ELSE '-' END, '-', 0, 0 FROM deads
  UNION ALL {_BATCHES_OF.format(component='reconciler', stage='reconciliation', source='deads')}
)
SELECT component, event_name, level, outcome, error_code, failure_reason, count(*) AS n, CAST(sum(attempt) AS BIGINT) AS attempts,
  CAST(sum(failed_records) AS BIGINT) AS failed_records FROM ev GROUP BY 1, 2, 3, 4, 5, 6"""

_SQL["operations_report"] = f"""WITH {_TELE}, {_DELIVERIES}, {_ALARMS_BY_QUEUE}, p AS (
  SELECT component AS label, time_bucket(INTERVAL 5 MINUTE, ts) AS period_start,
    count(*) FILTER (event_name = 'request.completed') AS requests,
    count(*) FILTER (event_name = 'request.completed' AND status_code BETWEEN 400 AND 499) AS errors_4xx,
    count(*) FILTER (event_name = 'request.completed' AND status_code >= 500) AS api_5xx,
    quantile_disc(duration_ms, 0.95) AS p95_duration_ms, max(duration_ms) AS max_duration_ms,
    count(*) FILTER (event_name = 'processing.record_failed') AS processor_errors,
    0 AS reconciler_errors,
    count(*) FILTER (provider_error_code = 'ThrottlingException') AS provider_throttles,
    count(*) FILTER (provider_error_code = 'AccessDeniedException') AS provider_client_errors,
    count(*) FILTER (provider_error_code = 'ServiceUnavailableException') AS provider_server_errors,
    sum(event_id % 1000) AS input_tokens, sum(event_id % 77) AS output_tokens
  FROM tele GROUP BY 1, 2
), s AS (
  SELECT label, period_start, unnest([
    {{'section': 'traffic', 'metric': 'requests', 'value': CAST(requests AS DOUBLE)}},
    {{'section': 'traffic', 'metric': 'errors_4xx', 'value': CAST(errors_4xx AS DOUBLE)}},
    {{'section': 'traffic', 'metric': 'api_5xx', 'value': CAST(api_5xx AS DOUBLE)}},
    {{'section': 'latency', 'metric': 'p95_duration_ms', 'value': CAST(p95_duration_ms AS DOUBLE)}},
    {{'section': 'latency', 'metric': 'max_duration_ms', 'value': CAST(max_duration_ms AS DOUBLE)}},
    {{'section': 'errors', 'metric': 'processor_errors', 'value': CAST(processor_errors AS DOUBLE)}},
    {{'section': 'errors', 'metric': 'reconciler_errors', 'value': CAST(reconciler_errors AS DOUBLE)}},
    {{'section': 'errors', 'metric': 'provider_throttles', 'value': CAST(provider_throttles AS DOUBLE)}},
    {{'section': 'errors', 'metric': 'provider_client_errors', 'value': CAST(provider_client_errors AS DOUBLE)}},
    {{'section': 'errors', 'metric': 'provider_server_errors', 'value': CAST(provider_server_errors AS DOUBLE)}},
    {{'section': 'tokens', 'metric': 'input_tokens', 'value': CAST(input_tokens AS DOUBLE)}},
    {{'section': 'tokens', 'metric': 'output_tokens', 'value': CAST(output_tokens AS DOUBLE)}}]) AS m FROM p
), g AS (
  SELECT queue, count(*) FILTER (received_ts IS NULL OR received_ts > now) AS visible,
    count(*) FILTER (received_ts <= now AND (done_ts IS NULL OR done_ts > now)) AS in_flight,
    max(epoch_us(now) - epoch_us(sent_ts)) FILTER (received_ts IS NULL OR received_ts > now) / 1000000 AS oldest_age_s
  FROM (SELECT *, TIMESTAMP '2024-01-31 23:59:00' AS now FROM dlv) WHERE sent_ts <= now GROUP BY queue
), a AS (
  SELECT alarm || CASE WHEN queue <> '' THEN '/' || queue ELSE '' END AS label, max(m) AS period_start,
    CAST(arg_max(state, m) = 'ALARM' AS DOUBLE) AS in_alarm, CAST(count(*) FILTER (state = 'ALARM') AS DOUBLE) AS alarm_periods FROM stq GROUP BY alarm, queue
)
SELECT m.section AS section, label, period_start, m.metric AS metric, m.value AS value FROM s
UNION ALL SELECT 'queues', queue, TIMESTAMP '2024-01-31 23:59:00', 'visible', CAST(visible AS DOUBLE) FROM g
UNION ALL SELECT 'queues', queue, TIMESTAMP '2024-01-31 23:59:00', 'in_flight', CAST(in_flight AS DOUBLE) FROM g
UNION ALL SELECT 'queues', queue, TIMESTAMP '2024-01-31 23:59:00', 'oldest_age_s', CAST(oldest_age_s AS DOUBLE) FROM g WHERE oldest_age_s IS NOT NULL
UNION ALL SELECT 'alarms', label, period_start, 'in_alarm', in_alarm FROM a
UNION ALL SELECT 'alarms', label, period_start, 'alarm_periods', alarm_periods FROM a
UNION ALL SELECT 'failures', job_id, ts, 'event_id', CAST(event_id AS DOUBLE) FROM (
  SELECT * FROM tele WHERE event_name = 'processing.record_failed' ORDER BY ts DESC, event_id DESC LIMIT 100)"""

_SQL["alarm_stream_states"] = _SQL["alarm_states_by_queue"]

_SQL["history_fold_hot"] = _SQL["history_fold"].replace(
    """  SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
    count(*) OVER (PARTITION BY user_id) AS total FROM events
""",
    """  SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
    count(*) OVER (PARTITION BY user_id) AS total
  FROM (SELECT ts, event_id, CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id END AS user_id,
    CASE WHEN user_id % 3 = 0 AND event_type <> 'error' THEN 'click' ELSE event_type END AS event_type FROM events)
""",
).replace("SELECT 'u-' || user_id AS job_id, status", "SELECT CASE WHEN user_id = -1 THEN 'hot' ELSE 'u-' || user_id END AS job_id, status")

# closed form: the handler fails k times, three receives 720 s apart, then three 180 s apart
_SQL["redelivered_batches"] = """WITH m AS (
  SELECT event_id, CASE WHEN event_id % 6 = 0 THEN event_id // 6 % 8 ELSE 0 END AS k,
    TIMESTAMP '2024-02-01 00:00:00' + to_seconds(event_id % 100) AS sent FROM events
)
SELECT 'm-' || event_id AS message_id, CAST(least(k + 1, 6) AS BIGINT) AS deliveries, CAST(least(k, 6) AS BIGINT) AS retries,
  CASE WHEN k < 6 THEN 'acknowledged' ELSE 'quarantine' END AS destination,
  CASE WHEN k < 3 THEN 'work' WHEN k < 6 THEN 'dead_letter' ELSE 'quarantine' END AS level,
  CAST(CASE WHEN k < 6 THEN k % 3 + 1 ELSE 0 END AS INTEGER) AS receive_count,
  sent + to_seconds(CASE WHEN k < 3 THEN 720 * k + 60 WHEN k < 6 THEN 2160 + 180 * (k - 3) + 60 ELSE 2700 END) AS settled_at
FROM m"""

_SQL["stream_owner_finalize"] = """WITH RECURSIVE e AS (
  SELECT event_id, 'u-' || user_id || '-' || event_id % 7 AS job_id, 'a-' || event_id AS attempt_id, ts AS claimed,
    CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'signup' THEN 'fail' WHEN 'error' THEN 'release' END AS result,
    ts + to_hours(event_id * 37 % 9) AS ended FROM events
), r AS (
  SELECT job_id, attempt_id, 'claim' AS kind, claimed AS ts,
    CASE WHEN event_id % 17 = 0 THEN claimed + INTERVAL 3 DAY ELSE claimed END AS arrived FROM e
  UNION ALL
  SELECT job_id, attempt_id, result, ended, CASE WHEN event_id % 13 = 0 THEN ended + INTERVAL 2 DAY ELSE ended END
  FROM e WHERE result IS NOT NULL
), g AS (
  SELECT *, CASE WHEN arrived < TIMESTAMP '2024-01-11' THEN 0 WHEN arrived < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS part FROM r
), d AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY part, ts, kind <> 'claim', attempt_id) AS rn FROM g
), f AS (
  SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS rn, '' AS attempt_id, '' AS kind, 0 AS part, '' AS outcome, 'pending_upload' AS status,
    CAST(0 AS BIGINT) AS attempts, CAST(NULL AS VARCHAR) AS owner, CAST(NULL AS TIMESTAMP) AS lease, CAST(NULL AS TIMESTAMP) AS changed FROM d
  UNION ALL
  SELECT job_id, rn, attempt_id, kind, part, outcome,
    CASE outcome WHEN 'claim_acquired' THEN 'processing' WHEN 'claim_taken_over' THEN 'processing' WHEN 'processed' THEN 'succeeded'
      WHEN 'terminal_failure_recorded' THEN 'failed' WHEN 'released' THEN 'pending_upload' ELSE status END,
    attempts + CASE WHEN outcome IN ('claim_acquired', 'claim_taken_over') THEN 1 ELSE 0 END,
    CASE WHEN outcome IN ('claim_acquired', 'claim_taken_over') THEN attempt_id
      WHEN outcome IN ('processed', 'terminal_failure_recorded', 'released') THEN NULL ELSE owner END,
    CASE WHEN outcome IN ('claim_acquired', 'claim_taken_over') THEN ts + INTERVAL 21600 SECOND
      WHEN outcome IN ('processed', 'terminal_failure_recorded', 'released') THEN NULL ELSE lease END,
    CASE WHEN outcome IN ('claim_acquired', 'claim_taken_over', 'processed', 'terminal_failure_recorded', 'released') THEN ts ELSE changed END
  FROM (
    SELECT d.job_id, d.rn, d.attempt_id, d.kind, d.part, d.ts, f.status, f.attempts, f.owner, f.lease, f.changed,
      CASE WHEN d.kind = 'claim' THEN
          CASE WHEN f.status IN ('succeeded', 'failed') THEN 'effect_already_applied' WHEN d.ts < f.changed THEN 'rejected_late'
               WHEN f.status = 'processing' AND f.lease > d.ts THEN 'processing_already_active'
               WHEN f.status = 'processing' THEN 'claim_taken_over' ELSE 'claim_acquired' END
        WHEN f.status <> 'processing' OR f.owner <> d.attempt_id THEN 'stale_attempt' WHEN d.ts < f.changed THEN 'rejected_late'
        WHEN d.kind = 'complete' THEN 'processed' WHEN d.kind = 'fail' THEN 'terminal_failure_recorded' ELSE 'released' END AS outcome
    FROM f JOIN d ON d.job_id = f.job_id AND d.rn = f.rn + 1
  )
), marks AS (SELECT part, max(max(arrived)) OVER (ORDER BY part) AS mark FROM d GROUP BY part),
held AS (
  -- claims, and the trigger in which their job changed next
  SELECT c.job_id, c.attempt_id, c.status, c.attempts, c.lease, c.part, coalesce(min(n.part), 3) AS over_in
  FROM f c LEFT JOIN f n ON n.job_id = c.job_id AND n.rn > c.rn
    AND n.outcome IN ('claim_taken_over', 'processed', 'terminal_failure_recorded', 'released')
  WHERE c.outcome IN ('claim_acquired', 'claim_taken_over') GROUP BY ALL
)
SELECT job_id, attempt_id, kind, outcome,
  CASE outcome WHEN 'rejected_late' THEN 'late' WHEN 'stale_attempt' THEN 'stale' WHEN 'processing_already_active' THEN 'not_needed'
    WHEN 'effect_already_applied' THEN 'not_needed' ELSE 'applied' END AS side, status, attempts
FROM f WHERE rn > 0
UNION ALL
SELECT DISTINCT job_id, attempt_id, 'lease', 'lease_expired', 'expired', status, attempts
FROM held JOIN marks ON marks.part >= held.part AND marks.part < held.over_in AND marks.mark >= held.lease"""


def all_sql() -> dict[str, str]:
    from docketry.plans import services

    return _SQL | services.SQL
