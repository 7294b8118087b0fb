"""Composite jobs: process uploads, reconcile dead letters, create and read jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry import schemas as S
from docketry.config import IntakeConfig
from docketry.functions import text as X
from docketry.functions import times as TM
from docketry.operators import extract, intake, jobs as J, objects as O, outcomes as R
from docketry.operators import requests as RQ
from docketry.operators import skew
from docketry.session import cut_lineage

PARSING_ERROR = "event_parsing_error"
PROCESSING_ERROR = "uploaded_document_processing_error"
UNEXPECTED_ERROR = "unexpected_processing_error"

# arrival first; the rest makes the order total
ARRIVAL = ["sent_ts", "message_id", "batch_id", "msg_pos", "rec_pos"]
_POSITION = ["batch_id", "msg_pos", "rec_pos"]

_RECORD_COLUMNS = [
    "batch_id", "msg_pos", "rec_pos", "message_id", "job_id", "start_outcome", "attempt_id",
    "outcome", "failure_reason", "retry_reason", "result_json", "failed", "error_code",
]


@dataclass
class UploadResult:
    """Tables produced by one run over a set of messages."""

    records: DataFrame
    messages: DataFrame
    changes: DataFrame
    jobs: DataFrame


def parse_once(messages: DataFrame, config: IntakeConfig) -> DataFrame:
    """Parsed messages as a checkpointed table.

    Parsing is the costly step and its result feeds several branches (first
    event per job, rows per job, the events themselves, the rejects), so it is
    done once and the bodies are left behind.
    """
    return cut_lineage(intake.parse_messages(messages, config).drop("body"))


def _key_bytes():
    """About what the events of a message weigh when they are broadcast."""
    texts = ("object_key", "job_id", "etag", "version_id")
    size = lambda e: sum((F.coalesce(F.octet_length(e[t]), F.lit(0)) for t in texts), F.lit(128))
    return F.coalesce(F.aggregate("events", F.lit(0).cast("long"), lambda n, e: n + size(e)), F.lit(0))


def _run_claims(
    claimed: DataFrame,
    objects: DataFrame,
    plan: DataFrame | None,
    extractor: extract.Extractor,
    config: IntakeConfig,
    few: bool,
) -> DataFrame:
    """Load, extract and decide the final effect of each acquired claim."""
    loaded = O.load_documents(claimed, objects, config, few=few)
    if plan is not None:
        loaded = loaded.join(plan.select("job_id", "planned_outcome"), "job_id", "left")
    loaded = loaded.withColumn(
        "__request_error", F.when(F.col("object_error").isNull(), extract.request_error())
    )
    ready = F.col("object_error").isNull() & F.col("__request_error").isNull()
    # the extractor sees only text of claims that passed every earlier check
    gated = loaded.withColumn("document_text", F.when(ready, F.col("document_text")))
    ran = extract.checked(extractor(gated))
    provider = F.when(ready, F.col("provider_outcome"))
    reason = (
        F.when(F.col("object_error") == O.DEPENDENCY, F.lit(None))
        .when(F.col("object_error").isNotNull(), F.col("object_error"))
        .when(F.col("__request_error").isNotNull(), F.col("__request_error"))
        .when(provider == "invalid_response", "ai_provider_invalid_response")
    )
    retry = (
        F.when(F.col("object_error") == O.DEPENDENCY, F.col("object_error"))
        .when(provider.isin(*extract.RETRYABLE_OUTCOMES), F.concat(F.lit("provider_"), provider))
        .when(provider == "unexpected", "unexpected")
    )
    effect = (
        F.when(F.col("__retry") == "unexpected", "claim_kept")
        .when(F.col("__retry").isNotNull(), "release")
        .when(F.col("__reason").isNotNull(), "fail")
        .when(provider == "success", "complete")
        .otherwise("claim_kept")
    )
    done = ran.withColumn("__reason", reason).withColumn("__retry", retry)
    return done.withColumn("effect", effect).withColumn(
        "result_json", F.when(F.col("effect") == "complete", F.col("result_json"))
    )


def _routed(events: DataFrame, jobs: DataFrame, as_of, config: IntakeConfig, few: bool) -> DataFrame:
    """Events with their job and ``base``: how each would start if it were alone."""
    state = jobs.select(*J.ROUTING, F.lit(True).alias("job_found"))
    joined = skew.salted_lookup(events, state, ["job_id"], ARRIVAL, few=few, **config.hot_options()).withColumn(
        "job_found", F.coalesce("job_found", F.lit(False))
    )
    owned = F.col("object_key") == X.build_object_key(F.col("job_id"))
    attempt = X.opaque_id("attempt", F.col("job_id"), F.col("message_id"), F.col("receive_count").cast("string"))
    return joined.withColumn("base", J.start_route(as_of, owned=owned)).withColumn("attempt_id", attempt)


def _claim():
    return F.struct(*ARRIVAL)


_EFFECT = ["effect", "failure_reason", "retry_reason", "result_json"]


class _Claims:
    """Who claims which job, and to what effect, when the records of a message run one after the other.

    Records at one position of their messages are concurrent, a later position
    sees what the earlier ones left, and a message stops at its first failure. Of
    the records of a job at a position the first to arrive (the *head*) claims it,
    if nothing before has settled the job. All heads are run at once, as if no
    message stopped; then messages are cut at their failures and the heads that
    this moves are run, until no cut changes. After n passes the first n positions
    are right, and when a pass changes nothing, all are; what is done again follows
    the chains of conflicts, not the length of messages.
    """

    def __init__(self, contested: DataFrame, run) -> None:
        self._rows, self._run = contested, run
        self._effects: DataFrame | None = None

    def _groups(self, attempted: DataFrame) -> DataFrame:
        """Heads with their effect as far as it is known, and the position that settles the job."""
        heads = attempted.groupBy("job_id", "rec_pos").agg(F.min(_claim()).alias("head"))
        if self._effects is None:
            known = heads.withColumn("e", F.lit(None).cast("struct<effect: string, failure_reason: string, retry_reason: string, result_json: string>"))
        else:
            effects = self._effects.select(_claim().alias("head"), F.struct(*_EFFECT).alias("e"))
            known = heads.join(effects, "head", "left")
        settles = F.col("e.effect").isNotNull() & (F.col("e.effect") != "release")
        job = known.groupBy("job_id").agg(
            F.min(F.when(settles, F.col("rec_pos"))).alias("settled_at"),
            F.min_by(F.col("e.effect"), F.when(settles, F.col("rec_pos"))).alias("settled_by"),
            F.min(F.when(F.col("e").isNull(), F.col("rec_pos"))).alias("first_open"),
            F.bool_or(F.col("e.effect") == "release").alias("released"),
        )
        return known.join(job, "job_id")

    def settle(self, attempted: DataFrame) -> DataFrame:
        """The groups of the attempted records, after every claim among them has been run."""
        while True:
            groups = cut_lineage(self._groups(attempted))
            # a job that was released may be claimed at each later position; otherwise only the first claim counts
            reached = F.col("settled_at").isNull() | (F.col("rec_pos") < F.col("settled_at"))
            next_one = (F.col("rec_pos") == F.col("first_open")) | F.coalesce("released", F.lit(False))
            needed = groups.where(F.col("e").isNull() & reached & next_one).select(F.col("head").alias("claim"))
            if needed.isEmpty():
                return groups
            claimed = self._rows.withColumn("claim", _claim()).join(needed, "claim", "left_semi").drop("claim")
            ran = cut_lineage(self._run(claimed))
            self._effects = ran if self._effects is None else self._effects.unionByName(ran)

    def outcomes(self, attempted: DataFrame, config: IntakeConfig, few: bool) -> DataFrame:
        """``start_outcome`` and effect of every attempted record."""
        groups = self.settle(attempted).select("job_id", "rec_pos", "head", "e", "settled_at", "settled_by")
        found = skew.salted_lookup(attempted, groups, ["job_id", "rec_pos"], ARRIVAL, few=few, **config.hot_options())
        claims = (_claim() == F.col("head")) & (F.col("settled_at").isNull() | (F.col("rec_pos") <= F.col("settled_at")))
        applied = (F.col("rec_pos") > F.col("settled_at")) & F.col("settled_by").isin("complete", "fail")
        start = F.when(claims, J.CLAIM_ACQUIRED).when(applied, J.ALREADY_APPLIED).otherwise(J.ALREADY_ACTIVE)
        judged = found.withColumn("start_outcome", start)
        won = F.col("start_outcome") == J.CLAIM_ACQUIRED
        retry = F.when(won, F.col("e.retry_reason")).when(F.col("start_outcome") == J.ALREADY_ACTIVE, J.ALREADY_ACTIVE)
        return judged.select(
            *attempted.columns, "start_outcome", F.when(won, F.col("e.effect")).alias("effect"),
            F.when(won, F.col("e.failure_reason")).alias("failure_reason"), retry.alias("retry_reason"),
            F.when(won, F.col("e.result_json")).alias("result_json"),
        )


def _stops(rows: DataFrame) -> DataFrame:
    """The first failed position of each message that has one."""
    return rows.where(F.col("retry_reason").isNotNull()).groupBy(*R.MESSAGE_KEY).agg(F.min("rec_pos").alias("stop"))


def _until(rows: DataFrame, stops: DataFrame) -> DataFrame:
    """The rows up to the stop of their message."""
    return rows.join(stops, R.MESSAGE_KEY, "left").where(F.col("stop").isNull() | (F.col("rec_pos") <= F.col("stop"))).drop("stop")


def _in_order(
    events: DataFrame, jobs: DataFrame, run, as_of, config: IntakeConfig, few: bool, several: bool
) -> DataFrame:
    """Outcome of every record that is run; ``several`` says that some message holds more than one."""
    routed = cut_lineage(_routed(events, jobs, as_of, config, few))
    none = F.lit(None).cast("string")
    alone = routed.where(F.col("base") != J.CLAIMABLE).withColumn("start_outcome", F.col("base")).select(
        *routed.columns, "start_outcome", none.alias("effect"), none.alias("failure_reason"),
        F.when(F.col("base") != J.ALREADY_APPLIED, F.col("base")).alias("retry_reason"), none.alias("result_json"),
    )
    contested = routed.where(F.col("base") == J.CLAIMABLE)
    if not several:
        return _Claims(contested, run).outcomes(contested, config, few).unionByName(alone)
    sure = cut_lineage(_stops(alone))  # whatever else happens, nothing behind these is run
    contested = cut_lineage(_until(contested, sure))
    longer = events.groupBy(*R.MESSAGE_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*R.MESSAGE_KEY)
    touched = contested.join(longer, R.MESSAGE_KEY, "left_semi").select("job_id").distinct()
    moving = cut_lineage(contested.join(touched, "job_id", "left_semi"))
    claims, stops = _Claims(contested, run), sure
    result = cut_lineage(claims.outcomes(contested, config, few))
    still = result.join(touched, "job_id", "left_anti")  # jobs of single records only: right after one pass
    result = result.join(touched, "job_id", "left_semi")
    while True:
        # only messages of several records can be cut
        found = _stops(result).join(longer, R.MESSAGE_KEY, "left_semi")
        cut = cut_lineage(found.unionByName(sure).groupBy(*R.MESSAGE_KEY).agg(F.min("stop").alias("stop")))
        moved = cut.withColumnRenamed("stop", "now").join(stops, R.MESSAGE_KEY, "full").where("NOT now <=> stop")
        if moved.isEmpty():
            break
        stops = cut
        result = cut_lineage(claims.outcomes(_until(moving, stops), config, few))
    return result.unionByName(still).unionByName(_until(alone, stops))


def _outcomes(ran: DataFrame) -> DataFrame:
    """The outcome names of the records that were run."""
    outcome = (
        F.when(F.col("start_outcome") == J.ALREADY_APPLIED, R.EFFECT_APPLIED)
        .when(F.col("effect") == "complete", R.PROCESSED)
        .when(F.col("effect") == "fail", R.TERMINAL_FAILURE)
    )
    error = F.when(F.col("retry_reason") == "unexpected", UNEXPECTED_ERROR).when(
        F.col("retry_reason").isNotNull(), PROCESSING_ERROR
    )
    return (
        ran.withColumn("outcome", outcome)
        .withColumn("failed", F.col("retry_reason").isNotNull())
        .withColumn("error_code", error)
        .withColumn("attempt_id", F.when(F.col("effect").isNotNull(), F.col("attempt_id")))
    )


def _changed_jobs(outcomes: DataFrame, as_of, config: IntakeConfig) -> DataFrame:
    """The job rows that the claims leave: the last claim of a job, with all its claims counted."""
    last = F.struct("PK", "entity_type", "request_id", "correlation_id", "created_at", "attempts", "attempt_id", *_EFFECT)
    claims = outcomes.where(F.col("effect").isNotNull()).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n"), F.max_by(last, F.col("rec_pos")).alias("c")
    )
    kept = F.col("c.effect") == "claim_kept"
    done = F.col("c.effect") == "complete"
    failed = F.col("c.effect") == "fail"
    now = TM.as_timestamp(as_of)
    return claims.select(
        "c.PK", "c.entity_type", "job_id",
        F.when(done, S.SUCCEEDED).when(failed, S.FAILED).when(kept, S.PROCESSING)
        .otherwise(S.PENDING).alias("status"),
        "c.request_id", "c.correlation_id", "c.created_at", now.alias("updated_at"),
        (F.col("c.attempts") + F.col("n")).alias("attempts"),
        F.when(kept, F.col("c.attempt_id")).alias("active_attempt_id"),
        F.when(kept, now).alias("active_attempt_started_at"),
        F.when(kept, TM.plus_seconds(now, config.lease_seconds)).alias("active_attempt_lease_expires_at"),
        F.when(done, F.col("c.result_json")).alias("processing_result"),
        F.when(failed, F.col("c.failure_reason")).alias("error_reason"),
    )


def process_uploads(
    messages: DataFrame,
    jobs: DataFrame,
    objects: DataFrame,
    *,
    as_of,
    config: IntakeConfig = IntakeConfig(),
    plan: DataFrame | None = None,
    extractor: extract.Extractor = extract.rule_extractor,
) -> UploadResult:
    """Messages to finalized jobs.

    All messages are handled at the same time, the records of one message one
    after the other: record *k* of a message that has not failed yet sees the jobs
    as the records before position *k* left them. This takes one pass over all
    records and, where messages hold several, a pass over the jobs they touch for
    each link of a chain of conflicts (``_Claims``).

    A message without an id fails its whole batch: messages before it keep
    their effects but are delivered again, it and the rest are not handled.
    """
    return process_parsed(
        parse_once(messages, config), jobs, objects, as_of=as_of, config=config, plan=plan, extractor=extractor
    )


def process_parsed(
    parsed: DataFrame,
    jobs: DataFrame,
    objects: DataFrame,
    *,
    as_of,
    config: IntakeConfig = IntakeConfig(),
    plan: DataFrame | None = None,
    extractor: extract.Extractor = extract.rule_extractor,
) -> UploadResult:
    """``process_uploads`` for a caller that has the messages from ``parse_once`` already."""
    longest, n_events, key_bytes, without_id = parsed.agg(
        F.max(F.size("events")), F.sum(F.greatest(F.size("events"), F.lit(0))), F.sum(_key_bytes()),
        F.count_if(F.col("message_id").isNull()),
    ).first()
    few = (n_events or 0) <= config.broadcast_rows and (key_bytes or 0) <= config.broadcast_bytes
    parsed = parsed.withColumn("batch_state", F.lit("processed"))
    if without_id:
        parsed = R.reject_broken_batches(parsed.drop("batch_state"), config)
        unhandled = F.col("batch_state") == "not_handled"
        parsed = parsed.withColumn(
            "error_class",
            F.when(unhandled, F.coalesce("error_class", F.lit(intake.MALFORMED_BATCH))).otherwise(F.col("error_class")),
        ).withColumn("events", F.when(~unhandled, F.col("events")))
    rejected = parsed.where(F.col("error_class").isNotNull()).select(
        "batch_id", "msg_pos", F.lit(None).cast("int").alias("rec_pos"), "message_id",
        F.lit(None).cast("string").alias("job_id"), F.lit(None).cast("string").alias("start_outcome"),
        F.lit(None).cast("string").alias("attempt_id"), F.lit(None).cast("string").alias("outcome"),
        F.lit(None).cast("string").alias("failure_reason"), F.col("error_class").alias("retry_reason"),
        F.lit(None).cast("string").alias("result_json"), F.lit(True).alias("failed"),
        F.lit(PARSING_ERROR).alias("error_code"),
    )
    events = intake.flatten_events(parsed)

    def run(claimed: DataFrame) -> DataFrame:
        return _run_claims(claimed, objects, plan, extractor, config, few).select(
            *ARRIVAL, "effect", F.col("__reason").alias("failure_reason"), F.col("__retry").alias("retry_reason"), "result_json"
        )

    ran = cut_lineage(_outcomes(_in_order(events, jobs, run, as_of, config, few, several=(longest or 0) > 1)))
    records = rejected.unionByName(ran.select(*_RECORD_COLUMNS))
    changes = _changed_jobs(ran, as_of, config)
    verdicts = R.message_verdicts(records)
    if without_id:
        again = parsed.where(F.col("batch_state") != "processed").select(
            *R.MESSAGE_KEY, F.lit(True).alias("__again")
        )
        verdicts = verdicts.join(again, R.MESSAGE_KEY, "left").select(
            *R.MESSAGE_KEY, "message_id", (F.col("failed") | F.col("__again").isNotNull()).alias("failed")
        )
    return UploadResult(
        records=records,
        messages=verdicts,
        changes=changes,
        jobs=J.merge_rows(jobs, changes),
    )


@dataclass
class ReconcileResult:
    records: DataFrame
    messages: DataFrame
    changes: DataFrame


def reconcile_dead_letters(
    messages: DataFrame, jobs: DataFrame, *, as_of, config: IntakeConfig = IntakeConfig()
) -> ReconcileResult:
    """Exhausted messages to dead jobs. Only the job id of a message is used.

    Of several messages for one eligible job the first records the dead state
    and the others find it applied.
    """
    parsed = parse_once(messages, config)
    events = intake.flatten_events(parsed)
    n_events = parsed.agg(F.sum(F.greatest(F.size("events"), F.lit(0)))).first()[0]
    hot = {**config.hot_options(), "few": (n_events or 0) <= config.broadcast_rows}
    state = jobs.select("job_id", "status", "attempts", "updated_at", J.LEASE).withColumn(
        "job_found", F.lit(True)
    )
    joined = skew.salted_lookup(events, state, ["job_id"], ARRIVAL, **hot).withColumn(
        "job_found", F.coalesce("job_found", F.lit(False))
    )
    # whether a record fails does not depend on which message comes first, so
    # the stop rule is settled before the first dead mark of a job is chosen
    decided = joined.withColumn("outcome", J.dead_route(as_of))
    ok = F.col("outcome").isin(R.DEAD_RECORDED, R.EFFECT_APPLIED)
    ran = cut_lineage(R.stop_after_failure(decided.withColumn("failed", ~ok)))
    position = F.struct(*[F.col(c) for c in ARRIVAL])
    marking = F.col("attempted") & (F.col("outcome") == R.DEAD_RECORDED)
    first = ran.where(marking).groupBy("job_id").agg(
        F.min(position).alias("__first"),
        F.first(F.struct("status", "attempts", "updated_at")).alias("seen"),
    )
    named = skew.salted_lookup(ran, first.select("job_id", "__first"), ["job_id"], ARRIVAL, **hot)
    outcome = F.when(marking & (position != F.col("__first")), R.EFFECT_APPLIED).otherwise(
        F.col("outcome")
    )
    records = named.select(
        *_POSITION, "message_id", "job_id", outcome.alias("outcome"), "attempted",
        (F.col("failed") & F.col("attempted")).alias("failed"),
    )
    rejected = parsed.where(F.col("error_class").isNotNull()).select(
        "batch_id", "msg_pos", F.lit(None).cast("int").alias("rec_pos"), "message_id",
        F.lit(None).cast("string").alias("job_id"), F.col("error_class").alias("outcome"),
        F.lit(True).alias("attempted"), F.lit(True).alias("failed"),
    )
    marks = first.select(
        "job_id",
        F.col("seen.status").alias("expected_status"),
        F.col("seen.attempts").alias("expected_attempts"),
        F.col("seen.updated_at").alias("expected_updated_at"),
        TM.as_timestamp(as_of).alias("marked_at"),
    )
    everything = records.unionByName(rejected)
    return ReconcileResult(
        records=everything,
        messages=R.message_verdicts(everything),
        changes=J.dead_rows(jobs, J.mark_dead(jobs, marks)),
    )


@dataclass
class CreateResult:
    responses: DataFrame
    created: DataFrame


def create_jobs(requests: DataFrame, jobs: DataFrame, *, as_of, config: IntakeConfig = IntakeConfig()) -> CreateResult:
    """Create requests ``(job_id, event_key, headers, gateway_request_id, body,
    is_base64)`` to responses and new pending rows.

    Of several accepted requests with one job id the first by ``event_key``
    inserts; the others, and ids that exist already, conflict.
    """
    asked = RQ.resolve_context(requests).withColumn("__ok", RQ.body_accepted())
    first = asked.groupBy("job_id").agg(
        F.min(F.when(F.col("__ok"), F.col("event_key"))).alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    state = first.select("job_id", "__first").join(
        jobs.select("job_id", F.lit(True).alias("__exists")), "job_id", "left"
    )
    joined = skew.salted_lookup(
        asked, state, ["job_id"], ["event_key"], counts=first.select("job_id", "__n"),
        **config.hot_options(),
    )
    outcome = (
        F.when(~F.col("__ok"), "invalid_request")
        .when(F.col("__exists") | (F.col("event_key") != F.col("__first")), "conflict")
        .otherwise("succeeded")
    )
    responses = RQ.classify(joined, "create", outcome).withColumn(
        "object_key", F.when(F.col("outcome") == "succeeded", X.build_object_key(F.col("job_id")))
    ).drop("__ok", "__first", "__exists")
    return CreateResult(responses, J.new_jobs(responses.where("outcome = 'succeeded'"), as_of))


def get_jobs(requests: DataFrame, jobs: DataFrame, *, config: IntakeConfig = IntakeConfig()) -> DataFrame:
    """Read requests ``(event_key, path_parameters, ...)`` to views and outcomes."""
    asked = requests.withColumn("job_id", RQ.path_job_id(F.col("path_parameters")))
    found = J.lookup(asked, J.view(jobs), ["event_key"], config)
    outcome = (
        F.when(F.col("job_id").isNull(), "invalid_request")
        .when(~F.col("job_found"), "not_found")
        .otherwise("succeeded")
    )
    return RQ.classify(found, "get", outcome.alias("outcome"))
