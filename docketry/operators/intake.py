"""Queue messages to typed upload events (parse, classify, flatten)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.config import IntakeConfig
from docketry.functions import text as X
from docketry.functions import variants as V

# fixed values: error classes of one queue message
MALFORMED_MESSAGE = "malformed_queue_message"
MALFORMED_NOTIFICATION = "malformed_s3_notification"
UNSUPPORTED_EVENT = "unsupported_s3_event"
UNEXPECTED_BUCKET = "unexpected_s3_bucket"
INVALID_KEY = "invalid_document_object_key"
MALFORMED_BATCH = "malformed_queue_event"

_EVENT_NAME = r"^ObjectCreated:.+$"


# A notification record in one cast. Leaves stay VARIANT, so that a text is told from a number or a
# JSON null; what is not an object where one belongs is null.
_LEAVES = ", ".join(f"{n}: variant" for n in ("key", "size", "eTag", "sequencer", "versionId"))
_RECORDS = f"array<struct<eventName: variant, s3: struct<bucket: struct<name: variant>, object: struct<{_LEAVES}>>>>"

Fields = Callable[[str], Column]  # the fields of one record by name

_REQUIRED = ("event_name", "bucket_name", "encoded_key")
_OPTIONAL = ("etag", "sequencer", "version_id")


def _raw_fields(record: Column) -> dict[str, Column]:
    """Fields of one notification record as they are; null when absent or mistyped."""
    s3 = record["s3"]
    obj = s3["object"]
    texts = {
        "event_name": record["eventName"], "bucket_name": s3["bucket"]["name"], "encoded_key": obj["key"],
        "etag": obj["eTag"], "sequencer": obj["sequencer"], "version_id": obj["versionId"],
    }
    found = {n: F.when(V.kind(at) == "STRING", F.try_variant_get(at, "$", "string")) for n, at in texts.items()}
    given = {f"{n}_given": F.coalesce(V.kind(texts[n]) != "VOID", F.lit(False)) for n in _OPTIONAL}
    size = F.when(V.kind(obj["size"]) == "BIGINT", F.try_variant_get(obj["size"], "$", "bigint"))
    return {**found, **given, "has_object": obj.isNotNull(), "object_size": size}


def _stripped_fields(raw: Fields) -> dict[str, Column]:
    rest = ("has_object", "object_size", *[f"{n}_given" for n in _OPTIONAL])
    return {n: X.strip(raw(n)) for n in (*_REQUIRED, *_OPTIONAL)} | {n: raw(n) for n in rest}


def _clean_fields(stripped: Fields) -> dict[str, Column]:
    """Blank texts become null; ``bad_optional`` marks given but unusable ones; the key is decoded."""
    bad = F.lit(False)
    for n in _OPTIONAL:
        bad = bad | (stripped(f"{n}_given") & F.coalesce(stripped(n) == "", F.lit(True)))
    texts = {n: F.when(stripped(n) != "", stripped(n)) for n in (*_REQUIRED, *_OPTIONAL)}
    size = F.when(stripped("object_size") >= 0, stripped("object_size"))
    decoded = F.when(stripped("encoded_key") != "", X.form_decode(stripped("encoded_key")))
    return {**texts, "has_object": stripped("has_object"), "object_size": size, "bad_optional": bad, "object_key": decoded}


def _owned_fields(clean: Fields) -> dict[str, Column]:
    names = (*_REQUIRED, *_OPTIONAL, "has_object", "object_size", "bad_optional", "object_key")
    return {n: clean(n) for n in names} | {"job_id": X.job_id_from_key(clean("object_key"))}


def _event_fields(raw: Fields, expected_bucket: str) -> dict[str, Column]:
    """Typed event of a cleaned record with its first error, null when valid."""
    error = (
        F.when(raw("event_name").isNull(), MALFORMED_NOTIFICATION)
        .when(~raw("event_name").startswith("ObjectCreated:"), UNSUPPORTED_EVENT)
        .when(~raw("has_object") | raw("bucket_name").isNull(), MALFORMED_NOTIFICATION)
        .when(raw("bucket_name") != F.lit(expected_bucket), UNEXPECTED_BUCKET)
        .when(raw("encoded_key").isNull(), MALFORMED_NOTIFICATION)
        .when(raw("job_id").isNull(), INVALID_KEY)
        .when(
            raw("object_size").isNull()
            | raw("bad_optional")
            | ~raw("event_name").rlike(_EVENT_NAME),
            MALFORMED_NOTIFICATION,
        )
    )
    names = ("event_name", "bucket_name", "object_key", "job_id", "object_size", *_OPTIONAL)
    return {n: raw(n) for n in names} | {"error_class": error}


def _struct(fields: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _first(fields: dict[str, Column]) -> list[Column]:
    return [c.alias(f"__1_{n}") for n, c in fields.items()]


def _each(records: Column, step: Callable[[Fields], dict[str, Column]]) -> Column:
    return F.transform(records, lambda r: _struct(step(lambda n: r[n])))


def _steps(expected_bucket: str) -> list[Callable[[Fields], dict[str, Column]]]:
    """What is done to the raw fields of a record, one step after the other."""
    return [_stripped_fields, _clean_fields, _owned_fields, lambda fields: _event_fields(fields, expected_bucket)]


def parse_messages(messages: DataFrame, config: IntakeConfig) -> DataFrame:
    """Add ``error_class`` and ``events`` (array) to each message.

    All records of a message are parsed before any is used: the first bad
    record rejects the message and ``events`` is null. The verdict is reached
    inside the row, so this step needs no shuffle. The first record goes through
    the steps as plain columns, which Spark compiles; the others as an array,
    whose functions it interprets. An array function in a projection also keeps
    that projection out of the compiled stage, whose one method would otherwise
    grow too long for the JVM to compile.
    """
    bucket = config.expected_bucket.strip()
    parsed = messages.withColumn("message_id", X.non_blank(F.col("message_id"))).withColumn(
        "__body", V.parse_strict(F.col("body"))
    ).withColumn("__records", F.try_variant_get("__body", "$.Records", _RECORDS))
    keep = [*messages.columns, "__whole", "__n"]
    first = _raw_fields(F.get("__records", F.lit(0)))
    rest = F.transform(F.slice("__records", F.lit(2), F.size("__records")), lambda r: _struct(_raw_fields(r)))
    parsed = parsed.select(
        *messages.columns, F.col("__body").isNotNull().alias("__whole"), F.size("__records").alias("__n"),
        *_first(first), F.when(F.size("__records") > 1, rest).alias("__others"),
    )
    for step in _steps(bucket):
        first = step(lambda n: F.col(f"__1_{n}"))
        parsed = parsed.select(*keep, *_first(first), _each(F.col("__others"), step).alias("__others"))
    event = F.struct(*[F.col(f"__1_{n}").alias(n) for n in first])
    bad = F.filter("__others", lambda e: e["error_class"].isNotNull())
    error = (
        F.when(F.col("message_id").isNull() | ~F.col("__whole"), MALFORMED_MESSAGE)
        .when(F.coalesce(F.col("__n") <= 0, F.lit(True)), MALFORMED_NOTIFICATION)
        .otherwise(F.coalesce(F.col("__1_error_class"), F.get(bad, F.lit(0))["error_class"]))
    )
    events = F.when(F.col("__n") == 1, F.array(event)).otherwise(F.concat(F.array(event), F.col("__others")))
    verdict = F.struct(error.alias("error_class"), F.when(error.isNull(), events).alias("events"))
    # generated columns: later filters on the verdict stay above the parse
    # instead of being pushed below it as a second copy of every check
    return parsed.select(*messages.columns, F.inline(F.array(verdict)))


def flatten_events(parsed: DataFrame) -> DataFrame:
    """One row per record of the accepted messages, with ``rec_pos``."""
    keep = [c for c in parsed.columns if c not in ("events", "error_class", "body")]
    rows = parsed.where(F.col("events").isNotNull()).select(
        *keep, F.posexplode("events").alias("rec_pos", "e")
    )
    names = (
        "event_name", "bucket_name", "object_key", "job_id", "object_size",
        "etag", "sequencer", "version_id",
    )
    return rows.select(*keep, "rec_pos", *[F.col(f"e.{n}").alias(n) for n in names])


def event_violations(events: DataFrame) -> DataFrame:
    """Check typed events that did not come from the parser."""
    required = ("message_id", "event_name", "bucket_name", "object_key", "job_id")
    optional = ("etag", "sequencer", "version_id")
    checks = [F.when(X.is_blank(F.col(n)), F.lit(f"{n} is blank")) for n in required]
    checks += [
        F.when(F.col(n).isNotNull() & X.is_blank(F.col(n)), F.lit(f"{n} is blank"))
        for n in optional
    ]
    owner = X.job_id_from_key(F.col("object_key"))
    checks += [
        F.when(~F.col("event_name").rlike(_EVENT_NAME), F.lit("event_name is not a creation")),
        F.when(F.coalesce(F.col("object_size") < 0, F.lit(True)), F.lit("object_size is negative")),
        F.when(owner.isNull(), F.lit("object_key is not canonical")),
        F.when(owner != F.col("job_id"), F.lit("object_key has another owner")),
    ]
    return events.withColumn("violations", F.array_compact(F.array(*checks)))


def latest_by_sequencer(events: DataFrame) -> DataFrame:
    """Keep the newest notification per object key by its sequencer.

    Sequencers are hexadecimal numbers of any length: without leading zeros the
    longer one is newer, and of equal length the larger text. One aggregation
    with map-side combine, no window.
    """
    digits = F.ltrim(F.lower(F.coalesce("sequencer", F.lit(""))), F.lit("0"))
    row = F.struct(*[F.col(c) for c in events.columns])
    newest = events.groupBy("object_key").agg(
        F.max_by(row, F.struct(F.length(digits), digits, "message_id", "rec_pos")).alias("r")
    )
    return newest.select("r.*")
