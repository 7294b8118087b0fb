"""Request-log rows: identity resolution, body rules and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import text as X
from docketry.functions import variants as V

REQUEST_ID = "x-request-id"
CORRELATION_ID = "x-correlation-id"

# fixed values: error code and status per dependency outcome
_OUTCOMES = {
    "create": {
        "invalid_request": (400, "invalid_request"),
        "conflict": (409, "job_conflict"),
        "dependency_failure": (503, "service_unavailable"),
        "internal_error": (500, "internal_error"),
        "succeeded": (201, None),
    },
    "get": {
        "invalid_request": (400, "invalid_request"),
        "not_found": (404, "job_not_found"),
        "dependency_failure": (503, "service_unavailable"),
        "internal_error": (500, "internal_error"),
        "succeeded": (200, None),
    },
}


def normalize_headers(headers: Column) -> Column:
    """Lower-case stripped names to stripped values; blanks out, last name wins.

    Blank entries go first, so a blank repeat can not replace a real value.
    """
    pairs = F.transform(
        F.map_entries(headers),
        lambda e: F.struct(F.lower(X.strip(e["key"])).alias("key"), X.strip(e["value"]).alias("value")),
    )
    kept = F.filter(pairs, lambda e: (e["key"] != "") & F.coalesce(e["value"] != "", F.lit(False)))
    # fold instead of a map constructor: no dependence on a session option
    empty = F.create_map().cast("map<string,string>")
    merged = F.aggregate(
        kept,
        empty,
        lambda acc, e: F.map_concat(
            F.map_filter(acc, lambda k, v: k != e["key"]),
            F.map_from_arrays(F.array(e["key"]), F.array(e["value"])),
        ),
    )
    return F.coalesce(merged, empty)


def merge_headers(defaults: Column, extra: Column) -> Column:
    """Response headers: extra entries replace defaults of the same name."""
    return F.map_concat(
        F.map_filter(defaults, lambda k, v: ~F.array_contains(F.map_keys(extra), k)), extra
    )


def resolve_context(requests: DataFrame) -> DataFrame:
    """Add request_id and correlation_id from headers, gateway id or a stable id."""
    named = requests.withColumn("__h", normalize_headers(F.col("headers")))
    request_id = F.coalesce(
        F.try_element_at("__h", F.lit(REQUEST_ID)),
        X.non_blank(F.col("gateway_request_id")),
        F.concat(F.lit("req_"), F.sha2("event_key", 256)),
    )
    return (
        named.withColumn("request_id", request_id)
        .withColumn(
            "correlation_id",
            F.coalesce(F.try_element_at("__h", F.lit(CORRELATION_ID)), F.col("request_id")),
        )
        .drop("__h")
    )


def body_accepted() -> Column:
    """Absent, blank or an empty JSON object, and never base64."""
    parsed = V.parse_strict(F.col("body"))
    empty_object = F.size(F.map_keys(V.as_object(parsed))) == 0
    return ~F.coalesce(F.col("is_base64"), F.lit(False)) & (
        X.is_blank(F.col("body")) | F.coalesce(empty_object, F.lit(False))
    )


def path_job_id(path_parameters: Column) -> Column:
    return X.non_blank(F.try_element_at(path_parameters, F.lit("job_id")))


def classify(requests: DataFrame, operation: str, outcome: Column) -> DataFrame:
    """Add outcome, status_code and error_code for ``create`` or ``get``."""
    table = _OUTCOMES[operation]
    status: Column = F.lit(500)
    code: Column = F.lit("internal_error")
    for name, (number, text) in table.items():
        status = F.when(F.col("outcome") == name, number).otherwise(status)
        code = F.when(F.col("outcome") == name, F.lit(text)).otherwise(code)
    return (
        requests.withColumn("outcome", outcome)
        .withColumn("status_code", status)
        .withColumn("error_code", code)
    )


def severity(status_code: Column) -> Column:
    return (
        F.when(status_code.between(200, 399), "info")
        .when(status_code.between(400, 499), "warning")
        .when(status_code >= 500, "error")
    )


def valid_status(status_code: Column) -> Column:
    return F.coalesce(status_code.between(100, 599), F.lit(False))


def error_payload(code: Column, message: Column, request_id: Column, correlation_id: Column) -> Column:
    """Compact error document of a failed request."""
    return F.to_json(
        F.struct(
            F.struct(
                code.alias("code"),
                message.alias("message"),
                request_id.alias("request_id"),
                correlation_id.alias("correlation_id"),
            ).alias("error")
        )
    )
