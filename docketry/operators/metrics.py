"""Windowed metrics and alarm evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry import schemas as S
from docketry.session import cut_lineage


def period_start(ts: Column, seconds: int) -> Column:
    return F.window(ts, f"{seconds} seconds")["start"]


def floor_period(ts: Column, seconds: int) -> Column:
    """Period start by arithmetic, for rows that need more than one period."""
    micros = seconds * 1_000_000
    return F.timestamp_micros((F.floor(F.unix_micros(ts) / micros) * micros).cast("long"))


def per_period(
    df: DataFrame, ts: str, dims: list[str], aggregates: dict[str, Column], seconds: int = 300
) -> DataFrame:
    """Tumbling-window aggregates per dimension; partial sums before the shuffle."""
    return df.groupBy(*dims, period_start(F.col(ts), seconds).alias("period_start")).agg(
        *[c.alias(n) for n, c in aggregates.items()]
    )


def request_sums(telemetry: DataFrame, seconds: int = 300) -> DataFrame:
    """Requests, client and server errors, tokens and throttles per component."""
    code = F.col("status_code")
    return per_period(
        telemetry,
        "ts",
        ["component"],
        {
            "requests": F.count(F.lit(1)),
            "errors_4xx": F.count_if(code.between(400, 499)),
            "errors_5xx": F.count_if(code >= 500),
            "throttles": F.count_if(F.col("provider_error_code") == "ThrottlingException"),
            "input_tokens": F.sum("input_tokens"),
            "output_tokens": F.sum("output_tokens"),
        },
        seconds,
    )


def latency_maximum(telemetry: DataFrame, seconds: int = 300) -> DataFrame:
    return per_period(telemetry, "ts", ["component"], {"max_duration_ms": F.max("duration_ms")}, seconds)


def latency_p95(
    telemetry: DataFrame, seconds: int = 300, accuracy: int = 10_000
) -> DataFrame:
    """95th percentile per window from mergeable summaries of bounded size."""
    return per_period(
        telemetry,
        "ts",
        ["component"],
        {"p95_duration_ms": F.percentile_approx("duration_ms", 0.95, accuracy), "n": F.count(F.lit(1))},
        seconds,
    )


# ---- stored latency summaries ---------------------------------------------------


_ZERO = -(1 << 30)  # the bucket of values that are not above zero


def latency_summary(telemetry: DataFrame, seconds: int = 60, accuracy: float = 0.01) -> DataFrame:
    """Counts of latencies per period in buckets whose bounds grow by a fixed ratio, to be stored and merged.

    Bucket ``b`` holds the values above ``ratio**(b - 1)`` up to ``ratio**b``,
    ratio ``(1 + accuracy) / (1 - accuracy)``. A summary has a row per bucket in
    use, some 1,000 for each factor of 10**9 at one percent, however many values
    there are. Values that are not above zero share a bucket; nulls and NaN do not
    count.
    """
    ratio = (1 + accuracy) / (1 - accuracy)
    value = F.col("duration_ms")
    bucket = F.when(value > 0, F.ceil(F.log(value) / F.log(F.lit(ratio))).cast("int")).otherwise(_ZERO)
    counted = telemetry.where(value.isNotNull() & ~F.isnan(value))
    return counted.groupBy("component", period_start(F.col("ts"), seconds).alias("period_start"), bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )


def roll_up(summary: DataFrame, seconds: int) -> DataFrame:
    """Summaries of longer periods; merging adds counts, so nothing is lost on the way from minutes to days."""
    return summary.groupBy("component", period_start(F.col("period_start"), seconds).alias("period_start"), "bucket").agg(
        F.sum("n").alias("n")
    )


def summary_quantile(summary: DataFrame, quantile: float, accuracy: float = 0.01) -> DataFrame:
    """The value of rank ``ceil(quantile * n)`` per period, off by at most ``accuracy`` of itself.

    Ranks are exact: the bucket found is the one that holds the value of that
    rank, and no value of a bucket is farther from its estimate than that.
    """
    ratio = (1 + accuracy) / (1 - accuracy)
    whole = Window.partitionBy("component", "period_start")
    below = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as buckets
    ranked = summary.select("*", F.sum("n").over(below).alias("upto"), F.sum("n").over(whole).alias("total"))
    rank = F.ceil(F.col("total") * F.lit(quantile))
    found = ranked.where(F.col("upto") >= rank).groupBy("component", "period_start").agg(
        F.min("bucket").alias("bucket"), F.first("total").alias("n")
    )
    estimate = F.when(F.col("bucket") == _ZERO, 0.0).otherwise(2 * F.pow(F.lit(ratio), F.col("bucket")) / (1 + ratio))
    return found.select("component", "period_start", "n", estimate.alias("value"))


def gauges_at(deliveries: DataFrame, as_of: Column) -> DataFrame:
    """Visible, in-flight and oldest age per queue at one moment.

    ``deliveries`` holds ``(queue, sent_ts, received_ts, done_ts)``, with null
    for "not yet".
    """
    sent = F.col("sent_ts") <= as_of
    taken = F.coalesce(F.col("received_ts") <= as_of, F.lit(False))
    done = F.coalesce(F.col("done_ts") <= as_of, F.lit(False))
    waiting = sent & ~taken
    return deliveries.groupBy("queue").agg(
        F.count_if(waiting).alias("visible"),
        F.count_if(sent & taken & ~done).alias("in_flight"),
        F.max(
            F.when(waiting, (F.unix_micros(as_of) - F.unix_micros("sent_ts")) / 1_000_000)
        ).alias("oldest_age_s"),
    )


def queue_depth(deliveries: DataFrame, seconds: int = 60) -> DataFrame:
    """Visible and in-flight messages at the end of each period with a change.

    Each delivery becomes at most three steps, steps are summed per period
    first and the running totals run over periods, not rows.
    """
    steps = F.array(
        F.struct(F.col("sent_ts").alias("at"), F.lit(1).alias("visible"), F.lit(0).alias("in_flight")),
        F.struct(F.col("received_ts").alias("at"), F.lit(-1).alias("visible"), F.lit(1).alias("in_flight")),
        F.struct(F.col("done_ts").alias("at"), F.lit(0).alias("visible"), F.lit(-1).alias("in_flight")),
    )
    moved = (
        deliveries.select("queue", F.explode(steps).alias("s"))
        .where(F.col("s.at").isNotNull())
        .groupBy("queue", period_start(F.col("s.at"), seconds).alias("period_start"))
        .agg(F.sum("s.visible").alias("d_visible"), F.sum("s.in_flight").alias("d_in_flight"))
    )
    running = Window.partitionBy("queue").orderBy("period_start").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return moved.select(
        "queue",
        "period_start",
        F.sum("d_visible").over(running).alias("visible"),
        F.sum("d_in_flight").over(running).alias("in_flight"),
    )


def period_grid(rows: DataFrame, keep: list[str], start: Column, end: Column, seconds: Column | int) -> DataFrame:
    """A row for each period from ``start`` to ``end``, beside the columns ``keep``.

    Spread in two steps, so no array is longer than some hundred periods or chunks.
    """
    width = F.make_dt_interval(secs=F.lit(seconds) if isinstance(seconds, int) else seconds)
    ready = rows.where(start <= end).select(*keep, end.alias("__end"), width.alias("__step"), start.alias("__start"))
    chunks = ready.select("*", F.explode(F.sequence("__start", "__end", F.col("__step") * 512)).alias("__chunk"))
    last = F.least(F.col("__chunk") + F.col("__step") * 511, F.col("__end"))
    return chunks.select(*keep, F.explode(F.sequence("__chunk", last, "__step")).alias("period_start"))


def oldest_age(deliveries: DataFrame, seconds: int = 60, until: Column | None = None) -> DataFrame:
    """Age of the oldest waiting message at the end of each period up to ``until``.

    A message that was never received waits to the end; ``until`` is by default
    the last moment in the table. Messages are reduced to the earliest one per
    period of receipt; at the end of a period those received later are left, so
    one running minimum from the last period to the first gives the oldest.
    """
    if until is None:
        moments = [F.max(c) for c in ("sent_ts", "received_ts", "done_ts")]
        until = F.lit(deliveries.agg(F.greatest(*moments)).first()[0])
    step = F.make_dt_interval(secs=F.lit(seconds))
    last = floor_period(until, seconds)
    taken = floor_period(F.col("received_ts"), seconds) - step
    reduced = deliveries.groupBy("queue", F.least(F.coalesce(taken, last), last).alias("period_start")).agg(
        F.min("sent_ts").alias("sent_ts")
    )
    spans = reduced.groupBy("queue").agg(floor_period(F.min("sent_ts"), seconds).alias("__from"))
    grid = period_grid(spans, ["queue"], F.col("__from"), last, seconds)
    back = Window.partitionBy("queue").orderBy(F.col("period_start").desc()).rowsBetween(Window.unboundedPreceding, 0)
    left = grid.join(reduced, ["queue", "period_start"], "left").withColumn("oldest", F.min("sent_ts").over(back))
    end = F.unix_micros(F.col("period_start")) + seconds * 1_000_000
    age = (end - F.unix_micros("oldest")) / 1_000_000
    return left.where(floor_period(F.col("oldest"), seconds) <= F.col("period_start")).select(
        "queue", "period_start", age.alias("oldest_age_s")
    )


def alarms_table(spark: SparkSession) -> DataFrame:
    """The nine alarm definitions as a fixed dimension."""
    return spark.createDataFrame(
        list(S.ALARMS),
        "alarm string, metric string, statistic string, threshold double, period int, "
        "datapoints int, evaluation_periods int",
    )


def densify(
    points: DataFrame, dims: list[str], seconds: int, start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """All periods from ``start`` to ``end``, by default between the first and last point of a series.

    ``points`` is already one row per period, so the series is bounded by the
    covered time span.
    """
    span = points.groupBy(*dims).agg(
        F.min("period_start").alias("__from"), F.max("period_start").alias("__to")
    )
    first = F.col("__from") if start is None else floor_period(start, seconds)
    last = F.col("__to") if end is None else floor_period(end, seconds)
    return period_grid(span, dims, first, last, seconds).join(points, [*dims, "period_start"], "left")


def evaluate_alarm(
    points: DataFrame,
    dims: list[str],
    threshold: float,
    *,
    seconds: int,
    datapoints: int = 1,
    evaluation_periods: int = 1,
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """M-of-N evaluation of ``value`` per period; a missing period is no breach."""
    dense = densify(points, dims, seconds, start, end)
    breach = F.coalesce((F.col("value") >= threshold).cast("int"), F.lit(0))
    recent = Window.partitionBy(*dims).orderBy("period_start").rowsBetween(1 - evaluation_periods, 0)
    counted = dense.withColumn("breaching", F.sum(breach).over(recent))
    return counted.withColumn(
        "state", F.when(F.col("breaching") >= datapoints, "ALARM").otherwise("OK")
    )


def longest_look_back() -> int:
    """Seconds before a period that its state can depend on."""
    return max(period * (n - 1) for *_, period, _, n in S.ALARMS)


def evaluate_alarms(
    points: DataFrame, start: Column | None = None, end: Column | None = None, dims: tuple[str, ...] = ()
) -> DataFrame:
    """All alarms over metric points ``(metric, period_start, value)``.

    Every alarm gets a row for each of its periods from ``start`` to ``end`` (by
    default the first and last point of all metrics), also an alarm without
    points; a missing period is no breach, so a series can return to OK.
    ``dims`` are text columns of the points: each value of them is a series of
    its own, and metrics without it (null) are the series of the empty text.
    """
    if start is None or end is None:
        low, high = points.agg(F.min("period_start"), F.max("period_start")).first()
        start = F.lit(low).cast("timestamp") if start is None else start
        end = F.lit(high).cast("timestamp") if end is None else end
    alarms = alarms_table(points.sparkSession)
    rule = ["alarm", "metric", "threshold", "period", "datapoints", "evaluation_periods"]
    micros = F.col("period") * F.lit(1_000_000).cast("long")
    floor = lambda ts: F.timestamp_micros((F.floor(F.unix_micros(ts) / micros) * micros).cast("long"))
    filled = [F.coalesce(d, F.lit("")).alias(d) for d in dims]
    named = points.join(F.broadcast(alarms.select("alarm", "metric")), "metric").select("alarm", *filled, "period_start", "value")
    series = alarms.join(named.select("alarm", *dims).distinct(), "alarm", "left").select(*rule, *filled) if dims else alarms
    grid = period_grid(series, [*rule, *dims], floor(start), floor(end), F.col("period"))
    dense = grid.join(named, ["alarm", *dims, "period_start"], "left")
    breach = F.coalesce((F.col("value") >= F.col("threshold")).cast("int"), F.lit(0))
    by_time = Window.partitionBy("alarm", *dims).orderBy("period_start")
    breaching = F.lit(None).cast("long")
    for n in sorted({a[6] for a in S.ALARMS}):
        counted = F.sum(breach).over(by_time.rowsBetween(1 - n, 0))
        breaching = F.when(F.col("evaluation_periods") == n, counted).otherwise(breaching)
    return dense.withColumn("breaching", breaching).select(
        "alarm", *dims, "metric", "period_start", "value", "breaching",
        F.when(F.col("breaching") >= F.col("datapoints"), "ALARM").otherwise("OK").alias("state"),
    )


def state_changes(states: DataFrame, dims: list[str]) -> DataFrame:
    """Rows where the alarm state differs from the period before, newest first."""
    w = Window.partitionBy(*dims).orderBy("period_start")
    changed = states.withColumn("previous_state", F.coalesce(F.lag("state").over(w), F.lit("OK")))
    return changed.where(F.col("state") != F.col("previous_state")).orderBy(
        F.col("period_start").desc(), *dims
    )


# ---- the report -----------------------------------------------------------------


_PERIOD = 300
_REPORT = ("section", "label", "period_start", "metric", "value")


def event_flags() -> dict[str, Column]:
    """The event counts that alarms watch."""
    code = F.col("provider_error_code")
    return {
        "api_5xx": F.col("event_name").eqNullSafe("request.completed") & (F.col("status_code") >= 500),
        "processor_errors": F.col("event_name") == "processing.record_failed",
        "reconciler_errors": F.col("event_name") == "reconciliation.record_failed",
        "provider_throttles": code.eqNullSafe("ThrottlingException"),
        "provider_client_errors": code.eqNullSafe("AccessDeniedException"),
        "provider_server_errors": code.eqNullSafe("ServiceUnavailableException"),
    }


def report_periods(telemetry: DataFrame) -> DataFrame:
    """All counts, sums and latencies of the report, per component and five minutes, in one pass over the events."""
    code = F.col("status_code")
    return per_period(
        telemetry, "ts", ["component"],
        {
            "requests": F.count_if(F.col("event_name") == "request.completed"),
            "errors_4xx": F.count_if((F.col("event_name") == "request.completed") & code.between(400, 499)),
            "max_duration_ms": F.max("duration_ms"), "p95_duration_ms": F.percentile_approx("duration_ms", 0.95, 10_000),
            "input_tokens": F.sum("input_tokens"), "output_tokens": F.sum("output_tokens"),
            **{name: F.count_if(flag) for name, flag in event_flags().items()},
        },
        _PERIOD,
    )


_SECTIONS = {
    "traffic": ("requests", "errors_4xx", "api_5xx"),
    "latency": ("p95_duration_ms", "max_duration_ms"),
    "errors": ("processor_errors", "reconciler_errors", "provider_throttles", "provider_client_errors", "provider_server_errors"),
    "tokens": ("input_tokens", "output_tokens"),
}


def operations_report(telemetry: DataFrame, deliveries: DataFrame, *, start: Column, end: Column, top: int = 100) -> DataFrame:
    """Everything the operators look at, as rows ``section, label, period_start, metric, value``.

    Traffic, latency, errors and tokens per component and period; the depth of
    every queue and the age of its oldest message at ``end``; the last state of
    every alarm with the number of its periods in alarm; the newest failures. The
    event log is read once for all series: alarms are evaluated on the periods,
    which are kept, and only the newest failures look at events again.
    """
    periods = cut_lineage(report_periods(telemetry))
    pairs = F.array(
        *[
            F.struct(F.lit(section).alias("section"), F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"))
            for section, names in _SECTIONS.items() for name in names
        ]
    )
    series = periods.select(F.col("component").alias("label"), "period_start", F.inline(pairs)).where("value is not null")
    gauges = gauges_at(deliveries, end)
    queues = gauges.select(
        F.lit("queues").alias("section"), F.col("queue").alias("label"), end.alias("period_start"),
        F.inline(F.array(*[
            F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in ("visible", "in_flight", "oldest_age_s")
        ])),
    ).where("value is not null")
    counts = periods.groupBy("period_start").agg(*[F.sum(n).cast("double").alias(n) for n in event_flags()])
    events = counts.select(
        "period_start", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in event_flags()]))
    ).where("value > 0")
    ages = oldest_age(deliveries, until=end).select(
        "period_start", F.lit("queue_oldest_age").alias("metric"), F.col("oldest_age_s").cast("double").alias("value"), "queue"
    )
    states = evaluate_alarms(events.unionByName(ages, allowMissingColumns=True), start, end, ("queue",))
    alarms = states.groupBy("alarm", "queue").agg(
        F.max_by((F.col("state") == "ALARM").cast("double"), "period_start").alias("in_alarm"),
        F.count_if(F.col("state") == "ALARM").cast("double").alias("alarm_periods"), F.max("period_start").alias("period_start"),
    ).select(
        F.lit("alarms").alias("section"), F.concat_ws("/", "alarm", F.when(F.col("queue") != "", F.col("queue"))).alias("label"),
        "period_start", F.inline(F.array(*[
            F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in ("in_alarm", "alarm_periods")
        ])),
    )
    failures = (
        telemetry.where(F.col("event_name") == "processing.record_failed").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(top)
    )
    newest = failures.select(
        F.lit("failures").alias("section"), F.coalesce("job_id", F.lit("-")).alias("label"), F.col("ts").alias("period_start"),
        F.lit("event_id").alias("metric"), F.col("event_id").cast("double").alias("value"),
    )
    parts = [series, queues, alarms, newest]
    out = parts[0].select(*_REPORT)
    for part in parts[1:]:
        out = out.unionByName(part.select(*_REPORT))
    return out
