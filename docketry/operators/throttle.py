"""Route rate limits: token buckets over request logs of any length.

A bucket holds at most ``burst`` tokens and gains ``rate`` a second; a request
takes one or is throttled. That is sequential, but what a stretch of requests does
to a bucket is a function from tokens before to tokens after, made of few pieces
that either shift or forget their argument, and such functions compose. So the
requests are sorted by route and time over all partitions, wherever the cuts fall;
each partition reduces its part of a route to one function, the functions are
composed in a tree, and with the tokens it starts with each partition then judges
its own requests. No route is ever in one task.

Tokens are counted in millionths, so a microsecond adds ``rate`` of them and all
arithmetic is exact.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.session import cut_lineage
from docketry.shipping import ship_with_tasks

ship_with_tasks(__name__)

TOKEN = 1_000_000
FAN_OUT = 256
_PARTS = "route string, part long, first_us long, last_us long, starts array<long>, shifts array<boolean>, values array<long>"
_ENTRIES = "route string, part long, tokens long"


class Effect:
    """A function on 0..full: from ``starts[k]`` on, ``x + values[k]`` where ``shifts[k]``, else ``values[k]``."""

    def __init__(self, full: int, starts=(0,), shifts=(True,), values=(0,)):
        self.full, self.starts, self.shifts, self.values = full, list(starts), list(shifts), list(values)

    def at(self, x: int) -> int:
        k = bisect_right(self.starts, x) - 1
        return x + self.values[k] if self.shifts[k] else self.values[k]

    @property
    def constant(self) -> int | None:
        return self.values[0] if len(self.starts) == 1 and not self.shifts[0] else None

    def _rebuilt(self, pieces: list[tuple[int, bool, int]]) -> None:
        kept: list[tuple[int, bool, int]] = []
        for piece in pieces:
            if not kept or kept[-1][1:] != piece[1:]:
                kept.append(piece)
        self.starts, self.shifts, self.values = (list(c) for c in zip(*kept))

    def _ends(self) -> list[int]:
        return [*self.starts[1:], self.full + 1]

    def refill(self, gained: int) -> None:
        """Gain tokens, up to full."""
        if gained >= self.full:
            self.starts, self.shifts, self.values = [0], [False], [self.full]
            return
        pieces = []
        for start, end, shift, value in zip(self.starts, self._ends(), self.shifts, self.values):
            value += gained
            if not shift:
                pieces.append((start, False, min(value, self.full)))
                continue
            over = self.full - value  # the largest argument that stays within full
            if start <= over:
                pieces.append((start, True, value))
            if over + 1 < end:
                pieces.append((max(start, over + 1), False, self.full))
        self._rebuilt(pieces)

    def take(self) -> None:
        """Take a token where there is one."""
        pieces = []
        for start, end, shift, value in zip(self.starts, self._ends(), self.shifts, self.values):
            if not shift:
                pieces.append((start, False, value - TOKEN if value >= TOKEN else value))
                continue
            enough = TOKEN - value  # the least argument that leaves a token
            if start < enough:
                pieces.append((start, True, value))
            if enough < end:
                pieces.append((max(start, enough), True, value - TOKEN))
        self._rebuilt(pieces)

    def then(self, other: "Effect") -> "Effect":
        """``other`` after this one."""
        pieces = []
        for start, end, shift, value in zip(self.starts, self._ends(), self.shifts, self.values):
            if not shift:
                pieces.append((start, False, other.at(value)))
                continue
            for s, e, other_shift, other_value in zip(other.starts, other._ends(), other.shifts, other.values):
                low = max(start, s - value)
                if low < min(end, e - value):
                    pieces.append((low, other_shift, value + other_value if other_shift else other_value))
        out = Effect(self.full)
        out._rebuilt(pieces)
        return out


def _judge(tokens: int, last: int | None, us: list[int], rate: int, full: int) -> tuple[list[bool], int]:
    """Which requests are throttled, from ``tokens`` at ``last``; the tokens left."""
    out = []
    for t in us:
        if last is not None:
            tokens = min(full, tokens + rate * (t - last))
        last = t
        served = tokens >= TOKEN
        tokens -= TOKEN * served
        out.append(not served)
    return out, tokens


def _effect(us: list[int], rate: int, full: int) -> Effect:
    """What requests do to the tokens there are when the first arrives."""
    effect, last = Effect(full), us[0]
    for n, t in enumerate(us):
        if n:
            effect.refill(rate * (t - last))
        last = t
        effect.take()
        if (known := effect.constant) is not None:  # the start is forgotten: plain counting from here
            _, left = _judge(known, t, us[n + 1 :], rate, full)
            return Effect(full, [0], [False], [left])
    return effect


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """The parts of sorted batches with one route each."""
    for batch in batches:
        routes = batch.column(0).to_pylist()
        start = 0
        for k in range(1, len(routes) + 1):
            if k == len(routes) or routes[k] != routes[start]:
                yield routes[start], batch.slice(start, k - start)
                start = k


def _limit(limits: dict[str, tuple[int, int]], route: str) -> tuple[int, int]:
    rate, burst = limits[route]
    return rate, burst * TOKEN


def _parts(limits: dict[str, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), []
        for route, rows in _runs(batches):
            us = rows.column(1).to_pylist()
            rate, full = _limit(limits, route)
            own = _effect(us, rate, full)
            if done and done[-1][0] == route:  # a batch ended inside the route
                _, first, last, before = done.pop()
                before.refill(rate * (us[0] - last))
                done.append((route, first, us[-1], before.then(own)))
            else:
                done.append((route, us[0], us[-1], own))
        yield _part_rows([(r, part, a, b, e) for r, a, b, e in done])

    return run


def _part_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*[(r, p, a, b, e.starts, e.shifts, e.values) for r, p, a, b, e in rows])) or [()] * 7
    kinds = [pa.string(), *[pa.int64()] * 3, pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
    names = [f.split()[0] for f in _PARTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _children(table: pa.Table, limits) -> list[tuple[int, int, int, Effect]]:
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    full = _limit(limits, rows[0]["route"])[1]
    return [(r["part"], r["first_us"], r["last_us"], Effect(full, r["starts"], r["shifts"], r["values"])) for r in rows]


def _composing(limits):
    """The parts of one group as one part."""

    def run(table: pa.Table) -> pa.Table:
        route = table["route"][0].as_py()
        rate, _ = _limit(limits, route)
        (part, first, last, effect), *others = _children(table, limits)
        for _, begins, ends, other in others:
            effect.refill(rate * (begins - last))
            effect, last = effect.then(other), ends
        return pa.Table.from_batches([_part_rows([(route, part // FAN_OUT, first, last, effect)])])

    return run


def _entering(limits):
    """The tokens before each part of one group, from those before the group."""

    def run(parts: pa.Table, group: pa.Table) -> pa.Table:
        route = parts["route"][0].as_py()
        rate, full = _limit(limits, route)
        tokens, last, out = group["tokens"][0].as_py(), None, []
        for part, first, ends, effect in _children(parts, limits):
            if last is not None:
                tokens = min(full, tokens + rate * (first - last))
            out.append((part, tokens))
            tokens, last = effect.at(tokens), ends
        return pa.table({"route": [route] * len(out), "part": [p for p, _ in out], "tokens": [t for _, t in out]})

    return run


def _judging(limits, entries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        route, tokens, last = None, 0, None
        for batch in batches:
            flags = []
            for found, rows in _runs(iter([batch])):
                if found != route:
                    route, tokens, last = found, entries.value[found, part], None
                us = rows.column(1).to_pylist()
                throttled, tokens = _judge(tokens, last, us, *_limit(limits, route))
                last = us[-1]
                flags += throttled
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(flags, pa.bool_())], names=["row", "throttled"])

    return run


def throttle(
    requests: DataFrame, limits: dict[str, tuple[int, int]], *, route: str = "route", ts: str = "ts",
    order: str = "event_id", parts: int | None = None,
) -> DataFrame:
    """Add ``throttled``: the requests that the token bucket of their route refuses.

    ``limits`` maps a route to tokens a second and burst. Requests of one moment
    are taken by ``order``; buckets are full at first. Routes without a limit, and
    rows without route or time, are never throttled.
    """
    spark = requests.sparkSession
    limited = F.col(route).isin(list(limits)) & F.col(ts).isNotNull()
    held = F.struct(*[F.col(f"`{c}`") for c in requests.columns]).alias("row")
    slim = requests.where(limited).select(F.col(route).alias("route"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), held)
    number = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    position = ["route", "us", F.col("row").getField(order)]
    # both passes must see the same cuts, so they read one checkpoint
    rows = cut_lineage(slim.repartitionByRange(number, *position).sortWithinPartitions(*position))
    levels = [cut_lineage(rows.select("route", "us").mapInArrow(_parts(limits), _PARTS))]
    reached = rows.rdd.getNumPartitions()
    while reached > 1:
        group = F.floor(F.col("part") / FAN_OUT).cast("long")
        levels.append(cut_lineage(levels[-1].groupBy("route", group.alias("g")).applyInArrow(_composing(limits), _PARTS)))
        reached = -(-reached // FAN_OUT)
    full = F.create_map(*[F.lit(x) for r in limits for x in (r, limits[r][1] * TOKEN)])
    entries = levels[-1].select("route", "part", full[F.col("route")].cast("long").alias("tokens"))
    for level in reversed(levels[:-1]):
        own = level.withColumn("g", F.floor(F.col("part") / FAN_OUT).cast("long"))
        above = entries.select("route", F.col("part").alias("g"), "tokens")
        entries = cut_lineage(own.groupBy("route", "g").cogroup(above.groupBy("route", "g")).applyInArrow(_entering(limits), _ENTRIES))
    # a row for each partition and route in it: partitions and routes bound it, not requests
    known = {(r.route, r.part): r.tokens for r in entries.collect()}
    shared = spark.sparkContext.broadcast(known)
    schema = T.StructType([rows.schema["row"], T.StructField("throttled", T.BooleanType())])
    judged = rows.mapInArrow(_judging(limits, shared), schema).select("row.*", "throttled")
    free = requests.where(~F.coalesce(limited, F.lit(False))).withColumn("throttled", F.lit(False))
    return judged.unionByName(free)
