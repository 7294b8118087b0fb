"""Replay of a delivery history into the final state of each job.

A delivery claims the job when it is pending or its lease has run out. What
happens next is recorded with the delivery: ``complete`` and ``fail`` end the
job, ``release`` gives it back, ``crash`` leaves the lease standing. Deliveries
that meet a live lease or an ended job change nothing.

The claim chain of one job is sequential, so a hot job is cut into time slices.
A slice does not know the lease it starts under, but every possible start is
"the first row at or after some moment", and that moment lies within one lease
of the slice. So each slice is reduced, independently, to a short table *entry
row -> state after the slice*; a second pass walks these tables in order.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators import skew
from docketry.session import cut_lineage
from docketry.shipping import ship_with_tasks

ship_with_tasks(__name__)

RESULTS = ("complete", "fail", "release", "crash")

_SLICE = (
    "job_id string, __seg long, upto long, kind string, lease long, attempts long, "
    "changed long, ended_at long, n long"
)
_FINAL = (
    "job_id string, status string, attempts long, lease_us long, changed_us long, "
    "active long, applied long, deliveries long"
)
_NONE = -1


def _slice_table(ts: np.ndarray, result: list[str], lease_us: int, every_entry: bool) -> list[tuple]:
    """State after the slice for each entry row, computed from the last row back."""
    n = len(ts)
    # first row at or after the lease end of each row
    after_lease = np.searchsorted(ts, ts + lease_us, side="left")
    state: list[tuple] = [()] * (n + 1)
    state[n] = ("pending_upload", _NONE, 0, _NONE, _NONE)
    for i in range(n - 1, -1, -1):
        what, now = result[i], int(ts[i])
        if what == "complete" or what == "fail":
            state[i] = ("succeeded" if what == "complete" else "failed", _NONE, 1, now, i)
            continue
        following = i + 1 if what == "release" else int(after_lease[i])
        if what == "crash" and following == n:
            state[i] = ("processing", now + lease_us, 1, now, _NONE)
            continue
        kind, lease, attempts, changed, ended = state[following]
        state[i] = (kind, lease, attempts + 1, now if changed == _NONE else changed, ended)
    last_entry = int(np.searchsorted(ts, ts[0] + lease_us, side="left")) if every_entry else 0
    return [(int(ts[i]), *state[i], n) for i in range(min(last_entry, n - 1) + 1)]


def _grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Consecutive groups of a sorted stream of batches."""
    current, parts = None, []
    for batch in batches:
        if batch.empty:
            continue
        marks = batch[keys].assign(__seg=batch["__seg"].astype("float64").fillna(_NONE))
        change = (marks != marks.shift()).any(axis=1).to_numpy()
        starts = np.flatnonzero(change)
        stops = np.append(starts[1:], len(batch))
        for a, b in zip(starts, stops):
            key = tuple(marks.iloc[a])
            if key != current and parts:
                yield current, pd.concat(parts)
                parts = []
            current = key
            parts.append(batch.iloc[a:b])
    if parts:
        yield current, pd.concat(parts)


def fold_slices(lease_seconds: int):
    lease_us = lease_seconds * 1_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for (job_id, seg), rows in _grouped(batches, ["job_id", "__seg"]):
            table = _slice_table(rows["us"].to_numpy(), rows["result"].tolist(), lease_us, seg != _NONE)
            out.extend((job_id, seg, *line) for line in table)
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=_names(_SLICE))
                out = []
        yield pd.DataFrame(out, columns=_names(_SLICE))

    return run


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(",")]


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Second pass: the tables of one job in time order."""
    out: list[tuple] = []
    job, state = None, None

    def finish() -> None:
        kind, lease, attempts, changed, ended, seen = state
        applied = seen - ended if ended != _NONE else 0
        out.append((job, kind, attempts, lease, changed, seen - attempts - applied, applied, seen))

    for (job_id, _), table in _grouped(batches, ["job_id", "__seg"]):
        if job_id != job:
            if job is not None:
                finish()
            job, state = job_id, ("pending_upload", _NONE, 0, _NONE, _NONE, 0)
        kind, lease, attempts, changed, ended, seen = state
        n = int(table["n"].iloc[0])
        entry = 0
        if kind == "processing":
            entry = int(np.searchsorted(table["upto"].to_numpy(), lease, side="left"))
        if ended == _NONE and entry < len(table):
            line = table.iloc[entry]
            kind, lease = line["kind"], int(line["lease"])
            attempts += int(line["attempts"])
            changed = int(line["changed"])
            if line["ended_at"] != _NONE:
                ended = seen + int(line["ended_at"]) + 1
        state = (kind, lease, attempts, changed, ended, seen + n)
        if len(out) > 50_000:
            yield pd.DataFrame(out, columns=_names(_FINAL))
            out.clear()
    if job is not None:
        finish()
    yield pd.DataFrame(out, columns=_names(_FINAL))


def replay(
    history: DataFrame,
    order: list[str],
    *,
    lease_seconds: int,
    slice_seconds: int = 3600,
    **hot_options,
) -> DataFrame:
    """Final state per job of ``(job_id, ts, result, ...)`` in ``order``.

    ``order`` starts with ``ts``. Jobs that are not hot are one slice each.
    """
    cut, _ = skew.with_segments(history.where("job_id IS NOT NULL"), ["job_id"], "ts", seconds=slice_seconds, **hot_options)
    slim = cut.select("job_id", "__seg", *order, F.unix_micros("ts").alias("us"), "result")
    slices = (
        slim.repartition("job_id", "__seg")
        .sortWithinPartitions("job_id", "__seg", *order)
        .mapInPandas(fold_slices(lease_seconds), _SLICE)
    )
    final = (
        slices.repartition("job_id")
        .sortWithinPartitions("job_id", "__seg", "upto")
        .mapInPandas(_walk, _FINAL)
    )
    known = lambda c: F.when(F.col(c) != _NONE, F.timestamp_micros(c))
    return final.select(
        "job_id",
        "status",
        "attempts",
        known("lease_us").alias("lease_expires_at"),
        known("changed_us").alias("updated_at"),
        "active",
        "applied",
        "deliveries",
    )


# ---- replay over sorted partitions ------------------------------------------------

FAN_OUT = 16
_PART = "job_id string, part long, first_us long, uptos array<long>, kinds array<string>, leases array<long>"
_ENTRY = "job_id string, part long, kind string, lease long"
_TOTALS = "job_id string, part long, kind string, lease long, attempts long, changed long, active long, applied long, n long"
_ENDED = ("succeeded", "failed")


def _run(ts: np.ndarray, result: list[str], lease_us: int, kind: str, lease: int) -> tuple[str, int, int, int, int, int]:
    """Deliveries from one state on: state, claims, moment of the last claim, rows that met a lease, rows after the end."""
    n, i, attempts, changed = len(ts), 0, 0, _NONE
    if kind in _ENDED:
        return kind, lease, 0, _NONE, 0, n
    if kind == "processing":
        i = int(np.searchsorted(ts, lease, side="left"))
    while i < n:
        what, now = result[i], int(ts[i])
        attempts, changed = attempts + 1, now
        if what in ("complete", "fail"):
            kind, lease, rest = ("succeeded" if what == "complete" else "failed"), _NONE, n - i - 1
            return kind, lease, attempts, changed, n - rest - attempts, rest
        if what == "release":
            kind, lease, i = "pending_upload", _NONE, i + 1
        else:
            kind, lease = "processing", now + lease_us
            i = int(np.searchsorted(ts, lease, side="left"))
    return kind, lease, attempts, changed, n - attempts, 0


class Passage:
    """What a stretch of deliveries makes of the lease it starts under.

    Sorted by the latest lease end they hold for: ``kinds`` and ``leases`` after
    the stretch. A lease that ends after the last delivery passes unchanged. The
    first entry also holds for a job that is pending; an ended job stays so.
    """

    def __init__(self, uptos: list[int], kinds: list[str], leases: list[int]):
        self.uptos, self.kinds, self.leases = uptos, kinds, leases

    def after(self, kind: str, lease: int) -> tuple[str, int]:
        if kind in _ENDED:
            return kind, lease
        at = bisect_left(self.uptos, lease) if kind == "processing" else 0
        return (kind, lease) if at == len(self.uptos) else (self.kinds[at], self.leases[at])

    @staticmethod
    def of(ts: np.ndarray, result: list[str], lease_us: int) -> "Passage":
        """From the last row back; rows behind one lease after the first can not be the first claim."""
        table = _slice_table(ts, result, lease_us, True)
        return Passage.merged([(upto, kind, lease) for upto, kind, lease, *_ in table])

    @staticmethod
    def merged(entries: list[tuple[int, str, int]]) -> "Passage":
        """Neighbours that lead to the same state are one entry."""
        kept: list[tuple[int, str, int]] = []
        for entry in entries:
            if kept and kept[-1][1:] == entry[1:]:
                kept.pop()
            kept.append(entry)
        return Passage(*([list(c) for c in zip(*kept)] or [[], [], []]))

    def then(self, other: "Passage", latest: int) -> "Passage":
        """``other`` after this one; no lease that enters ends after ``latest``."""
        entries = [(u, *other.after(k, x)) for u, k, x in zip(self.uptos, self.kinds, self.leases)]
        last = self.uptos[-1] if self.uptos else _NONE
        entries += [e for e in zip(other.uptos, other.kinds, other.leases) if e[0] > last and (not entries or entries[-1][0] < latest)]
        return Passage.merged(entries)


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, pd.DataFrame]]:
    """The rows of each job in a sorted partition."""
    job, parts = None, []
    for batch in batches:
        if batch.empty:
            continue
        names = batch["job_id"].to_numpy()
        starts = np.concatenate(([0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]))
        for a, b in zip(starts[:-1], starts[1:]):
            if names[a] != job and parts:
                yield job, pd.concat(parts)
                parts = []
            job = names[a]
            parts.append(batch.iloc[a:b])
    if parts:
        yield job, pd.concat(parts)


def _passages(lease_us: int):
    """A row for the first and for the last job of a partition; all others begin and end in it."""

    def row(job: str, rows: pd.DataFrame) -> tuple:
        p = Passage.of(rows["us"].to_numpy(), rows["result"].tolist(), lease_us)
        return job, TaskContext.get().partitionId(), int(rows["us"].iloc[0]), p.uptos, p.kinds, p.leases

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        for job, rows in _stretches(batches):
            first, last = first or row(job, rows), (job, rows)
        out = [first] if first else []
        if last and last[0] != first[0]:
            out.append(row(*last))
        yield pd.DataFrame(out, columns=_names(_PART))

    return run


def _members(table: pd.DataFrame) -> list[tuple[int, int, Passage]]:
    rows = table.sort_values("part")
    return [(int(p), int(f), Passage(list(u), list(k), list(x))) for p, f, u, k, x in zip(rows["part"], rows["first_us"], rows["uptos"], rows["kinds"], rows["leases"])]


def _composing(lease_us: int):
    def run(table: pd.DataFrame) -> pd.DataFrame:
        (part, first, passage), *others = _members(table)
        for _, _, other in others:
            passage = passage.then(other, first + lease_us)
        row = (table["job_id"].iloc[0], part // FAN_OUT, first, passage.uptos, passage.kinds, passage.leases)
        return pd.DataFrame([row], columns=_names(_PART))

    return run


def _entering(parts: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
    kind, lease, out = group["kind"].iloc[0], int(group["lease"].iloc[0]), []
    for part, _, passage in _members(parts):
        out.append((parts["job_id"].iloc[0], part, kind, lease))
        kind, lease = passage.after(kind, lease)
    return pd.DataFrame(out, columns=_names(_ENTRY))


def _totals(lease_us: int, entries):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, out = TaskContext.get().partitionId(), []
        for job, rows in _stretches(batches):
            kind, lease = entries.value.get((job, part), ("pending_upload", _NONE))
            kind, lease, attempts, changed, active, applied = _run(rows["us"].to_numpy(), rows["result"].tolist(), lease_us, kind, lease)
            out.append((job, part, kind, lease, attempts, changed, active, applied, len(rows)))
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=_names(_TOTALS))
                out = []
        yield pd.DataFrame(out, columns=_names(_TOTALS))

    return run


def replay_sorted(history: DataFrame, order: list[str], *, lease_seconds: int, parts: int | None = None) -> DataFrame:
    """``replay`` for jobs of any size: the columns and rows are the same.

    Deliveries are sorted by job and ``order`` over all partitions, wherever the
    cuts fall. Of a partition only the first and last job can go on beyond it;
    what their part makes of an entering lease is a short table, those tables are
    composed in a tree of ``FAN_OUT``, and with its entry state each partition
    replays its own rows. No task holds more than a partition, whatever one job
    holds or how long its lease is.
    """
    spark, lease_us = history.sparkSession, lease_seconds * 1_000_000
    slim = history.where("job_id IS NOT NULL").select("job_id", *order, F.unix_micros("ts").alias("us"), "result")
    number = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # both passes must see the same cuts, so they read one checkpoint
    rows = cut_lineage(slim.repartitionByRange(number, "job_id", *order).sortWithinPartitions("job_id", *order)).select("job_id", "us", "result")
    levels = [cut_lineage(rows.mapInPandas(_passages(lease_us), _PART))]
    reached = rows.rdd.getNumPartitions()
    while reached > 1:
        group = F.floor(F.col("part") / FAN_OUT).cast("long")
        levels.append(cut_lineage(levels[-1].groupBy("job_id", group.alias("g")).applyInPandas(_composing(lease_us), _PART)))
        reached = -(-reached // FAN_OUT)
    entries = levels[-1].select("job_id", "part", F.lit("pending_upload").alias("kind"), F.lit(_NONE).cast("long").alias("lease"))
    for level in reversed(levels[:-1]):
        own = level.withColumn("g", F.floor(F.col("part") / FAN_OUT).cast("long"))
        above = entries.select("job_id", F.col("part").alias("g"), "kind", "lease")
        entries = cut_lineage(own.groupBy("job_id", "g").cogroup(above.groupBy("job_id", "g")).applyInPandas(lambda a, b: _entering(a, b), _ENTRY))
    # two rows a partition at most, whatever the input
    known = {(r.job_id, r.part): (r.kind, r.lease) for r in entries.collect()}
    totals = rows.mapInPandas(_totals(lease_us, spark.sparkContext.broadcast(known)), _TOTALS)
    final = totals.groupBy("job_id").agg(
        F.max_by(F.struct("kind", "lease"), "part").alias("last"), F.sum("attempts").alias("attempts"), F.max("changed").alias("changed"),
        F.sum("active").alias("active"), F.sum("applied").alias("applied"), F.sum("n").alias("deliveries"),
    )
    moment = lambda c: F.when(F.col(c) != _NONE, F.timestamp_micros(c))
    return final.select(
        "job_id", F.col("last.kind").alias("status"), "attempts", moment("last.lease").alias("lease_expires_at"),
        moment("changed").alias("updated_at"), "active", "applied", "deliveries",
    )
