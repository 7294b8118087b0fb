"""Packing token sequences: bin completion on the histogram of piece lengths.

How many sequences are needed depends only on how many pieces there are of each
length, at most ``limit`` numbers. So the search runs on that histogram, and a
step fixes a filling and how often it is used; the plan has a bounded number of
segments "pieces of this length, these ordinals, go to these sequences".
Tokenizing, numbering and placing the pieces are Spark jobs.

The search takes the largest remaining length and completes its sequence. The
first plan is best fit decreasing. Restarts go straight down: each takes, again
and again, the completion of the largest value, where a piece is worth a power of
its length. No such completion is dominated (a longer piece is worth more than
what fits into it), and the power decides between few long pieces with some waste
and many short ones without, which is what best fit gets wrong; powers are tried
on a grid, then more closely about the best. Then branch and bound enumerates
undominated fillings by rising waste, depth first; a branch is cut when its waste,
and what its remaining pieces waste at least, reach that of the best plan so far.
Its first pass uses a filling as often as the pieces allow, its second branches on
fewer uses too, so fillings of one largest length are mixed. All of this ends when
the lower bound is met; otherwise restarts end after ``effort`` lengths tried, and
each pass after ``nodes`` steps or when it has run out.

Defined results: null and empty texts are one token (the end id); an empty
table gives an empty result; pieces of repeated rows or null ids are placed one
by one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm import tokens
from docketry.llm.common import materialize, narrow, slices
from docketry.shipping import ship_with_tasks

ship_with_tasks(__name__)

Step = tuple[dict[int, int], int]  # lengths of one sequence with their counts, and how many such sequences


def lower_bound(counts: np.ndarray, limit: int) -> int:
    """Sequences that any plan needs: by content, and by what large pieces leave to middle ones."""
    number, content = np.cumsum(counts), np.cumsum(counts * np.arange(limit + 1))
    half = limit // 2
    a = np.arange(half + 1)
    huge = number[limit] - number[limit - a]
    large = number[limit - a] - number[half]
    free = large * limit - (content[limit - a] - content[half])
    middle = content[half] - np.where(a > 0, content[a - 1], 0)
    more = np.maximum(0, -((free - middle) // limit))
    return max(-(-int(content[-1]) // limit), int((huge + large + more).max()))


def root_bound(counts: np.ndarray, limit: int) -> int:
    """A stronger bound by dual feasible functions: weights of which no sequence holds more than one in all."""
    size, best = np.arange(limit + 1), lower_bound(counts, limit)
    for k in range(1, 25):
        cut = size * (k + 1)
        weight = np.where(cut % limit == 0, size / limit, cut // limit / k)
        # pieces above limit - a take a whole sequence, those below a nothing
        held = np.concatenate(([0.0], np.cumsum(weight * counts)))
        a = np.arange(1, limit // 2 + 1)
        whole = np.cumsum(counts)[limit] - np.cumsum(counts)[limit - a]
        total = whole + held[limit - a + 1] - held[a]
        best = max(best, int(np.ceil(total.max() - 1e-6)) if len(a) else 0)
    return best


def best_fit(counts: np.ndarray, limit: int) -> list[Step]:
    """Best fit decreasing, sequence pattern by sequence pattern."""
    left, plan = counts.copy(), []
    while (sizes := np.flatnonzero(left)).size:
        room, used = limit, {}
        while (fits := sizes[(sizes <= room) & (left[sizes] > 0)]).size:
            take = int(fits[-1])
            n = min(room // take, int(left[take]))
            used[take], left[take], room = n, left[take] - n, room - n * take
        for s, n in used.items():
            left[s] += n
        plan.append(_apply(left, used))
    return plan


def _apply(left: np.ndarray, used: dict[int, int]) -> Step:
    """Use a filling as often as the pieces allow."""
    times = min(int(left[s]) // n for s, n in used.items())
    for s, n in used.items():
        left[s] -= n * times
    return used, times


def fillings(left: np.ndarray, room: int, waste: int, effort: int = 2000) -> Iterator[dict[int, int]]:
    """Undominated fillings of ``room`` that leave at most ``waste``, by rising waste.

    A piece that fills the room alone dominates all else. Otherwise sums that
    smaller lengths can reach (as bits of one integer) cut the search, and so
    does a pair for which one unused piece could stand. After ``effort`` steps
    the best-fit filling ends the list.
    """
    if room == 0 or left[room]:
        yield {room: 1} if room else {}
        return
    sizes = [int(s) for s in np.flatnonzero(left[: room + 1])[::-1]]
    number = {s: int(left[s]) for s in sizes}
    reach, full = [1] * (len(sizes) + 1), (1 << (room + 1)) - 1
    for i in range(len(sizes) - 1, -1, -1):
        sums, step, n = reach[i + 1], sizes[i], number[sizes[i]]
        while n > 0 and step <= room:  # doubling: up to n copies, at least
            sums |= (sums << step) & full
            n, step = n // 2, step * 2
        reach[i] = sums

    def replaceable(total: int, used: dict[int, int]) -> bool:
        return number.get(total, 0) > used.get(total, 0)

    def search(i: int, rest: int, used: dict[int, int]) -> Iterator[dict[int, int]]:
        nonlocal effort
        if rest == 0:
            yield dict(used)
            return
        for j in range(i, len(sizes)):
            effort -= 1
            s = sizes[j]
            if effort < 0 or not reach[j] >> rest & 1:
                return
            if s > rest or any(replaceable(s + u, used) for u in used):
                continue
            for n in range(min(rest // s, number[s], 1 if replaceable(2 * s, used) else room), 0, -1):
                if reach[j + 1] >> (rest - n * s) & 1:
                    used[s] = n
                    yield from search(j + 1, rest - n * s, used)
                    del used[s]

    for free in range(min(waste, room) + 1):
        if reach[0] >> (room - free) & 1:
            for used in search(0, room - free, {}):
                if not _dominated(used, number, free):
                    yield used
        if effort < 0:
            break
    rest, greedy = room, {}
    for s in sizes:
        if n := min(rest // s, number[s]):
            greedy[s], rest = n, rest - n * s
    if rest <= waste:
        yield greedy


def _dominated(used: dict[int, int], number: dict[int, int], free: int) -> bool:
    """Could an unused piece be added, or stand in for a smaller one of the filling?"""
    spare = [s for s in range(1, free + 1) if number.get(s, 0) > used.get(s, 0)]
    return bool(spare) or any(number.get(s + d, 0) > used.get(s + d, 0) for s in used for d in range(1, free + 1))


def completion(left: np.ndarray, room: int, value: np.ndarray) -> tuple[dict[int, int], int]:
    """The pieces of greatest total value that ``room`` can hold, and the number of lengths tried."""
    best, taken = np.zeros(room + 1), []
    for s in np.flatnonzero(left[: room + 1])[::-1].tolist():
        n, copies = min(int(left[s]), room // s), 1
        while n > 0:  # copies by doubling
            copies = min(copies, n)
            weight = copies * s
            with_it = best[: room + 1 - weight] + copies * value[s]
            better = with_it > best[weight:]
            best[weight:][better] = with_it[better]
            taken.append((s, copies, weight, better))
            n, copies = n - copies, 2 * copies
    used: dict[int, int] = {}
    for s, copies, weight, better in reversed(taken):
        if room >= weight and better[room - weight]:
            used[s], room = used.get(s, 0) + copies, room - weight
    return used, len(taken)


def _dive(counts: np.ndarray, limit: int, power: float, effort: int) -> tuple[list[Step] | None, int]:
    """One plan from top to bottom, or None if the effort does not suffice; the effort left."""
    value, left, plan = np.arange(limit + 1, dtype=float) ** power, counts.copy(), []
    while left.any() and effort > 0:
        largest = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[largest] -= 1
        used, tried = completion(rest, limit - largest, value)
        used[largest] = used.get(largest, 0) + 1
        effort -= tried + 1
        plan.append(_apply(left, used))
    return (None if left.any() else plan), effort


def sequences_of(plan: list[Step]) -> int:
    return sum(n for _, n in plan)


def restarts(counts: np.ndarray, limit: int, best: list[Step], bound: int, effort: int) -> list[Step]:
    """The best plan of the restarts and ``best``."""
    score, at = sequences_of(best), None
    for powers in ([1.05, 1.25, 1.5, 1.75, 2.0, 2.25, 2.5, 3.0, 4.0], [0.15, -0.15, 0.1, -0.1, 0.05, -0.05, 0.025, -0.025]):
        middle = at
        for power in powers:
            if score <= bound or effort <= 0 or (power < 1 and middle is None):
                return best
            plan, effort = _dive(counts, limit, power if power > 1 else middle + power, effort)
            if plan is not None and sequences_of(plan) < score:
                best, score, at = plan, sequences_of(plan), power if power > 1 else middle + power
    return best


def plan_sequences(counts: np.ndarray, limit: int, nodes: int = 4_000, effort: int = 1_000_000) -> list[Step]:
    """The best plan found.

    Surely optimal when it has as many sequences as ``root_bound``, or when the
    second pass ran out within ``nodes`` and no list of fillings was cut.
    """
    bound = root_bound(counts, limit)
    best = best_fit(counts, limit)
    if sequences_of(best) > bound:
        best = restarts(counts, limit, best, bound, effort)
    for mixed in (False, True):
        best = _branch(counts, limit, best, bound, nodes, mixed)
    return best


def _branch(counts: np.ndarray, limit: int, best: list[Step], bound: int, nodes: int, mixed: bool) -> list[Step]:
    """One pass of branch and bound; ``mixed`` branches on how often a filling is used."""
    size = np.arange(limit + 1)
    total, score = int((counts * size).sum()), sequences_of(best)

    def steps(left: np.ndarray, sequences: int) -> Iterator[tuple[np.ndarray, Step]]:
        largest = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[largest] -= 1
        wasted = sequences * limit - (total - int((left * size).sum()))
        allowed = (score - 1) * limit - total - wasted
        for used in fillings(rest, limit - largest, allowed):
            after = left.copy()
            used, times = _apply(after, used | {largest: used.get(largest, 0) + 1})
            yield after, (used, times)
            for fewer in range(times - 1, 0, -1) if mixed else ():
                after = after.copy()
                for s, n in used.items():
                    after[s] += n
                yield after, (used, fewer)

    path: list[Step] = []
    open_at = [steps(counts, 0)] if counts.any() else []
    sequences = 0
    while open_at and score > bound and nodes > 0:
        found = next(open_at[-1], None)
        if found is None:
            open_at.pop()
            if path:
                sequences -= path.pop()[1]
            continue
        nodes -= 1
        left, step = found
        if sequences + step[1] + lower_bound(left, limit) >= score:
            continue
        path.append(step)
        sequences += step[1]
        if left.any():
            open_at.append(steps(left, sequences))
        else:
            best, score = list(path), sequences
            sequences -= path.pop()[1]
    return best


@dataclass(frozen=True)
class Segments:
    """The plan as arrays, sorted by length and first ordinal."""

    size: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    copies: np.ndarray

    def place(self, size: np.ndarray, ordinal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = np.int64(1) << np.int64(48)
        at = np.searchsorted(self.size * wide + self.first, size * wide + ordinal, "right") - 1
        turn, copy = np.divmod(ordinal - self.first[at], self.copies[at])
        return self.sequence[at] + turn, self.offset[at] + copy * size


def segments(plan: list[Step]) -> Segments:
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for used, times in plan:
        offset = 0
        for s, n in sorted(used.items(), reverse=True):
            rows.append((s, given.get(s, 0), sequence, offset, n))
            given[s] = given.get(s, 0) + n * times
            offset += n * s
        sequence += times
    rows.sort()
    return Segments(*np.array(rows, np.int64).reshape(-1, 5).T)


_PIECES = "id long, piece int, start long, length int, ids_crc32 long, src long, ordinal long"


def token_pieces(docs: DataFrame, tokenizer_file: str, limit: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece; ``ordinal`` numbers pieces of one length within one task (``src``)."""
    shared = docs.sparkSession.sparkContext.broadcast(open(tokenizer_file, "rb").read())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.loaded(tokens.ByteBpe, shared.value)
        src, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in slices(batches, 1):
            rows: list[tuple] = []
            for i, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist())):
                ids += end
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    size = limit if at or n % limit == 0 else n % limit
                    rows.append((i, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), src, int(seen[size])))
                    seen[size] += 1
                    at, piece = at + size, piece + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["id", "piece", "start", "length", "ids_crc32", "src", "ordinal"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return narrow(docs, id_col, text_col).mapInArrow(run, _PIECES)


def pack(
    docs: DataFrame, tokenizer_file: str, limit: int = 2048, end_id: int = 0, id_col: str = "doc_id",
    text_col: str = "text", nodes: int = 4_000, effort: int = 1_000_000,
) -> DataFrame:
    """One row per piece: ``id, piece, start, length, ids_crc32, sequence_id, offset``."""
    pieces = materialize(token_pieces(docs, tokenizer_file, limit, end_id, id_col, text_col), "pieces")
    groups = materialize(pieces.groupBy("length", "src").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = np.zeros(limit + 1, np.int64)
    for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``limit`` rows
        counts[r.length] = r.n
    plan = segments(plan_sequences(counts, limit, nodes, effort))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("src").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = pieces.join(groups.select("length", "src", before.alias("before")), ["length", "src"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(3).to_numpy().astype(np.int64)
            sequence, offset = plan.place(size, batch.column(5).to_numpy()) if batch.num_rows else (size, size)
            columns = [*batch.columns[:3], pa.array(size), batch.column(4), pa.array(sequence), pa.array(offset)]
            names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    ordered = numbered.select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("ordinal")).alias("ordinal"))
    return ordered.mapInArrow(
        place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
