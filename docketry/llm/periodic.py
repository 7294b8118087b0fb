"""Periodic runs: stretches of words that repeat with a period, found from suffix classes.

A run is a stretch with smallest period q (words q apart are identical), at least
``min_length`` words and ``min_exponent`` periods long, that no neighbouring word
extends. The suffixes of a text form classes: at level l, those that share their
first l words. Going down from the largest common prefix, neighbours in suffix
order are united (union-find); each class keeps its positions in order, the
smaller class is put into the larger, and two positions that become neighbours
at a distance d of at most the level l are the seed of a run with period d that
ends d + l words after the first of them. The first position of a run and the one
a period later always become neighbours so, and no position lies between them,
hence the seeds with the least position of each (period, end) are the runs, with
their smallest periods.

A run's first position shares at least ``floor`` words with the one a period
later, so classes below that level are not built: only texts in which some window
of that many words occurs twice have any work, which rolling hashes tell
beforehand (equal windows have equal hashes, so none is missed). The classes
themselves are exact, from prefix doubling over word numbers.

Texts are independent, so there is no shuffle. A task holds a piece of about 2 MB
of texts, or one longer text, and some 40 bytes a word of it for each doubling.

Defined results: null and empty texts have no words and no runs; repeated rows
and null ids are handled row by row; an empty table gives an empty result; other
columns are not read, so their names are free.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.common import Roller, Words, mix, narrow, slices, worker_cache
from docketry.shipping import ship_with_tasks

ship_with_tasks(__name__)


@dataclass(frozen=True)
class Runs:
    """What counts as a run."""

    min_length: int = 24
    min_exponent: int = 3

    def __post_init__(self) -> None:
        if self.min_length < 1 or self.min_exponent < 2:
            raise ValueError("a run has at least one word and two periods")

    @property
    def floor(self) -> int:
        """Words that a run's first position has in common with the one a period later, at least."""
        longest = self.min_length // self.min_exponent  # periods up to here are bound by min_length
        return max(1, min(self.min_length - longest, (self.min_exponent - 1) * (longest + 1)))


def _suffix_order(codes: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in suffix order with at least ``floor`` words in common: both positions, and how many words.

    ``codes`` ends every text with a number of its own, so no class crosses texts.
    """
    n = len(codes)
    ranks, step = [np.unique(codes, return_inverse=True)[1].astype(np.int64)], 1
    while True:
        last = ranks[-1]
        key = last * (n + 1)
        key[: n - step] += last[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            break
        ranks.append(rank)
        step *= 2
    first, second = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        a, b = first + common, second + common
        inside = (a < n) & (b < n)
        same = inside.copy()
        same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        common[same] += 1 << k
    keep = common >= floor
    return first[keep], second[keep], common[keep]


def _seeds(first: np.ndarray, second: np.ndarray, common: np.ndarray) -> dict[tuple[int, int], int]:
    """Kruskal by decreasing common prefix: (end, period) of each seed, to its least position."""
    places = np.unique(np.concatenate((first, second)))
    order = np.argsort(-common, kind="stable")
    a = np.searchsorted(places, first[order]).tolist()
    b = np.searchsorted(places, second[order]).tolist()
    parent = list(range(len(places)))
    sets: list = [[p] for p in places.tolist()]
    found: dict[tuple[int, int], int] = {}
    for x, y, level in zip(a, b, common[order].tolist()):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if len(sets[x]) < len(sets[y]):
            x, y = y, x
        large, small = sets[x], sets[y]
        parent[y], sets[y] = x, None
        before = -1  # the place before, if it came from the small class, is no new neighbour
        for t, p in enumerate(small):
            at = bisect_left(large, p)
            if at and (q := large[at - 1]) != before and p - q <= level:
                key = (p + level, p - q)
                if found.get(key, q) >= q:
                    found[key] = q
            if at < len(large) and (q := large[at]) - p <= level and (t + 1 == len(small) or small[t + 1] > q):
                key = (q + level, q - p)
                if found.get(key, p) >= p:
                    found[key] = p
            large.insert(at, p)
            before = p
    return found


def find_in_codes(codes: np.ndarray, spec: Runs) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of words given as numbers, texts ended by numbers that occur once."""
    if len(codes) < 2:
        return []
    found = _seeds(*_suffix_order(codes, spec.floor))
    runs = [(start, end - start, period) for (end, period), start in found.items()]
    return sorted(
        ((s, n, q) for s, n, q in runs if n >= max(spec.min_length, spec.min_exponent * q)), key=lambda r: (r[0], r[2])
    )


class Piece:
    """The words of some texts and the runs of each text that has any (word numbers from 0)."""

    def __init__(self, texts: pa.Array, spec: Runs):
        self.words = words = Words(texts)
        self.begins = np.concatenate(([0], np.cumsum(words.per_doc)))
        self.runs: dict[int, list[tuple[int, int, int]]] = {}
        likely = self._likely(spec.floor)
        if not len(likely):
            return
        # the likely texts end to end, each followed by a number of its own
        parts, begins, at = [], [], 0
        for number, d in enumerate(likely.tolist()):
            codes = words.codes[self.begins[d] : self.begins[d + 1]]
            parts += [codes, np.array([-1 - number])]
            begins.append(at)
            at += len(codes) + 1
        runs = find_in_codes(np.concatenate(parts), spec)
        owner = np.searchsorted(begins, [r[0] for r in runs], "right") - 1
        for (start, length, period), k in zip(runs, owner.tolist()):
            self.runs.setdefault(int(likely[k]), []).append((start - begins[k], length, period))

    def _likely(self, n: int) -> np.ndarray:
        """Rows in which some window of n words may occur twice."""
        words, total = self.words, len(self.words.doc)
        if total < n:
            return np.zeros(0, np.int64)
        roller = worker_cache("periodic-roller", Roller)
        inside = words.doc[: total - n + 1] == words.doc[n - 1 :]
        keys = roller.windows(roller.prefix(mix(words.codes)), n) ^ mix(words.doc[: total - n + 1])
        doc, keys = words.doc[: total - n + 1][inside], keys[inside]
        order = np.argsort(keys)
        twice = keys[order][1:] == keys[order][:-1]
        return np.unique(doc[order[1:][twice]])

    def dropped(self, row: int) -> np.ndarray:
        """Which words of a text lie in a run after its first period."""
        n = int(self.words.per_doc[row])
        edge = np.zeros(n + 1, np.int64)
        for start, length, period in self.runs.get(row, ()):
            edge[start + period] += 1
            edge[start + length] -= 1
        return np.cumsum(edge[:-1]) > 0

    def collapsed(self, row: int) -> str:
        kept = self.words.codes[self.begins[row] : self.begins[row + 1]][~self.dropped(row)]
        return " ".join(self.words.distinct.take(pa.array(kept)).to_pylist())


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the greatest length / period; ties: smallest start, then smallest period.

    Lengths and periods stay below 2**31, so quotients that differ, differ by more than 2**-62.
    """
    return min(runs, key=lambda r: (-((r[1] << 64) // r[2]), r[0], r[2]))


def _joined(texts: pa.Array) -> list[bytes]:
    """The words of every text joined by one space."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    return pc.binary_join(lists, " ").cast(pa.binary()).to_pylist()


_MEASURES = pa.schema(
    [("id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
     ("exponent_milli", pa.int64()), ("runs_sha", pa.binary()), ("collapsed_sha", pa.binary())]
)


def measure_runs(docs: DataFrame, spec: Runs = Runs(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: number of runs, the strongest one, digests of all runs and of the collapsed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = batch.column(1).cast(pa.string())
            piece = Piece(texts, spec)
            rows = []
            for row, (i, whole) in enumerate(zip(batch.column(0).to_pylist(), _joined(texts))):
                runs = piece.runs.get(row)
                best = (None,) * 4
                listed = b""
                if runs:
                    start, length, period = strongest(runs)
                    best = (start, length, period, 1000 * length // period)
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
                    whole = piece.collapsed(row).encode()
                rows.append((i, len(runs or ()), *best, hashlib.sha256(listed).digest(), hashlib.sha256(whole).digest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _MEASURES)], schema=_MEASURES)

    return narrow(docs, id_col, text_col).mapInArrow(
        run,
        "id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha binary, collapsed_sha binary",
    )


def find_runs(docs: DataFrame, spec: Runs = Runs(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per run: ``id, start, length, period``; documents without runs have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            piece = Piece(batch.column(1).cast(pa.string()), spec)
            ids = batch.column(0).to_pylist()
            rows = [(ids[row], *r) for row, runs in sorted(piece.runs.items()) for r in runs]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "start", "length", "period"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "id long, start long, length long, period long")


def collapse_runs(docs: DataFrame, spec: Runs = Runs(), text_col: str = "text") -> DataFrame:
    """The rows of the input; of a text with runs only the first period of each stays, words joined by one space."""
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            piece = Piece(batch.column(1).cast(pa.string()), spec)
            new = [piece.collapsed(row) if row in piece.runs else None for row in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["row", "cut"])

    out = held.mapInArrow(run, T.StructType([held.schema["row"], T.StructField("cut", T.StringType())]))
    text = F.coalesce("cut", F.col("row").getField(text_col)).alias(text_col)
    return out.select(*[text if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
