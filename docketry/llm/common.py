"""Helpers shared by the operators: names, batches, broadcasts, scratch folders."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.session import prepare_session, shared_dir
from docketry.shipping import ship_with_tasks

ship_with_tasks(__name__)

SLICE_BYTES = 2 << 20
BATCH_BYTES = 4 << 20
BROADCAST_BYTES = 32 << 20
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def prepare(spark: SparkSession) -> SparkSession:
    """Session options of the library; batches sent to Python are bounded in bytes, not only in rows."""
    prepare_session(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def fresh(taken: list[str], stem: str) -> str:
    """A column name that no column in ``taken`` has, whatever its case."""
    low = {c.lower() for c in taken}
    name = f"__{stem}"
    while name.lower() in low:
        name = f"_{name}"
    return name


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id (long) and the text, under the operators' own names; null text is empty."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder of the session."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: files replace the plan."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the counted rows fit ``limit``; otherwise leave the join to shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only, on the JVM."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def worker_cache(name: str, build):
    """The object that the tasks of one stage share in a Python worker; the next stage's takes its place."""
    store = sys.__dict__.setdefault("_docketry_llm", {})
    if name not in store:
        store.clear()
        store[name] = build()
    return store[name]


class Memo(dict):
    """Results by text, bounded in bytes.

    ``begin`` is called before the texts of a piece are learnt: it forgets the
    long texts of the piece before, and everything once the rest weighs more than
    ``limit``. So between pieces a memo holds ``limit`` bytes at most, whatever
    the texts are like.
    """

    LONGEST = 64  # characters of a text that is kept from piece to piece
    ENTRY = 160  # bytes of an entry beside its characters, about

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.weight, self.passing = limit, 0, []

    def begin(self) -> None:
        for text in self.passing:
            del self[text]
        self.passing.clear()
        if self.weight > self.limit:
            self.clear()
            self.weight = 0

    def learn(self, text: str, result) -> None:
        """``text`` is not known yet."""
        self[text] = result
        if len(text) > self.LONGEST:
            self.passing.append(text)
        else:
            self.weight += self.ENTRY + 4 * len(text)


def _give_back_memory(first: bool) -> None:
    """Freed arrays return to the system, since a worker lives on beside its JVM between stages."""
    try:
        libc = ctypes.CDLL(None)
        if first:
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, fixed
            libc.mallopt(-8, 2)  # M_ARENA_MAX
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library
    if first:
        pa.set_memory_pool(pa.system_memory_pool())


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one piece hold about ``limit`` bytes (one text at least)."""
    _give_back_memory(True)
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            stop = max(int(np.searchsorted(size, base + limit, "right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop
    _give_back_memory(False)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a bijection of 64-bit integers."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse, 0 to n."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Roller:
    """Hashes of all windows of n values, as differences of prefix sums modulo 2**64."""

    def __init__(self, base: int = 0xD1342543DE82EF95):
        self.base, self.powers, self.inverse = base, *odd_powers(base, 1024)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        if len(values) + 1 > len(self.powers):
            self.powers, self.inverse = odd_powers(self.base, 2 * len(values))
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers[: len(values)], out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, n: int) -> np.ndarray:
        """One hash for each start; empty when there are fewer than n values."""
        count = len(prefix) - n
        if count <= 0:
            return np.zeros(0, np.uint64)
        return mix((prefix[n:] - prefix[:count]) * self.inverse[:count])


class Words:
    """The words of a column of texts, laid end to end.

    ``codes`` numbers the distinct words of this piece, ``doc`` is the row of
    each word, ``distinct`` the distinct words.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        full = pc.greater(pc.binary_length(flat), 0)
        flat = flat.filter(full)
        self.doc = doc[full.to_numpy(zero_copy_only=False)].astype(np.int64)
        coded = pc.dictionary_encode(flat)
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct = coded.dictionary
        self.rows = len(texts)
        self.per_doc = np.bincount(self.doc, minlength=self.rows).astype(np.int64)

    def sum_by_doc(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=values, minlength=self.rows).astype(np.int64)
