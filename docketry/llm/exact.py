"""Exact duplicates: Golomb-coded fingerprint exchange, then verification on bytes.

1. One scan digests every text; the digests (not the texts) are written to the
   shared folder.
2. Each task sorts the fingerprints it holds and sends each owner of a
   fingerprint range one compressed message. The owner answers with a bitmap:
   which fingerprints of this message occur more than once anywhere.
3. The sender decodes its own message beside the bitmap; what is marked is a
   suspect. Only texts of suspects are shuffled, grouped by their bytes.

Fingerprints are a few bits longer than the row count needs, so few rows are
suspects by chance; those fall away in step 3. A hot text is counted before the
shuffle in step 3, and a message holds a hot fingerprint once.

Defined results: null and empty texts are equal; a null id ranks below all
others; of rows equal in text and id exactly one is kept; an empty table gives
an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm import golomb
from docketry.llm.common import ascii_lower, broadcast_if_small, fresh, materialize, narrow, slices, width
from docketry.shipping import ship_with_tasks

ship_with_tasks(__name__)

OWNED = 2_000_000  # fingerprints one owner decodes
MESSAGE_ROWS = 1_000_000
SPARE_BITS = 10


def normalized(text: Column) -> Column:
    """What is compared: A-Z in lower case, null as empty."""
    return ascii_lower(F.coalesce(text.cast("string"), F.lit("")))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        low = pc.ascii_lower(batch.column(1).cast(pa.string()))
        at = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1]
        data = memoryview(low.buffers()[2] or b"")
        out = [hashlib.sha256(data[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        head = np.frombuffer(b"".join(out), ">i8").reshape(-1, 4)[:, 0].astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out, pa.binary()), pa.array(head)], names=["id", "sha", "head"]
        )


def _send(owners: int, bits: int):
    def messages(src: int, heads: list[np.ndarray]) -> pa.RecordBatch:
        values = np.concatenate(heads).view(np.uint64) >> np.uint64(64 - bits)
        values, counts = np.unique(values, return_counts=True)
        owner = owner_of(values, owners, bits)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1, [len(values)]))
        rows = [
            (src, int(owner[a]), int(b - a), golomb.encode(values[a:b]), golomb.pack_flags(counts[a:b] > 1))
            for a, b in zip(cuts[:-1], cuts[1:])
        ]
        names = ["src", "owner", "n", "codes", "twice"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy(zero_copy_only=False))
                size += batch.num_rows
            if size >= MESSAGE_ROWS:
                yield messages(src, held)
                src, held, size = src + 1, [], 0
        if held:
            yield messages(src, held)

    return run


def owner_of(values: np.ndarray, owners: int, bits: int) -> np.ndarray:
    """Owners hold ranges of equal length; the top 32 bits decide."""
    top = values >> np.uint64(max(0, bits - 32))
    return ((top * np.uint64(owners)) >> np.uint64(min(bits, 32))).astype(np.int32)


def _answer(messages: pa.Table) -> pa.Table:
    """At one owner: a bitmap for each message."""
    rows = messages.select(["n", "codes", "twice"]).to_pylist()
    values = [golomb.decode(r["codes"], r["n"]) for r in rows]
    known = [golomb.unpack_flags(r["twice"], r["n"]) for r in rows]
    flat, flags = np.concatenate(values), np.concatenate(known)
    distinct, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    many = counts > 1
    many[inverse[flags]] = True
    marks = np.split(many[inverse], np.cumsum([r["n"] for r in rows])[:-1])
    return messages.select(["src", "owner"]).append_column(
        "marks", pa.array([golomb.pack_flags(m) for m in marks], pa.binary())
    )


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.zeros(0, np.uint64)]
        for r in batch.to_pylist():
            found.append(golomb.decode(r["codes"], r["n"])[golomb.unpack_flags(r["marks"], r["n"])])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["mark"])


def exchange(heads: DataFrame, rows: int, bits: int) -> DataFrame:
    """Distinct fingerprints (top ``bits`` of ``head``) that occur on more than one row, as ``mark``."""
    owners = max(width(heads.sparkSession), -(-rows // OWNED))
    sent = materialize(
        heads.select("head").mapInArrow(
            _send(owners, bits), "src long, owner int, n int, codes binary, twice binary"
        ),
        "fingerprints",
    )
    answers = sent.groupBy("owner").applyInArrow(_answer, "src long, owner int, marks binary")
    back = sent.select("src", "owner", "n", "codes").join(answers, ["src", "owner"])
    return back.select("n", "codes", "marks").mapInArrow(_suspects, "mark long").distinct()


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, sha, keep_id, group_size, kept``."""
    texts = narrow(docs, id_col, text_col)
    light = materialize(
        texts.mapInArrow(_digest, "id long, sha binary, head long").withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "digests",
    )
    rows = light.count()
    bits = min(63, max(33, rows.bit_length() + SPARE_BITS))
    marks = materialize(exchange(light, rows, bits), "suspects")
    mark = F.shiftrightunsigned("head", 64 - bits)
    suspects = light.withColumn("mark", mark).join(broadcast_if_small(marks, 16), "mark", "left_semi")
    ids = materialize(suspects.select(F.col("id").alias("suspect")).distinct(), "suspect-ids")
    verified = (
        texts.join(broadcast_if_small(ids, 16), F.col("id").eqNullSafe(F.col("suspect")), "left_semi")
        .groupBy(ascii_lower(F.col("text")).alias("bytes"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.unhex(F.sha2("bytes", 256)).alias("sha"))
    )
    groups = materialize(
        suspects.groupBy("sha")  # before the join, so that a hot text is counted before it is shuffled
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "row")).alias("best"))
        .join(verified, "sha"),
        "groups",
    )
    joined = light.join(broadcast_if_small(groups, 96), "sha", "left")
    alone = F.col("n").isNull()
    return joined.select(
        "id",
        "sha",
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"),
    )


def keep_rows(
    docs: DataFrame, decided: DataFrame, digest: Column, id_col: str = "doc_id"
) -> DataFrame:
    """The rows of ``docs`` that ``decided`` (``id, digest, kept``) keeps.

    Rows go by id. An id that has kept and dropped rows is decided by
    ``digest``, of which ``decided`` keeps at most one row; such rows are few.
    """
    key, tag = fresh(docs.columns, "key"), fresh(docs.columns, "tag")
    ids = docs[f"`{id_col}`"].cast("long")
    dropped = materialize(decided.where("NOT kept").select(F.col("id").alias(key)).distinct(), "dropped")
    dropped = broadcast_if_small(dropped, 16)
    mixed = materialize(
        decided.where("kept").join(dropped, F.col("id").eqNullSafe(F.col(key)), "left_semi")
        .select(F.col("id").alias(key), F.col("digest").alias(tag)),
        "mixed",
    )
    rest = docs.join(dropped, ids.eqNullSafe(F.col(key)), "left_anti")
    some = docs.join(
        broadcast_if_small(mixed, 96), ids.eqNullSafe(F.col(key)) & (digest == F.col(tag)), "left_semi"
    )
    one = some.withColumn(key, ids).withColumn(tag, digest).dropDuplicates([key, tag]).drop(key, tag)
    return rest.unionByName(one)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with the columns of the input."""
    marked = mark_duplicates(docs, id_col, text_col)
    decided = materialize(marked.select("id", F.col("sha").alias("digest"), "kept"), "decided")
    digest = F.unhex(F.sha2(normalized(docs[f"`{text_col}`"]), 256))
    return keep_rows(docs, decided, digest, id_col)
