"""Repeated passages: a count-min prefilter, then exact grouping of what it lets through.

A window is ``window`` consecutive words. The sketch counts, for every window,
its anchor: the leftmost smallest hash among its shorter word n-grams. Windows
of equal words have equal anchors at different places, so an anchor occurs at
least as often as its window; with the sketch's own collisions the estimate only
grows. Neighbouring windows share an anchor, so there are about a tenth as many
anchors as windows and the sketch may be small. It has a fixed size whatever the
input, and is the only thing broadcast.

1. Each task sketches its anchors; sketches are merged block by block, in a tree
   of bounded fan-in.
2. A second scan hashes (96 bits) only windows whose anchor is estimated twice or
   more. What repeats within a piece of a task is known there and sent once; the
   rest goes to owners of hash ranges, which answer with bitmaps. On a full
   sketch more windows are sent, but none is lost.
3. Spans of removed words are kept by the digest of the whole text and joined to
   the documents.

Defined results: null has no words; texts shorter than a window keep all words;
windows are judged on the input; copies of a text lose all words that a window
covers; rows with null or repeated ids are treated like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm import golomb
from docketry.llm.common import BROADCAST_BYTES, Roller, Words, materialize, mix, narrow, slices, width, worker_cache
from docketry.llm.exact import owner_of
from docketry.shipping import ship_with_tasks

ship_with_tasks(__name__)

OWNED = 4_000_000  # windows one owner holds at most, if all words pass the sketch
PIECE = 400_000  # windows or anchors after which a task sends what it holds
FAN_IN = 64
BLOCK_BITS = 20


@dataclass(frozen=True)
class Windows:
    """Window length in words, and the size of the sketch: ``rows`` times 2**``bits`` counters."""

    words: int = 35
    bits: int = 26
    rows: int = 2

    @property
    def gram(self) -> int:
        return max(1, self.words // 3)


class Hashed:
    """Word hashes of a piece, the starts of its windows, and the place of each window's anchor."""

    def __init__(self, texts: pa.Array, spec: Windows):
        self.spec, self.words = spec, Words(texts)
        distinct = self.words.distinct.cast(pa.binary()).to_pylist()
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct)), np.uint64).reshape(-1, 2)
        self.hashes = digests[self.words.codes]
        self.rollers = worker_cache("substring-rollers", lambda: (Roller(), Roller(0x9FB21C651E98DF25)))
        n, doc = spec.words, self.words.doc
        last = len(doc) - n + 1
        self.starts = np.flatnonzero(doc[:last] == doc[n - 1 :]) if last > 0 else np.zeros(0, np.int64)
        self.prefix = self.rollers[0].prefix(self.hashes[:, 0])
        self.grams = self.rollers[0].windows(self.prefix, spec.gram)
        self.anchors = _leftmost_least(self.grams, n - spec.gram + 1)[self.starts]

    def keys(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.spec.words
        second = self.rollers[1].windows(self.rollers[1].prefix(self.hashes[:, 1]), n)
        first = self.rollers[0].windows(self.prefix, n)
        return first[starts], (second[starts] >> np.uint64(32)).astype(np.uint32)


def _leftmost_least(values: np.ndarray, n: int) -> np.ndarray:
    """For each start, the place of the least of ``n`` values, the leftmost among equals."""
    if len(values) < n:
        return np.zeros(0, np.int64)
    at, reach = np.arange(len(values)), 1
    while reach < n:
        step = min(reach, n - reach)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        reach += step
    return at


def _cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(anchors + np.uint64(0xA24BAED4963EE407 * (row + 1) & (1 << 64) - 1)) >> np.uint64(64 - bits)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_SKETCH = pa.schema(
    [("row", pa.int32()), ("block", pa.int32()), ("src", pa.int64()), ("n", pa.int64()), ("codes", pa.binary()), ("twice", pa.binary())]
)
_SKETCH_DDL = "row int, block int, src long, n long, codes binary, twice binary"


def _block_rows(row: int, src: int, cells: np.ndarray, twice: np.ndarray) -> list[tuple]:
    """Messages of one sketch row: the counters that are not zero, block by block."""
    block = (cells >> np.uint64(BLOCK_BITS)).astype(np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(cells)]))
    low = cells & np.uint64((1 << BLOCK_BITS) - 1)
    return [
        (row, int(block[a]), src, int(b - a), golomb.encode(low[a:b]), golomb.pack_flags(twice[a:b]))
        for a, b in zip(cuts[:-1], cuts[1:])
        if b > a
    ]


def _sketching(spec: Windows):
    def sketch(src: int, held: list[np.ndarray], words: int) -> pa.RecordBatch:
        anchors, rows = np.concatenate(held), [(-1, 0, src, words, None, None)]
        for row in range(spec.rows):
            cells, counts = np.unique(_cells(anchors, row, spec.bits), return_counts=True)
            rows += _block_rows(row, src, cells, counts > 1)
        return _table(rows, _SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, held, size, words = TaskContext.get().partitionId(), [], 0, 0
        for batch in slices(batches, 0):
            piece = Hashed(batch.column(0).cast(pa.string()), spec)
            words += len(piece.words.doc)
            if len(piece.anchors):
                own = piece.anchors[np.concatenate(([True], piece.anchors[1:] != piece.anchors[:-1]))]
                held.append(piece.grams[own])
                size += len(own)
            if size >= PIECE:
                yield sketch(src, held, words)
                held, size, words = [], 0, 0
        if words:
            yield sketch(src, held or [np.zeros(0, np.uint64)], words)

    return run


def _merge(messages: pa.Table) -> pa.Table:
    """Messages of one block to one message: counters saturate at two."""
    once, twice = np.zeros(1 << BLOCK_BITS, bool), np.zeros(1 << BLOCK_BITS, bool)
    rows = messages.to_pylist()
    for r in rows:
        cells = golomb.decode(r["codes"], r["n"]).astype(np.int64)
        twice[cells] |= golomb.unpack_flags(r["twice"], r["n"]) | once[cells]
        once[cells] = True
    cells = np.flatnonzero(once)
    out = _block_rows(rows[0]["row"], rows[0]["src"] // FAN_IN, cells.astype(np.uint64), twice[cells])
    fixed = [(row, rows[0]["block"], src, n, codes, flags) for row, _, src, n, codes, flags in out]
    return pa.Table.from_batches([_table(fixed, _SKETCH)])


def merged_sketch(texts: DataFrame, spec: Windows) -> tuple[dict[int, np.ndarray], int]:
    """Of each sketch row a bitmap of the counters at two or more (packed), and the number of words."""
    sent = materialize(texts.select("text").mapInArrow(_sketching(spec), _SKETCH_DDL), "sketches")
    total, sources = sent.where("row < 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("src"), F.lit(0))).first()
    blocks = sent.where("row >= 0")
    while True:
        blocks = blocks.groupBy("row", "block", F.floor(F.col("src") / FAN_IN).alias("to")).applyInArrow(_merge, _SKETCH_DDL)
        sources //= FAN_IN
        if not sources:
            break
        blocks = materialize(blocks, "sketches")
    size = max(1 << max(0, spec.bits - BLOCK_BITS), 1)
    found = {row: np.zeros((size, 1 << (BLOCK_BITS - 3)), np.uint8) for row in range(spec.rows)}
    for r in blocks.select("row", "block", "n", "codes", "twice").toLocalIterator():  # a fixed number of blocks
        flags = np.zeros(1 << BLOCK_BITS, bool)
        flags[golomb.decode(bytes(r.codes), r.n).astype(np.int64)] = golomb.unpack_flags(bytes(r.twice), r.n)
        found[r.row][r.block] = np.packbits(flags)
    return {row: f.ravel() for row, f in found.items()}, int(total)


_SENT = pa.schema(
    [("src", pa.int64()), ("owner", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("at", pa.binary()), ("known", pa.binary()), ("docs", pa.binary())]
)
_SENT_DDL = "src long, owner int, n long, keys binary, at binary, known binary, docs binary"


def _known_here(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys repeat among these, and one key of each kind."""
    order = np.argsort(first)
    a, b = first[order], second[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1
    repeats, chosen = np.zeros(len(first), bool), np.zeros(len(first), bool)
    repeats[order] = many
    chosen[order[new]] = True
    return repeats, chosen


def _sending(spec: Windows, sketch, owners: int):
    def messages(src: int, pieces: list[tuple]) -> pa.RecordBatch:
        first, second, at = (np.concatenate([p[i] for p in pieces]) for i in range(3))
        docs = b"".join(p[3] for p in pieces)
        if not len(first):
            return _table([], _SENT)
        repeats, chosen = _known_here(first, second)
        rows = [(src, -1, len(at), None, golomb.encode(at), golomb.pack_flags(repeats), docs)]
        number = np.flatnonzero(chosen)
        owner = owner_of(first[number], owners, 64)
        order = np.argsort(owner, kind="stable")
        number, owner = number[order], owner[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = number[a:b]
            keys = first[own].tobytes() + second[own].tobytes()
            rows.append((src, int(owner[a]), len(own), keys, golomb.encode(own), golomb.pack_flags(repeats[own]), None))
        return _table(rows, _SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = sketch.value
        src, pieces, size, offset = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in slices(batches, 0):
            texts = batch.column(0).cast(pa.string())
            piece = Hashed(texts, spec)
            if len(piece.starts):
                grams = piece.grams[piece.anchors]
                through = np.ones(len(grams), bool)
                for row, bitmap in bitmaps.items():
                    cell = _cells(grams, row, spec.bits)
                    through &= (bitmap[cell >> np.uint64(3)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1 == 1
                starts = piece.starts[through]
                held = np.unique(piece.words.doc[starts])
                ends = np.cumsum(piece.words.per_doc)
                raw = texts.cast(pa.binary())
                docs = b"".join(
                    hashlib.sha256(raw[int(d)].as_py()).digest()
                    + int(offset + ends[d] - piece.words.per_doc[d]).to_bytes(8, "little")
                    for d in held
                )
                pieces.append((*piece.keys(starts), starts + offset, docs))
                size += len(starts)
                offset += len(piece.words.doc)
            if size >= PIECE:
                yield messages(src, pieces)
                src, pieces, size, offset = src + 1, [], 0, 0
        if pieces:
            yield messages(src, pieces)

    return run


def _answer(messages: pa.Table) -> pa.Table:
    """At one owner: which of the windows in each message occur more than once."""
    rows = messages.select(["n", "keys", "known"]).to_pylist()
    first = np.concatenate([np.frombuffer(r["keys"], np.uint64, r["n"]) for r in rows])
    second = np.concatenate([np.frombuffer(r["keys"], np.uint32, r["n"], 8 * r["n"]) for r in rows])
    known = np.concatenate([golomb.unpack_flags(r["known"], r["n"]) for r in rows])
    repeats, _ = _known_here(first, second)
    marks = np.split(repeats | known, np.cumsum([r["n"] for r in rows])[:-1])
    return messages.select(["src", "owner"]).append_column("marks", pa.array([golomb.pack_flags(m) for m in marks], pa.binary()))


_SPANS = pa.schema([("sha", pa.binary()), ("spans", pa.binary())])


def _resolving(words: int):
    def run(piece: pa.Table) -> pa.Table:
        rows = piece.to_pylist()
        base = next(r for r in rows if r["owner"] < 0)
        at = golomb.decode(base["at"], base["n"]).astype(np.int64)
        flags = golomb.unpack_flags(base["known"], base["n"])
        for r in rows:
            if r["owner"] >= 0:
                own = golomb.decode(r["at"], r["n"]).astype(np.int64)
                flags[own[golomb.unpack_flags(r["marks"], r["n"])]] = True
        starts = at[flags]
        docs = np.frombuffer(base["docs"], np.uint8).reshape(-1, 40)
        begins = docs[:, 32:].copy().view(np.int64).ravel()
        # a window ends where its document does at the latest, so spans of two documents only touch
        doc = np.searchsorted(begins, starts, "right") - 1
        new = np.ones(len(starts), bool)
        new[1:] = (starts[1:] > starts[:-1] + words) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(starts)])) - 1
        owner = doc[first] if len(first) else np.zeros(0, np.int64)
        spans = np.stack((starts[first] - begins[owner], starts[last] + words - begins[owner]), axis=1) if len(first) else np.zeros((0, 2))
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)])) if len(owner) else [0]
        out = [(docs[owner[a], :32].tobytes(), spans[a:b].astype(np.int64).tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.Table.from_batches([_table(out, _SPANS)])

    return run


def repeated_spans(texts: DataFrame, spec: Windows) -> DataFrame:
    """Column ``text`` to ``sha, spans``: for each distinct text with repeated windows, the word spans they cover."""
    spark = texts.sparkSession
    bitmaps, total = merged_sketch(texts, spec)
    sketch = spark.sparkContext.broadcast(bitmaps)  # rows * 2**bits / 8 bytes, whatever the input
    owners = max(width(spark), -(-total // OWNED))
    sent = materialize(texts.select("text").mapInArrow(_sending(spec, sketch, owners), _SENT_DDL), "windows")
    sketch.unpersist()
    answers = (
        sent.where("owner >= 0").select("src", "owner", "n", "keys", "known")
        .groupBy("owner").applyInArrow(_answer, "src long, owner int, marks binary")
    )
    back = sent.drop("keys").join(answers, ["src", "owner"], "left")
    spans = back.groupBy("src").applyInArrow(_resolving(spec.words), "sha binary, spans binary")
    return materialize(spans.dropDuplicates(["sha"]), "spans")


def _kept_words(text: bytes, spans: bytes | None) -> tuple[int, list[bytes]]:
    words = text.split()
    n = len(words)
    for a, b in np.frombuffer(spans or b"", np.int64).reshape(-1, 2)[::-1].tolist():
        del words[a:b]
    return n, words


def _with_spans(rows: DataFrame, spec: Windows) -> DataFrame:
    spans = repeated_spans(rows, spec).withColumnRenamed("sha", "span_sha")
    sha = F.unhex(F.sha2(F.col("text"), 256))
    weight = spans.agg(F.sum(F.octet_length("spans") + 96)).first()[0] or 0  # spans have no bound of their own
    return rows.join(F.broadcast(spans) if weight <= BROADCAST_BYTES else spans, sha == F.col("span_sha"), "left").drop("span_sha")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        rows = []
        for i, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
            n, words = _kept_words(text, spans)
            rows.append((i, n, n - len(words), hashlib.sha256(b" ".join(words)).digest()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
            names=["id", "n_words", "n_removed", "kept_sha"],
        )


def measure_repeats(
    docs: DataFrame, spec: Windows | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``id, n_words, n_removed, kept_sha``."""
    joined = _with_spans(narrow(docs, id_col, text_col), spec or Windows())
    return joined.select("id", "text", "spans").mapInArrow(_cut, "id long, n_words long, n_removed long, kept_sha binary")


def remove_repeats(docs: DataFrame, spec: Windows | None = None, text_col: str = "text") -> DataFrame:
    """The rows of the input; a text with repeated windows becomes its kept words joined by one space."""
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    joined = _with_spans(held, spec or Windows())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            spans = batch.column(2).to_pylist()
            new = [
                b" ".join(_kept_words(text, s)[1]).decode() if s else None
                for text, s in zip(batch.column(1).cast(pa.binary()).to_pylist(), spans)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["row", "cut"])

    schema = T.StructType([joined.schema["row"], T.StructField("cut", T.StringType())])
    out = joined.select("row", "text", "spans").mapInArrow(cut, schema)
    text = F.coalesce("cut", F.col("row").getField(text_col)).alias(text_col)
    return out.select(*[text if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
