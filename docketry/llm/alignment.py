"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids are linked.

Both tokenizers cut one byte string; where a token of each ends, a group ends.
Most groups are one to one, so the walk keeps an index shift between the two
lists of end offsets and compares stretches of them at that shift, of doubling
length and then of halving length, which jumps over a one-to-one stretch of any
length; where the ends differ it steps to the next common one and goes on with
the shift found there. Texts are laid end to end: their ends are common, so a
piece of many texts is one walk.

Where a space stands between two characters that are no white space, both
tokenizers start a token, whatever stands around: the first because its pattern
takes the space with what follows, the second if no piece holds a mark behind
another character (the vocabulary is searched for one). So the distinct stretches
between such spaces are encoded and aligned once for about 2 MB of texts; a text
with any other space is one stretch.

An occurrence of a token of each that end together is a link. How often a pair of
ids is linked in the whole corpus comes from counts of each piece (a task's
texts of ``PIECE_BYTES`` or one longer text), added up by pair. A piece asks for its own distinct
pairs only and gets their counts back as rows of its own, so nothing is broadcast
but the highest count of every id of the second tokenizer, which its vocabulary
bounds. A frequent pair has one row for each piece, not for each occurrence.

Defined results: texts that are null or empty, or whose tokens' bytes differ from
the text for either tokenizer, have no tokens (zeros, no groups); repeated rows
and null ids are handled row by row; an empty table gives an empty result; other
columns are not read, so their names are free.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import materialize, narrow, slices
from docketry.llm.tokens import ByteBpe, loaded
from docketry.shipping import ship_with_tasks

ship_with_tasks(__name__)

PIECE_BYTES = 8 << 20
CHUNK = 2048  # texts encoded at once
# a space beside other white space, or at an end
_ODD_SPACE = re.compile(r"\s | \s|^\s|\s$|^$")


def common_ends(x: list[int], y: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the equal values of two increasing lists whose last values are equal."""
    begin_x, begin_y, length = [], [], []
    i = j = 0
    n = len(x)
    while i < n:
        begin_x.append(i)
        begin_y.append(j)
        step = 1
        while (part := x[i : i + step]) and part == y[j : j + step]:
            i += len(part)
            j += len(part)
            step *= 2
        while step > 1:
            step //= 2
            if (part := x[i : i + step]) and part == y[j : j + step]:
                i += len(part)
                j += len(part)
        length.append(i - begin_x[-1])
        if i < n:
            a, b = x[i], y[j]
            while a != b:
                if a < b:
                    i += 1
                    a = x[i]
                else:
                    j += 1
                    b = y[j]
            begin_x.append(i)
            begin_y.append(j)
            length.append(1)
            i += 1
            j += 1
    runs = np.array(length, np.int64)
    within = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    return np.repeat(np.array(begin_x, np.int64), runs) + within, np.repeat(np.array(begin_y, np.int64), runs) + within


class Aligner:
    """A byte-level BPE and a sentencepiece model over space + text."""

    def __init__(self, first: bytes, second: bytes):
        import sentencepiece

        self.coder = ByteBpe(first).coder
        self.model = sentencepiece.SentencePieceProcessor(model_proto=second)
        n = self.coder.n_vocab
        held = {self.coder.encode_single_token(b): b for b in self.coder.token_byte_values()}
        self.first = [held.get(i, b"") for i in range(n)]
        self.second = [self._piece(i) for i in range(self.model.vocab_size())]
        if not all(self.first[i] for i in held) or not all(self.second):
            raise ValueError("a token without bytes ends nowhere")
        self.sizes = [np.array([len(b) for b in t], np.int64) for t in (self.first, self.second)]
        # decimal ids with what follows them: a comma inside a group, else the mark that ends this side of it
        self.listed = [f"{i}{mark}".encode() for i in range(n) for mark in ",|"]
        self.listed += [f"{i}{mark}".encode() for i in range(len(self.second)) for mark in ",;"]
        pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces)

    def _piece(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[array], list[array]]:
        """Ids of either tokenizer over space + text; none for texts whose bytes they do not give."""
        of_first, of_second = [], []
        for k in range(0, len(texts), CHUNK):  # ids as objects for one chunk only
            chunk = texts[k : k + CHUNK]
            for t, second in zip(chunk, self.model.encode(chunk, num_threads=1)):
                raw, first = b" " + t.encode(), self.coder.encode_ordinary(" " + t)
                if b"".join(map(self.first.__getitem__, first)) != raw or b"".join(map(self.second.__getitem__, second)) != raw:
                    first = second = ()
                of_first.append(array("I", first))
                of_second.append(array("I", second))
        return of_first, of_second


class Aligned:
    """The groups of some stretches laid end to end; a stretch is ``good`` if both tokenizers give its bytes."""

    def __init__(self, aligner: Aligner, stretches: list[str]):
        self.aligner = aligner
        of_first, of_second = aligner.encode(stretches)
        self.n_first, self.n_second = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (of_first, of_second))
        self.good = self.n_first > 0
        self.ids = [np.fromiter(chain.from_iterable(ids), np.int64) for ids in (of_first, of_second)]
        ends = [np.cumsum(size[ids]).tolist() for size, ids in zip(aligner.sizes, self.ids)]
        self.last = common_ends(*ends)
        done = np.searchsorted(self.last[0], np.cumsum(self.n_first), "left")
        self.n_groups = np.diff(np.concatenate(([0], done)))

    def pairs(self) -> np.ndarray:
        """The linked ids of every group: the first tokenizer's in the upper half."""
        return self.ids[0][self.last[0]] << 32 | self.ids[1][self.last[1]]

    def lists(self) -> list[bytes]:
        """For every stretch ``a1,a2|b1;a3|b2,b3``: the ids of each group, first tokenizer's before the second's."""
        n = [len(x) for x in self.ids]
        out = np.empty(sum(n), np.int64)
        for side in (0, 1):
            ends = np.zeros(n[side], np.int64)
            ends[self.last[side]] = 1
            group = np.cumsum(ends) - ends
            # of the other side, what stands before: the groups before, and for the second side this group too
            other = np.concatenate(([0], self.last[1 - side] + 1))
            at = np.arange(n[side]) + other[group + side]
            out[at] = 2 * self.ids[side] + ends + (2 * len(self.aligner.first) if side else 0)
        cuts = np.cumsum(self.n_first + self.n_second).tolist()
        codes, listed = out.tolist(), self.aligner.listed
        return [b"".join(map(listed.__getitem__, codes[a:b]))[:-1] for a, b in zip([0, *cuts[:-1]], cuts)]


class Texts:
    """Some texts as numbers of their distinct stretches, which are aligned once."""

    def __init__(self, aligner: Aligner, texts: list[str | None]):
        number: dict[str, int] = {}
        split = [[] if not t else t.split(" ") if aligner.splits and not _ODD_SPACE.search(t) else [t] for t in texts]
        self.parts = [[number.setdefault(p, len(number)) for p in parts] for parts in split]
        self.aligned = aligned = Aligned(aligner, list(number))
        if not aligned.good.all():
            good = aligned.good.tolist()
            self.parts = [parts if all(map(good.__getitem__, parts)) else [] for parts in self.parts]
        self.sizes = np.fromiter(map(len, self.parts), np.int64, len(self.parts))
        self.flat = np.fromiter(chain.from_iterable(self.parts), np.int64, int(self.sizes.sum()))

    def sums(self, of_stretch: np.ndarray) -> np.ndarray:
        """For every text the sum of a value of its stretches."""
        return ragged_sums(of_stretch[self.flat], self.sizes)

    def lists(self) -> list[bytes]:
        listed = self.aligned.lists()
        return [b";".join(map(listed.__getitem__, parts)) for parts in self.parts]


def ragged_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``values`` of the given sizes."""
    return np.diff(np.concatenate(([0], np.cumsum(values)))[np.concatenate(([0], np.cumsum(sizes)))])


_PIECE = pa.schema(
    [("piece", pa.int64()), ("id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("groups_sha", pa.binary()),
     ("parts", pa.binary()), ("links", pa.binary()), ("pairs", pa.binary()), ("counts", pa.binary())]
)
_PIECE_DDL = "piece long, id long, n_a long, n_b long, groups_sha binary, parts binary, links binary, pairs binary, counts binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECE)], schema=_PIECE)


class _Piece:
    """What a task has read since it last sent a piece on."""

    def __init__(self, number: int):
        self.number, self.size, self.stretches = number, 0, 0
        self.rows: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.uses: list[np.ndarray] = []
        self.groups: list[np.ndarray] = []

    def add(self, texts: Texts, ids: list, shas: list, size: int) -> Iterator[pa.RecordBatch]:
        aligned, flat = texts.aligned, (texts.flat + self.stretches).astype(np.uint32)
        n_a, n_b = (texts.sums(n).tolist() for n in (aligned.n_first, aligned.n_second))
        cuts = np.concatenate(([0], np.cumsum(texts.sizes))).tolist()
        yield _rows(
            [(self.number, ids[k], n_a[k], n_b[k], shas[k], flat[cuts[k] : cuts[k + 1]].tobytes(), None, None, None) for k in range(len(ids))]
        )
        self.pairs.append(aligned.pairs())
        self.groups.append(aligned.n_groups)
        self.uses.append(np.repeat(np.bincount(texts.flat, minlength=len(aligned.good)), aligned.n_groups))
        self.stretches += len(aligned.good)
        self.size += size

    def close(self) -> pa.RecordBatch:
        """The pairs of the stretches as places among the piece's distinct pairs, those, and how often each occurs."""
        pairs, places = np.unique(np.concatenate(self.pairs), return_inverse=True)
        counts = np.bincount(places, weights=np.concatenate(self.uses), minlength=len(pairs)).astype(np.int64)
        groups = np.concatenate(self.groups).astype(np.uint32)
        links = np.concatenate((np.array([len(groups)], np.uint32), groups, places.astype(np.uint32)))
        return _rows([(self.number, None, 0, 0, None, None, links.tobytes(), pairs.tobytes(), counts.tobytes())])


def _counting(shared):
    """Per piece: a row for each text with the numbers of its stretches, and one row with the stretches' links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = loaded(Aligner, *shared.value)
        piece = _Piece(TaskContext.get().partitionId() << 32)
        for batch in slices(batches, 1):
            column = batch.column(1).cast(pa.string())
            texts = Texts(aligner, column.to_pylist())
            shas = [hashlib.sha256(x).digest() if x else None for x in texts.lists()]
            yield from piece.add(texts, batch.column(0).to_pylist(), shas, column.nbytes)
            if piece.size >= PIECE_BYTES:
                yield piece.close()
                piece = _Piece(piece.number + 1)
        if piece.size or piece.pairs:
            yield piece.close()

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct pairs of a piece as rows; pairs of texts that have no tokens after all count nothing."""
    for batch in batches:
        for piece, pairs, counts in zip(*(c.to_pylist() for c in batch.columns)):
            pair, n = np.frombuffer(pairs, np.int64), np.frombuffer(counts, np.int64)
            place = np.flatnonzero(n)
            pair = pair[place]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(pair), piece)), pa.array(place.astype(np.int32)),
                    pa.array((pair >> 32).astype(np.int32)), pa.array((pair & 0xFFFFFFFF).astype(np.int32)), pa.array(n[place]),
                ],
                names=["piece", "place", "a_id", "b_id", "n"],
            )


def _summing(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """Sums over the links of each text of a piece, by the answers for its distinct pairs."""
    kept = next(x for x in texts["links"] if x.is_valid)
    links = np.frombuffer(kept.as_buffer(), np.uint32).astype(np.int64)
    groups, places = links[1 : links[0] + 1], links[links[0] + 1 :]
    total, best = (np.zeros(places.max(initial=-1) + 1, np.int64) for _ in range(2))
    place = answers["place"].to_numpy()
    total[place] = answers["total"].to_numpy()
    best[place] = answers["best"].to_numpy().astype(np.int64)
    texts = texts.filter(pc.is_valid(texts["parts"]))
    parts = [np.frombuffer(x.as_buffer(), np.uint32) for x in texts["parts"]]
    flat, sizes = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
    n_groups, n_best, count_sum = (
        ragged_sums(of_stretch[flat], sizes) for of_stretch in (groups, ragged_sums(best[places], groups), ragged_sums(total[places], groups))
    )
    return pa.table(
        {"id": texts["id"], "n_a": texts["n_a"], "n_b": texts["n_b"], "n_groups": n_groups, "n_links": n_groups, "n_best": n_best,
         "count_sum": count_sum, "groups_sha": texts["groups_sha"]}
    )


def _shared(docs: DataFrame, first_file: str, second_file: str):
    """Both tokenizer files, read on the driver; their size does not depend on the data."""
    content = tuple(open(path, "rb").read() for path in (first_file, second_file))
    return docs.sparkSession.sparkContext.broadcast(content)


def _pieces(docs: DataFrame, shared, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The pieces as written, and the distinct pairs of every piece with their counts in it."""
    found = materialize(narrow(docs, id_col, text_col).mapInArrow(_counting(shared), _PIECE_DDL), "alignment")
    uses = (
        found.where("pairs is not null").select("piece", "pairs", "counts")
        .mapInArrow(_spread, "piece long, place int, a_id int, b_id int, n long")
    )
    return found, uses


def pair_counts(docs: DataFrame, first_file: str, second_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per linked pair of ids: ``a_id, b_id, total``."""
    _, uses = _pieces(docs, _shared(docs, first_file, second_file), id_col, text_col)
    return uses.groupBy("a_id", "b_id").agg(F.sum("n").alias("total"))


def group_lists(docs: DataFrame, first_file: str, second_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, groups``, the ids of every group as ``a1,a2|b1;a3|b2,b3``. No shuffle."""
    shared = _shared(docs, first_file, second_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = loaded(Aligner, *shared.value)
        for batch in slices(batches, 1):
            lists = Texts(aligner, batch.column(1).cast(pa.string()).to_pylist()).lists()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.decode() for x in lists], pa.string())], names=["id", "groups"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "id long, groups string")


def measure_alignment(docs: DataFrame, first_file: str, second_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha``.

    ``count_sum`` adds the corpus-wide counts of the linked pairs; ``n_best``
    counts the links whose count is the highest of their id of the second
    tokenizer; ``groups_sha`` is null without tokens.
    """
    found, uses = _pieces(docs, _shared(docs, first_file, second_file), id_col, text_col)
    totals = materialize(uses.groupBy("a_id", "b_id").agg(F.sum("n").alias("total")), "pair-counts")
    highest = totals.groupBy("b_id").agg(F.max("total").alias("highest"))  # a row per id of the vocabulary at most
    judged = totals.join(F.broadcast(highest), "b_id").select("a_id", "b_id", "total", (F.col("total") == F.col("highest")).alias("best"))
    answers = uses.join(judged, ["a_id", "b_id"]).select("piece", "place", "total", "best")
    return (
        found.select("piece", "id", "n_a", "n_b", "parts", "links", "groups_sha").groupBy("piece")
        .cogroup(answers.groupBy("piece"))
        .applyInArrow(
            _summing,
            "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha binary",
        )
    )
