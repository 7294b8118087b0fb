"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

One pass over a stretch visits, at each position, the pieces that end there (the
automaton follows its output links) and relaxes the best path that ends with
each. The model at hand is of the merging kind, so a path's score is all or
nothing: two neighbours may follow each other only if merging their joined text
gives these two again. A sequence of which all neighbours pass is the sequence
that merging gives, and each position has one such path, so the ids are those of
the library. Verdicts on pairs are remembered.

No piece holds a space mark after another character, and none holds a line feed,
so stretches between them are encoded apart and remembered.

Defined results: null and empty texts have no ids; a character outside the
vocabulary becomes the pieces of its bytes; rows are encoded one by one.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from docketry.llm.common import Memo, narrow, slices, worker_cache
from docketry.shipping import ship_with_tasks

ship_with_tasks(__name__)

SPACE = "▁"
#: bytes that each of the two memos may keep, and entries of the pairs, whose texts are the vocabulary's own
MEMO_BYTES = 96 << 20
PAIR_ENTRIES = 1_000_000


@dataclass(frozen=True)
class PieceTable:
    """What a task needs of a model: all pieces in the order of their ids, and what kind they are."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]  # id of each byte's piece
    control: frozenset[int]

    @property
    def name(self) -> str:
        return f"pieces-{zlib.crc32(repr((self.pieces, self.scores)).encode())}"


def load_pieces(model_file: str) -> PieceTable:
    """Read on the driver; the size is that of the vocabulary."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    ids = range(model.get_piece_size())
    byte_ids = [0] * 256
    for i in ids:
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
    control = frozenset(i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    return PieceTable(
        tuple(model.id_to_piece(i) for i in ids), tuple(model.get_score(i) for i in ids), tuple(byte_ids), control
    )


class PieceCoder:
    def __init__(self, table: PieceTable):
        import ahocorasick

        self.table = table
        self.score = {p: s for i, (p, s) in enumerate(zip(table.pieces, table.scores)) if i not in table.control}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.score):
            raise ValueError("pieces of this model cross words or lines")
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(table.pieces):
            if i not in table.control:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.byte_of = {p: b for b, p in enumerate(table.byte_ids)}
        self.characters = {c for p in self.score for c in p}
        self.pairs: dict[tuple[str, int], bool] = {}
        self.bare, self.marked = Memo(MEMO_BYTES), Memo(MEMO_BYTES)
        self.newline = self._ids("\n")

    def merge(self, text: str) -> list[str]:
        """The merging rule itself: again and again the best neighbours, the leftmost among equals."""
        symbols = list(text)
        while True:
            joined = [(-self.score[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in self.score]
            if not joined:
                return symbols
            i = min(joined)[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    def _follows(self, before: str, piece: int) -> bool:
        if len(self.pairs) > PAIR_ENTRIES:
            self.pairs.clear()
        text = self.table.pieces[piece]
        verdict = self.merge(before + text) == ([before, text] if before else [text])
        self.pairs[before, piece] = verdict
        return verdict

    def _ids(self, stretch: str) -> bytes:
        """One pass over a stretch: the last piece of the path to each position, then the path back."""
        n = len(stretch)
        last: list[str | None] = [None] * (n + 1)
        last[0] = ""
        chosen: list[int] = [-1] * (n + 1)
        strange = {i + 1 for i, c in enumerate(stretch) if c not in self.characters}
        pairs, pieces = self.pairs, self.table.pieces
        if not strange:
            for end, (piece, size) in self.automaton.iter(stretch):
                before = last[end + 1 - size]
                if before is not None and last[end + 1] is None:
                    good = pairs.get((before, piece))
                    if self._follows(before, piece) if good is None else good:
                        last[end + 1], chosen[end + 1] = pieces[piece], piece
        else:
            parts = re.split("([" + re.escape("".join({stretch[e - 1] for e in strange})) + "])", stretch)
            out = []
            for part in parts:
                if part and part[0] not in self.characters:
                    out.append(array("I", [self.table.byte_ids[b] for b in part.encode()]).tobytes())
                elif part:
                    out.append(self._ids(part))
            return b"".join(out)
        ids = array("I")
        while n:
            if last[n] is None:
                raise ValueError("no path through a stretch of known characters")
            ids.append(chosen[n])
            n -= len(last[n])
        return ids[::-1].tobytes()

    def _learn(self, memo: Memo, lead: str, stretches: set[str]) -> None:
        memo.begin()
        for s in stretches:
            if s not in memo:
                memo.learn(s, self._ids(lead + s))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers (little-endian)."""
        plans = []
        for text in texts:
            if "  " in text or SPACE in text or text.startswith(" ") or "\n " in text:
                lines = f"{SPACE}{text.replace(' ', SPACE)}".split("\n")
                plans.append((True, [re.split(f"(?<=[^{SPACE}])(?={SPACE})", line) for line in lines]))
            else:
                plans.append((False, [line.split(" ") for line in text.split("\n")]))
        bare = {s for raw, lines in plans for k, line in enumerate(lines) for s in (line if raw else line[:1] if k else [])}
        marked = {s for raw, lines in plans if not raw for k, line in enumerate(lines) for s in (line[1:] if k else line)}
        self._learn(self.bare, "", bare)
        self._learn(self.marked, SPACE, marked)
        bare, marked, out = self.bare.__getitem__, self.marked.__getitem__, []
        for text, (raw, lines) in zip(texts, plans):
            if not text:
                out.append(b"")
            elif raw:
                out.append(self.newline.join([b"".join(map(bare, line)) for line in lines]))
            else:
                first = b"".join(map(marked, lines[0]))
                rest = [bare(line[0]) + b"".join(map(marked, line[1:])) for line in lines[1:]]
                out.append(self.newline.join([first, *rest]))
        return out

    def decode(self, ids: bytes) -> str:
        """Text of ids: pieces joined, runs of byte pieces read as UTF-8, the mark before the text taken off."""
        numbers = array("I")
        numbers.frombytes(ids)
        byte_of, out, raw = self.byte_of, [], bytearray()
        for i in numbers:
            if i in byte_of:
                raw.append(byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.table.control:
                out.append(self.table.pieces[i])
        out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ").removeprefix(" ")


def encode_pieces(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, n_pieces, ids`` (binary, unsigned 32-bit little-endian). No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        coder = worker_cache(table.name, lambda: PieceCoder(table))
        for batch in slices(batches, 1):
            ids = coder.encode(batch.column(1).to_pylist())
            n = pa.array([len(i) // 4 for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(ids, pa.binary())], names=["id", "n_pieces", "ids"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "id long, n_pieces long, ids binary")


def decode_pieces(encoded: DataFrame, model_file: str) -> DataFrame:
    """``id, ids`` to ``id, text``; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_pieces(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        coder = worker_cache(table.name, lambda: PieceCoder(table))
        for batch in slices(batches, 1):
            texts = [coder.decode(i) for i in pc.fill_null(batch.column(1), b"").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select("id", "ids").mapInArrow(run, "id long, text string")


def round_trip(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, n_pieces, ids_crc32, decoded_same``, encoded and decoded in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        coder = worker_cache(table.name, lambda: PieceCoder(table))
        for batch in slices(batches, 1):
            texts = batch.column(1).to_pylist()
            ids = coder.encode(texts)
            same = [coder.decode(i) == t.replace(SPACE, " ") for i, t in zip(ids, texts)]
            columns = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(same)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_pieces", "ids_crc32", "decoded_same"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "id long, n_pieces long, ids_crc32 long, decoded_same boolean")
