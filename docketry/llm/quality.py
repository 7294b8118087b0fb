"""Quality rules: word, symbol and line counts, and characters inside repeated n-grams and lines.

Per text, n-grams of words are found with rolling hashes of several lengths in
numpy. A start can begin a repeated n-gram only if it begins a repeated
(n-1)-gram, so one sort of the shortest length suffices and the longer ones look
at what that left.

Defined results: null text has no words and fails the base rule; an empty table
gives an empty result; repeated rows are judged one by one; null ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.common import Roller, Words, mix, narrow, slices, worker_cache
from docketry.shipping import ship_with_tasks

ship_with_tasks(__name__)


@dataclass(frozen=True)
class QualityRules:
    """Limits; the n-gram and line fractions are the published ones for repetition in web text."""

    min_words: int = 10
    base_window: int = 5
    base_percent: int = 20
    ngram_chars: dict[int, float] = field(
        default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
    )
    line_chars: float = 0.20


_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1


def _count_symbols(texts: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    at = np.concatenate(([0], np.cumsum(_SYMBOLS[data])))
    return np.diff(at[offsets - offsets[0]])


def _repeats(keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the starts whose keys occur twice or more: the starts, and whether each comes after the first."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    member = np.zeros(len(keys), bool)
    member[1:] |= same
    member[:-1] |= same
    order = order[member]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    group = np.cumsum(np.concatenate(([True], keys[order][1:] != keys[order][:-1]))) - 1
    first = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, group, starts[order])
    return starts[order], starts[order] != first[group]


def _covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: lines with a word that equal an earlier one, and their characters."""
    lists = pc.split_pattern(texts, "\n")
    doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.dictionary_encode(lists.flatten())
    worded = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat.dictionary)), 0)
    chars = pc.utf8_length(flat.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keep = worded.to_numpy(zero_copy_only=False)[code]
    doc, code = doc[keep], code[keep]
    at, later = _repeats((doc.astype(np.uint64) << np.uint64(32)) | code.astype(np.uint64), np.arange(len(doc)))
    at = at[later]
    return (
        np.bincount(doc[at], minlength=len(texts)).astype(np.int64),
        np.bincount(doc[at], weights=chars[code[at]], minlength=len(texts)).astype(np.int64),
    )


def measure_texts(texts: pa.Array, base_window: int, lengths: list[int]) -> dict[str, np.ndarray]:
    """The counts of every text, as arrays by name."""
    roller = worker_cache("quality-roller", Roller)
    words = Words(texts)
    total = len(words.doc)
    chars = pc.utf8_length(words.distinct).to_numpy(zero_copy_only=False).astype(np.int64)[words.codes]
    lines, line_chars = _lines(texts)
    out = {
        "n_words": words.per_doc,
        "word_chars": words.sum_by_doc(chars),
        "n_symbols": _count_symbols(texts),
        "n_dup_lines": lines,
        "dup_line_chars": line_chars,
        "text_chars": pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64),
    }
    prefix = roller.prefix(mix(words.codes))
    owner = mix(words.doc)
    candidates = np.arange(total)
    for n in sorted({base_window, *lengths}):
        candidates = candidates[candidates <= total - n]
        candidates = candidates[words.doc[candidates] == words.doc[candidates + n - 1]]
        keys = roller.windows(prefix, n)[candidates] ^ owner[candidates]
        starts, later = _repeats(keys, candidates)
        if n == base_window:
            out["n_repeat_words"] = words.sum_by_doc(_covered(starts, n, total))
        if n in lengths:
            out[f"ngram_chars_{n}"] = words.sum_by_doc(chars * _covered(starts[later], n, total))
        candidates = np.sort(starts)
    return out


def _measures(lengths: list[int]) -> list[str]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", "text_chars"]
    return names + [f"ngram_chars_{n}" for n in lengths]


def _with_measures(df: DataFrame, rules: QualityRules) -> DataFrame:
    """The counts beside what ``df`` has; its column ``text`` is measured."""
    column, window, lengths = df.columns.index("text"), rules.base_window, sorted(rules.ngram_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            texts = pc.fill_null(batch.column(column).cast(pa.string()), "")
            found = measure_texts(texts, window, lengths)
            columns = batch.columns + [pa.array(found[m], pa.int64()) for m in _measures(lengths)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *_measures(lengths)])

    schema = T.StructType(df.schema.fields + [T.StructField(m, T.LongType()) for m in _measures(lengths)])
    return df.mapInArrow(run, schema)


def base_failed(rules: QualityRules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.base_percent * F.col("n_words"))


def kept(rules: QualityRules) -> Column:
    """Passed the base rule, and no n-gram length and not the lines repeat too many characters."""
    ok = ~base_failed(rules) & (F.col("dup_line_chars") <= rules.line_chars * F.col("text_chars"))
    for n, limit in rules.ngram_chars.items():
        ok = ok & (F.col(f"ngram_chars_{n}") <= limit * F.col("word_chars"))
    return ok


def measure_quality(
    docs: DataFrame, rules: QualityRules | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, counts, ``base_failed`` and ``kept``. No shuffle."""
    rules = rules or QualityRules()
    return _with_measures(narrow(docs, id_col, text_col), rules).select(
        "id", *_measures(sorted(rules.ngram_chars)),
        base_failed(rules).alias("base_failed"), kept(rules).alias("kept"),
    )


def keep_good(docs: DataFrame, rules: QualityRules | None = None, text_col: str = "text") -> DataFrame:
    """The rows that pass, with the columns of the input; judged where they are read, no join."""
    rules = rules or QualityRules()
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    return _with_measures(held, rules).where(kept(rules)).select("row.*")
