"""Token counts of whole texts with the whole-token shortcut.

Defined results: null and empty texts have no tokens; rows are counted one by
one, so repeated rows and null ids need no rule; special strings inside a text
count as the library counts them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from docketry.llm import tokens
from docketry.llm.common import narrow, slices
from docketry.shipping import ship_with_tasks

ship_with_tasks(__name__)


def count_tokens(
    docs: DataFrame, tokenizer_file: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``id, n_bytes, n_tokens, over_limit``. No shuffle."""
    content = open(tokenizer_file, "rb").read()
    shared = docs.sparkSession.sparkContext.broadcast((content, tokens.proven_whole_tokens(content)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = tokens.loaded(tokens.WordBpeCounter, *shared.value)
        for batch in slices(batches, 1):
            texts = batch.column(1).cast(pa.string())
            n = pa.array(counter.count(texts.to_pylist()), pa.int64())
            size = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean")
