"""Piece ids and texts against the library."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from docketry.llm import pieces
from docketry.llm.tokens import public_path

SF = "/root/testdata/sf0.001"
MODEL = public_path("piece_bpe_32k.model")
HARD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a    b", "                    x", "\n", "\n\n", "a\nb", "a\n b", "a \nb", "\n a", "\ta", "日本語テキスト",
    "😀👩‍👩‍👧 x", "é É ß ﬁ", "▁", "a▁b", "▁▁a ▁", "<s> </s> <unk> <0x0A>", "a" * 300, "ab" * 200, "the " * 500, "\x00\x01", "https://a.b/c?d=e&f=1",
    "aaaaaaa bbbbbbb", "ñandú\r\n", "  x",
]


def noise(seed):
    rng = random.Random(seed)
    return "".join(rng.choice(["ab", "C", " ", "  ", "é", "\n", "the", "ing", "日", "\U0001f600", "▁", "12", ".", "o", "n", "t"]) for _ in range(rng.randint(0, 50)))


def test_ids_agree(spark, monkeypatch):
    library = SentencePieceProcessor(model_file=MODEL)
    texts = [d.text for d in spark.read.parquet(f"{SF}/documents.parquet").collect()] + HARD + [noise(i) for i in range(500)]
    want = library.encode(texts)
    for entries in (300_000, 40):
        monkeypatch.setattr(pieces, "MEMO_BYTES", 100 * entries)
        coder = pieces.PieceCoder(pieces.load_pieces(MODEL))
        got = [np.frombuffer(i, "<u4").tolist() for k in range(0, len(texts), 50) for i in coder.encode(texts[k : k + 50])]
        for text, g, w in zip(texts, got, want):
            assert g == w, text
    for text, w in zip(texts, want):
        assert coder.decode(np.array(w, "<u4").tobytes()) == text.replace("▁", " ") == library.decode(w), text


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "a b", 3), (2, "a b", 3)], "doc_id long, text string, ids int")
    out = pieces.encode_pieces(docs, MODEL)
    assert sorted((str(r.id), r.n_pieces) for r in out.collect()) == [("1", 0), ("2", 2), ("2", 2), ("None", 0)]
    assert sorted((r.text) for r in pieces.decode_pieces(out, MODEL).collect()) == ["", "", "a b", "a b"]
    assert pieces.encode_pieces(docs.where("false"), MODEL).count() == 0
    nothing = docs.select(F.col("doc_id").alias("id"), F.lit(None).cast("binary").alias("ids"))
    assert [r.text for r in pieces.decode_pieces(nothing, MODEL).collect()] == [""] * 4


def test_query(spark):
    from docketry.llm.queries import op6_sentencepiece

    library = SentencePieceProcessor(model_file=MODEL)
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op6_sentencepiece(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id])
        assert (r.n_pieces, r.ids_crc32, r.decoded_same) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
