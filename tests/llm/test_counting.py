"""Token counts and ids against the library, text by text."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from docketry.llm import counting, tokens
from docketry.llm.queries import op9_token_counts

SF = "/root/testdata/sf0.001"
WORDS, BYTES = tokens.public_path("word_bpe_49k.json"), tokens.public_path("byte_bpe_50k.json")
HARD = [
    "", " ", "a", " a", "a ", "a  b", "a   b", "\n", "a\nb", "a\n\nb", "a \nb", "a\n b", "\ta\tb", "a b  c", "x\x1cy \x1c z",
    "ΑΣ ας ΣΑΣ", "é ́x", "İstanbul ẞ ﬁ", "don't we'll I'M x'st !'s ''s", "<|endoftext|>", "a <|endoftext|> b<|startoftext|>c <|end",
    "日本語 텍스트 😀😀 👩‍👩‍👧", "0123 4½ ²x 12a", "##//**", "a" * 5000, "word " * 3000, "\x00\x01 \x7f", "a\r\nb\x0b\x0cc", "  lead", "trail  ",
]


def noise(seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ab C'sdtéΣ 1  \n\t<|>é́ .,-! ") for _ in range(rng.randint(0, 60)))


@pytest.fixture(scope="module")
def texts(spark):
    return [d.text for d in spark.read.parquet(f"{SF}/documents.parquet").collect()] + HARD + [noise(i) for i in range(400)]


def test_counter_agrees(texts):
    content = open(WORDS, "rb").read()
    library, counter = Tokenizer.from_file(WORDS), tokens.WordBpeCounter(content, tokens.proven_whole_tokens(content))
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counter.count(texts) == want
    assert [counter.count([t])[0] for t in texts] == want


def test_byte_ids_agree(texts):
    library = Tokenizer.from_file(BYTES)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    coder = tokens.ByteBpe(open(BYTES, "rb").read())
    assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode(texts)] == want


def test_small_memo(texts, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_BYTES", 5000)
    content = open(WORDS, "rb").read()
    library, counter = Tokenizer.from_file(WORDS), tokens.WordBpeCounter(content, tokens.proven_whole_tokens(content))
    assert [counter.count([t])[0] for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_proof():
    content = open(WORDS, "rb").read()
    library, proven = Tokenizer.from_file(WORDS), tokens.proven_whole_tokens(content)
    assert len(proven) > 30_000 and len(set(proven)) == len(proven)
    assert all(len(library.encode(p, add_special_tokens=False).ids) == 1 for p in proven[::97])


def test_query(spark):
    library = Tokenizer.from_file(WORDS)
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op9_token_counts(spark, SF).collect():
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "a b", 3)], "doc_id long, text string, n_tokens int")
    rows = counting.count_tokens(docs, WORDS, 1).collect()
    assert sorted((str(r.id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == [
        ("1", 0, 0, False), ("1", 0, 0, False), ("2", 3, 2, True), ("None", 0, 0, False)
    ]
    assert counting.count_tokens(docs.where("false"), WORDS).count() == 0


def test_memos_are_bounded_in_bytes(monkeypatch):
    """Texts without blanks leave nothing behind, many short ones no more than the bound."""
    monkeypatch.setattr(tokens, "MEMO_BYTES", 20_000)
    content = open(WORDS, "rb").read()
    counter = tokens.WordBpeCounter(content, tokens.proven_whole_tokens(content))
    for k in range(30):
        counter.count([f"x{k}y" * 5000, "é" * 4000 + str(k)] + [f"w{k}q{i}" for i in range(20)])
    counter.count([""])
    for memo in (counter.memo, counter.merged):
        assert max(map(len, memo), default=0) <= memo.LONGEST
        assert sum(memo.ENTRY + 4 * len(s) for s in memo) <= 20_000 + 25 * 400
