"""Tokenizer alignment against a plain one over the tokenizers' own libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from docketry.llm import alignment, tokens
from docketry.llm.queries import op13_tokenizer_alignment

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def files():
    return [tokens.public_path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def plain(files):
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(files[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=files[1])
    shown = [b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}

    def first_tokens(text):
        return [(i, bytes(byte[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]

    def second_tokens(text):
        out = []
        for i in second.encode(text):
            p = second.id_to_piece(i)
            out.append((i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()))
        return out

    def run(texts):
        docs = []
        for t in texts:
            a, b = (first_tokens(t), second_tokens(t)) if t else ([], [])
            raw = (" " + (t or "")).encode()
            if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
                a, b = [], []
            at_a, at_b = (np.cumsum([len(x) for _, x in s]).tolist() for s in (a, b))
            groups, i, j = [], 0, 0
            for end in sorted(set(at_a) & set(at_b)):
                x, y = at_a.index(end, i) + 1, at_b.index(end, j) + 1
                groups.append(([k for k, _ in a[i:x]], [k for k, _ in b[j:y]]))
                i, j = x, y
            docs.append((len(a), len(b), groups))
        count = Counter((g[0][-1], g[1][-1]) for d in docs for g in d[2])
        best = {}
        for (_, b), n in count.items():
            best[b] = max(best.get(b, 0), n)
        rows = []
        for n_a, n_b, groups in docs:
            links = [(g[0][-1], g[1][-1]) for g in groups]
            text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
            rows.append(
                (n_a, n_b, len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
                 hashlib.sha256(text.encode()).hexdigest() if n_a else "")
            )
        return rows, count

    return run


def test_whole_table(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    rows = op13_tokenizer_alignment(spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(d.doc_id, *w) for d, w in zip(docs, plain([d.text for d in docs])[0])]


def odd_texts():
    rng = random.Random(5)
    texts = [None, "", " ", "\n\n  a", "a▁b", "▁", "x\x00y", "<s> </s><unk> <|endoftext|> <0x41>", "é" * 50, "日本語のテキスト" * 40]
    texts += ["\U0001f600‍!", "é", "  tab\tend ", "same same", "same same", "a" * 3000, "word " * 40_000]
    marks = "ab é日 \n\t'.,<>|0▁"
    return texts + ["".join(rng.choice(marks) for _ in range(rng.randint(1, 120))) for _ in range(150)]


def test_odd_texts_in_small_pieces(spark, plain, files, monkeypatch):
    monkeypatch.setattr(alignment, "PIECE_BYTES", 400)
    texts = odd_texts()
    docs = spark.createDataFrame(
        [(None if i == 13 else i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, piece string, links long"
    )
    want, count = plain(texts)
    rows = {r.id: r for r in alignment.measure_alignment(docs.repartition(5), *files).collect()}
    for i, w in enumerate(want):
        r = rows[None if i == 13 else i]
        sha = r.groups_sha.hex() if r.groups_sha else ""
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, sha) == w, texts[i][:50]
    pairs = alignment.pair_counts(docs, *files).collect()
    assert {(r.a_id, r.b_id): r.total for r in pairs} == dict(count)
    lists = {r.id: r.groups for r in alignment.group_lists(docs, *files).collect()}
    for i, w in enumerate(want):
        groups = lists[None if i == 13 else i]
        assert (hashlib.sha256(groups.encode()).hexdigest() if groups else "") == w[-1]


def test_empty_table(spark, files):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.measure_alignment(docs, *files).count() == 0
    assert alignment.pair_counts(docs, *files).count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    rows = alignment.measure_alignment(only, *files).collect()
    assert sorted((r.id, r.n_a, r.n_links, r.count_sum, r.groups_sha) for r in rows) == [(1, 0, 0, 0, None), (2, 0, 0, 0, None)]


def test_common_ends():
    rng = random.Random(2)
    for _ in range(400):
        n = rng.randint(1, 60)
        x, y = ([k for k in range(n) if rng.random() < p] + [n] for p in (rng.random(), rng.random()))
        i, j = alignment.common_ends(x, y)
        assert [x[k] for k in i] == [y[k] for k in j] == sorted(set(x) & set(y))
