"""Repeated windows against a plain count of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from docketry.llm import substring
from docketry.llm.queries import op10_substring_dedup

SF = "/root/testdata/sf0.001"


def plain(texts, n):
    split = [[w for w in re.split("[\x20\x09-\x0d]+", t or "") if w] for t in texts]
    count = {}
    for words in split:
        for i in range(len(words) - n + 1):
            w = tuple(words[i : i + n])
            count[w] = count.get(w, 0) + 1
    out = []
    for words in split:
        gone = set()
        for i in range(len(words) - n + 1):
            if count[tuple(words[i : i + n])] > 1:
                gone.update(range(i, i + n))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def got(df):
    return [(r.n_words, r.n_removed, r.kept_sha.hex()) for r in df.orderBy("id").collect()]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    out = op10_substring_dedup(spark, SF).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in out] == plain([d.text for d in docs], 35)


@pytest.mark.parametrize("words,bits", [(1, 20), (3, 20), (5, 26), (35, 21)])
def test_small_windows(spark, monkeypatch, words, bits):
    monkeypatch.setattr(substring, "PIECE", 50)
    rng = random.Random(words)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [None, "", " \n ", "a " * 90, "a " * 4, "É ü\x0bx\n" * 30, texts[3], "lone " + texts[5], "a " * 50_000]
    docs = spark.createDataFrame([(i, t, "x", b"y") for i, t in enumerate(texts)], "doc_id long, text string, sha string, spans binary")
    spec = substring.Windows(words=words, bits=bits)
    assert got(substring.measure_repeats(docs.repartition(5), spec)) == plain(texts, words)
    cut = substring.remove_repeats(docs, spec)
    assert cut.columns == docs.columns
    out = [r.text for r in cut.orderBy("doc_id").collect()]
    for text, new, (n, removed, sha) in zip(texts, out, plain(texts, words)):
        if removed:
            assert hashlib.sha256(new.encode()).hexdigest() == sha
        else:
            assert new == text


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d")] * 3 + [(1, "q r s")], "doc_id long, text string")
    spec = substring.Windows(words=3, bits=20)
    assert substring.measure_repeats(docs.where("false"), spec).count() == 0
    assert substring.remove_repeats(docs.where("false"), spec).count() == 0
    rows = substring.measure_repeats(docs, spec).collect()
    assert sorted((str(r.id), r.n_removed) for r in rows) == [("1", 0)] + [("None", 4)] * 3


def test_leftmost_least():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 24):
        v = rng.integers(0, 5, 200).astype(np.uint64)
        want = [i + int(np.argmin(v[i : i + n])) for i in range(len(v) - n + 1)]
        assert substring._leftmost_least(v, n).tolist() == want
