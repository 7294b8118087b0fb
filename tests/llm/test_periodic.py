"""Periodic runs against a plain search over every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pyarrow as pa
import pytest

from docketry.llm import periodic
from docketry.llm.queries import op12_periodic_runs

SF = "/root/testdata/sf0.001"


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def plain(w, spec):
    out = []
    for q in range(1, len(w) // spec.min_exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            start, end = i, j + q
            if j > i and end - start >= max(spec.min_length, spec.min_exponent * q):
                if not any(all(w[k] == w[k + r] for k in range(start, end - r)) for r in range(1, q)):
                    out.append((start, end - start, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def row_of(w, spec):
    runs = plain(w, spec)
    best = (None,) * 4
    if runs:
        s, n, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (s, n, q, 1000 * n // q)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(kept_words(w, runs)).encode()).hexdigest())


def changed(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    rows = op12_periodic_runs(spark, SF).orderBy("doc_id").collect()
    want = [(d.doc_id, *row_of(changed(d.doc_id, words_of(d.text)), periodic.Runs())) for d in docs if len(d.text or "") < 9000]
    short = {w[0] for w in want}
    assert [tuple(r) for r in rows if r.doc_id in short] == want
    assert len(rows) == len(docs)
    assert sum(r.n_runs > 0 for r in rows) > 15


@pytest.mark.parametrize("spec", [(24, 3), (3, 2), (6, 3), (1, 2), (10, 2), (9, 4)])
def test_small_alphabets(spec):
    spec, rng = periodic.Runs(*spec), random.Random(str(spec))
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 5)):
            w = [rng.choice("abcde"[: rng.choice([1, 2, 2, 3, 5])]) for _ in range(rng.randint(0, 70))]
            if rng.random() < 0.5 and w:
                p, a = rng.randint(1, 12), rng.randrange(len(w))
                for i in range(a + p, len(w)):
                    w[i] = w[i - p]
            texts.append(" ".join(w))
        piece = periodic.Piece(pa.array(texts), spec)
        assert [piece.runs.get(k, []) for k in range(len(texts))] == [plain(t.split(), spec) for t in texts]


def test_ties_take_the_smallest_start():
    one = ["x"] * 24
    runs = periodic.Piece(pa.array([" ".join([*one, "q", *one])]), periodic.Runs()).runs[0]
    assert runs == [(0, 24, 1), (25, 24, 1)]
    assert periodic.strongest(runs) == (0, 24, 1)
    assert periodic.strongest([(9, 60, 20), (3, 24, 8), (3, 27, 9)]) == (3, 24, 8)


def test_odd_rows_and_clashing_names(spark):
    long = "a b c " * 30_000
    texts = [None, "", " \n\t", "É ü\x0bx\r\n" * 20, "É ü\x0bx\r\n" * 20, "lone", long, "  a " * 30]
    docs = spark.createDataFrame(
        [(i if i != 5 else None, t, "x", i, b"") for i, t in enumerate(texts)],
        "doc_id long, text string, cut string, n_runs long, row binary",
    )
    rows = {r.id: r for r in periodic.measure_runs(docs).collect()}
    for i, t in enumerate(texts):
        row = rows[i if i != 5 else None]
        if i != 6:
            got = (row.n_runs, row.start, row.length, row.period, row.exponent_milli, row.runs_sha.hex(), row.collapsed_sha.hex())
            assert got == row_of(words_of(t), periodic.Runs())
    assert (rows[6].n_runs, rows[6].start, rows[6].length, rows[6].period) == (1, 0, 90_000, 3)
    assert sorted((r.id, r.start, r.length, r.period) for r in periodic.find_runs(docs).collect()) == [
        (3, 0, 60, 3), (4, 0, 60, 3), (6, 0, 90_000, 3), (7, 0, 60, 2),
    ]
    cut = periodic.collapse_runs(docs)
    assert cut.columns == docs.columns
    out = {r.n_runs: r.text for r in cut.collect()}
    assert out[6] == "a b c" and out[3] == "É ü x" and out[0] is None and out[2] == " \n\t"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    for made in (periodic.measure_runs(docs), periodic.find_runs(docs), periodic.collapse_runs(docs)):
        assert made.count() == 0
    with pytest.raises(ValueError):
        periodic.Runs(min_length=0)
