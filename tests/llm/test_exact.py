"""Exact duplicates: the code, the exchange, and the marks against a plain grouping."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docketry.llm import exact, golomb
from docketry.llm.queries import op1_exact_dedup

SF = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63 - 1), max_size=300))
def test_golomb_round_trip(values):
    array = np.sort(np.array(values, np.uint64))
    assert golomb.decode(golomb.encode(array), len(array)).tolist() == array.tolist()


def test_golomb_is_short():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 200_000).astype(np.uint64))
    blob = golomb.encode(values)
    assert len(blob) * 8 / len(values) < 40 - np.log2(len(values)) + 2.1
    assert (golomb.decode(blob, len(values)) == values).all()


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        best = max(ids, key=lambda i: (i is not None, i))
        out += [(i, best, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def rows(df):
    return sorted([(r.id, r.keep_id, r.group_size, r.sha.hex()) for r in df.collect()], key=str)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op1_exact_dedup(spark, SF).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == plain(
        [(d.doc_id, d.text) for d in docs.collect()]
    )
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


CASES = [
    (1, "Abc"), (2, "aBC"), (3, "abc "), (4, "É"), (5, "é"), (6, None), (7, ""), (8, "Z" * 300_000),
    (9, "z" * 300_000), (None, "lone"), (None, "abc"), (10, "same"), (10, "same"), (10, "other"), (11, "other"),
]


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_edges(spark, monkeypatch, limit):
    monkeypatch.setattr(exact.broadcast_if_small, "__defaults__", (limit,))
    docs = spark.createDataFrame([(i, t, i, False) for i, t in CASES], "doc_id long, text string, keep_id long, kept boolean")
    marked = exact.mark_duplicates(docs.repartition(3))
    assert rows(marked) == plain(CASES)
    assert marked.where("kept").groupBy("sha").count().where("count > 1").count() == 0
    kept = exact.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted([(r.doc_id, (r.text or "")[:5]) for r in kept.collect()], key=str) == sorted(
        [(2, "aBC"), (3, "abc "), (4, "É"), (5, "é"), (7, ""), (9, "zzzzz"), (None, "lone"), (10, "same"), (11, "other")], key=str
    )
    assert exact.mark_duplicates(docs.where("false")).count() == 0
    assert exact.drop_duplicates(docs.where("false")).count() == 0


def test_suspects_by_chance_fall_away(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    light = docs.select(F.lit(5).cast("long").alias("head"))
    assert exact.exchange(light, 3000, 40).count() == 1
    monkeypatch.setattr(exact, "SPARE_BITS", -20)
    monkeypatch.setattr(exact, "_digest", exact._digest)
    assert exact.mark_duplicates(docs).where("group_size > 1").count() == 0


def test_codes_do_not_pay_for_where_values_lie():
    """A message of every owner: near the entropy of its gaps, whatever the owner's range."""
    rng, bits, owners = np.random.default_rng(1), 43, 200
    values = np.unique(rng.integers(0, 1 << bits, 1_000_000).astype(np.uint64))
    owner = exact.owner_of(values, owners, bits)
    parts = [values[owner == k] for k in range(owners)]
    coded = [golomb.encode(p) for p in parts]
    assert all((golomb.decode(c, len(p)) == p).all() for c, p in zip(coded, parts))
    assert 8 * sum(map(len, coded)) / len(values) < 26
