"""SimHash groups against a comparison of all pairs."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from docketry.llm import simhash
from docketry.llm.components import connected_components
from docketry.llm.queries import op7_simhash_near_dedup

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return label


def components(ids, fps):
    label = plain_groups(fps)
    best = {}
    for l, i in zip(label, ids):
        if i is not None:
            best[l] = min(best.get(l, i), i)
    return sorted([(i, f, best.get(l)) for i, f, l in zip(ids, fps, label)], key=str)


def got(df):
    return sorted([(r.id, r.fp % (1 << 64), r.component_id) for r in df.collect()], key=str)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    out = op7_simhash_near_dedup(spark, SF).collect()
    want = components([d.doc_id for d in docs], [plain_fingerprint(d.text) for d in docs])
    assert sorted([(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in out], key=str) == want
    assert all(len(r.fingerprint) == 16 for r in out)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    texts = [None, "", "  \n", "one", "One two", "one two three four", "ONE\x0btwo three four", "É a b c d", "é a b c d",
             long, long + " end", "same row", "same row", "same row"]
    ids = [0, 1, 2, 3, 4, 5, None, 7, 8, 9, 10, 11, 11, None]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in zip(ids, texts)], "doc_id long, text string, fp long, label long")
    assert got(simhash.cluster(docs)) == components(ids, [plain_fingerprint(t) for t in texts])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    label = plain_groups([plain_fingerprint(t) for t in texts])
    assert kept.count() == len(set(label))
    assert simhash.cluster(docs.where("false")).count() == 0
    assert simhash.drop_near_duplicates(docs.where("false")).count() == 0


@pytest.mark.parametrize("tile", [3, 40, 8192])
def test_tiles_lose_no_link(spark, tile):
    rng = random.Random(tile)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = list({b ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(4)} | {0, 2**64 - 1})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    labels = {r.node % (1 << 64): r.label for r in connected_components(simhash.link_fingerprints(df, 4, tile)).collect()}
    group = [labels.get(f, f if f < 1 << 63 else f - (1 << 64)) for f in fps]
    want = plain_groups(fps)
    assert len(set(zip(group, want))) == len(set(group)) == len(set(want))


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 200), st.integers(1, 200))
def test_forest_of_two_tiles(seed, n, m):
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 1 << 12, k).astype(np.uint64) for k in (n, m))
    u, v = simhash.compare_tiles(a, b, 2, False)
    assert len(u) < n + m and all(isinstance(x, np.uint64) for x in u)


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    rows = connected_components(spark.createDataFrame(path + star, "u long, v long")).collect()
    assert {r.node: r.label for r in rows} == {**{i: 0 for i in range(101)}, **{1000 + i: 1000 for i in range(300)}}
