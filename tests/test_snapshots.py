"""Stored snapshots: change sets equal the full ones and open only what differs."""

import random

import pytest

from docketry.operators import changes
from docketry.sources import snapshots as SN


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, entity string, payload string, identity string")


def as_set(df):
    return {(r.key, r.entity, r.action) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_the_full_change_set(spark, tmp_path, seed):
    rng = random.Random(seed)
    before = {f"k{i}": ("e", f"p{rng.randrange(3)}", "i") for i in range(400)}
    after = dict(before)
    for k in rng.sample(list(before), (0, 3, 60)[seed]):
        kind = rng.randrange(4)
        if kind == 0:
            del after[k]
        else:
            after[k] = (("e", "new", "i"), ("e", before[k][1], "other"), ("f", None, None))[kind - 1]
    if seed:
        after["brand new"] = ("e", "p", None)
    frames = [frame(spark, [(k, *v) for k, v in s.items()]) for s in (before, after)]
    paths = [str(tmp_path / n) for n in ("a", "b")]
    for f, p in zip(frames, paths):
        SN.write_snapshot(f.repartition(3), p, leaves=256, folders=8)
    got = SN.changes_between(spark, *paths)
    full = changes.change_set(*frames).where("action <> 'no-op'")
    assert as_set(got) == as_set(full) and got.count() == full.count()
    chosen, _, _ = SN.differing_leaves(spark, *paths)
    assert len(chosen) <= full.count() and bool(chosen) == (seed > 0)


def test_only_differing_folders_are_opened(spark, tmp_path):
    rows = [(f"k{i}", "e", "p", "i") for i in range(2000)]
    paths = [str(tmp_path / n) for n in ("a", "b")]
    SN.write_snapshot(frame(spark, rows), paths[0])
    SN.write_snapshot(frame(spark, [*rows[1:], ("k0", "e", "changed", "i")]), paths[1])
    assert as_set(SN.changes_between(spark, *paths)) == {("k0", "e", "update")}
    chosen, leaves, folders = SN.differing_leaves(spark, *paths)
    assert len(chosen) == 1
    read = SN._rows(spark, paths[1], chosen, leaves, folders)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "PushedFilters: [IsNotNull(leaf)" in plan
    assert len(read.inputFiles()) >= 1 and read.count() <= 5


def test_copies_count(spark, tmp_path):
    """A row more of the same kind changes its leaf; order and partitioning do not."""
    one, two = frame(spark, [("k", "e", "p", "i")] * 2), frame(spark, [("k", "e", "p", "i")] * 3)
    digests = lambda f: {(r.level, r.node): r.digest for r in SN.tree(f, 64).collect()}
    assert digests(one) != digests(two) and digests(two) == digests(two.repartition(3))
    many = frame(spark, [(f"k{i}", "e", str(i % 7), None) for i in range(500)])
    assert digests(many) == digests(many.orderBy("payload").repartition(7))


def test_empty_snapshots(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("a", "b", "c")]
    SN.write_snapshot(frame(spark, []), paths[0])
    SN.write_snapshot(frame(spark, []), paths[1])
    SN.write_snapshot(frame(spark, [("k", "e", "p", "i")]), paths[2])
    assert SN.changes_between(spark, paths[0], paths[1]).count() == 0
    with pytest.raises(ValueError):
        SN.write_snapshot(frame(spark, [("k", "e", "p", "i")]), str(tmp_path / "d"), leaves=16)
        SN.changes_between(spark, paths[2], str(tmp_path / "d"))
