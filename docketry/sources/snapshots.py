"""Stored snapshots with a Merkle tree, and change sets that read only what differs.

Rows lie by a hash of their key: ``leaves`` ranges of the hash are the leaves of a
tree of fixed fan-out, and some of them share a folder. A leaf's digest is a sum of
the digests of its rows (four 64-bit words, added without carry between them, and
the row count), so it needs no order and no list, is combined before the shuffle,
and any number of rows is one row of the tree. A node's digest is that of its
children's, at most ``FAN_OUT`` of them. The size of the tree does not depend on the
rows. Two snapshots are compared from the root down; where digests are equal nothing
below is looked at, and of the data only folders and row groups of differing leaves
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import changes

FAN_OUT = 16
_COLUMNS = ("key", "entity", "payload", "identity")
_TREE = "level int, node long, digest string"


def _leaf(leaves: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(leaves)).alias("leaf")


def _word(digest: Column, k: int) -> Column:
    """A quarter of a digest as a number."""
    return F.conv(F.substring(digest, 16 * k + 1, 16), 16, 10).cast("decimal(38,0)")


def leaf_digests(snapshot: DataFrame, leaves: int) -> DataFrame:
    """``node, digest`` of the leaves that hold rows."""
    texts = [F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("")) for c in _COLUMNS]
    rows = snapshot.select(_leaf(leaves), F.sha2(F.concat_ws("\u0001", *texts), 256).alias("d"))
    sums = [F.sum(_word(F.col("d"), k)).alias(f"s{k}") for k in range(4)]
    return rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *sums).select(
        F.col("leaf").alias("node"), F.sha2(F.concat_ws(":", "n", *[f"s{k}" for k in range(4)]), 256).alias("digest")
    )


def tree(snapshot: DataFrame, leaves: int) -> DataFrame:
    """All nodes ``level, node, digest``; level 0 are the leaves, the highest level is the root."""
    level = leaf_digests(snapshot, leaves).withColumn("level", F.lit(0))
    nodes, size, n = level, leaves, 0
    while size > 1:
        size, n = -(-size // FAN_OUT), n + 1
        child = F.struct("node", "digest")  # at most FAN_OUT of them
        line = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: F.concat_ws(":", c["node"], c["digest"])), ",")
        level = (
            level.groupBy(F.floor(F.col("node") / FAN_OUT).cast("long").alias("node")).agg(F.sha2(line, 256).alias("digest"))
            .withColumn("level", F.lit(n))
        )
        nodes = nodes.unionByName(level)
    return nodes.select("level", "node", "digest")


def write_snapshot(snapshot: DataFrame, path: str, *, leaves: int = 4096, folders: int = 64) -> None:
    """Store a snapshot ``(key, entity, payload, identity)`` below ``path``; the tree is written last."""
    folder = F.floor(F.col("leaf") / -(-leaves // folders)).cast("int").alias("folder")
    rows = snapshot.select(*_COLUMNS, _leaf(leaves))
    (
        rows.select("*", folder).repartition(folders, "folder").sortWithinPartitions("folder", "leaf")
        .write.partitionBy("folder").parquet(f"{path}/rows")
    )
    tree(snapshot, leaves).withColumn("leaves", F.lit(leaves)).withColumn("folders", F.lit(folders)).coalesce(1).write.parquet(f"{path}/tree")


def _tree_of(spark: SparkSession, path: str) -> tuple[dict[int, dict[int, str]], int, int]:
    """The nodes by level; their number is fixed by ``leaves``."""
    rows = spark.read.parquet(f"{path}/tree").collect()
    levels: dict[int, dict[int, str]] = {}
    for r in rows:
        levels.setdefault(r.level, {})[r.node] = r.digest
    return levels, rows[0].leaves if rows else 0, rows[0].folders if rows else 0


def differing_leaves(spark: SparkSession, before: str, after: str) -> tuple[list[int], int, int]:
    """Leaves whose rows differ, found from the root down; leaves and folders of the layout."""
    (a, leaves_a, folders_a), (b, leaves_b, folders_b) = (_tree_of(spark, p) for p in (before, after))
    if a and b and (leaves_a, folders_a) != (leaves_b, folders_b):
        raise ValueError("the snapshots are laid out differently")
    leaves, folders = leaves_a or leaves_b, folders_a or folders_b
    open_nodes = {0}
    for level in range(max([*a, *b], default=0), -1, -1):
        differing = [n for n in open_nodes if a.get(level, {}).get(n) != b.get(level, {}).get(n)]
        if level == 0:
            return sorted(differing), leaves, folders
        open_nodes = {n * FAN_OUT + k for n in differing for k in range(FAN_OUT)}
    return [], leaves, folders


def _rows(spark: SparkSession, path: str, chosen: list[int], leaves: int, folders: int) -> DataFrame:
    width = -(-leaves // folders)
    rows = spark.read.schema("key string, entity string, payload string, identity string, leaf long, folder int").parquet(f"{path}/rows")
    return rows.where(F.col("folder").isin(sorted({n // width for n in chosen})) & F.col("leaf").isin(chosen)).select(*_COLUMNS)


def changes_between(spark: SparkSession, before: str, after: str) -> DataFrame:
    """The change set of two stored snapshots without its no-op rows."""
    chosen, leaves, folders = differing_leaves(spark, before, after)
    if not chosen:
        return spark.createDataFrame([], "key string, entity string, action string")
    rows = changes.change_set(*(_rows(spark, p, chosen, leaves, folders) for p in (before, after)))
    return rows.where("action <> 'no-op'")
