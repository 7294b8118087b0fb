"""Snapshot change sets: actions, counts, fingerprint, report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import schemas as S
from docketry.functions import text as X
from docketry.session import cut_lineage


def change_set(before: DataFrame, after: DataFrame) -> DataFrame:
    """Action per key of two snapshots ``(key, entity, payload, identity)``.

    A changed identity replaces the row, a changed payload updates it.
    """
    b = before.select("key", F.struct("entity", "payload", "identity").alias("b"))
    a = after.select("key", F.struct("entity", "payload", "identity").alias("a"))
    joined = b.join(a, "key", "full_outer")
    replaced = ~F.col("b.identity").eqNullSafe(F.col("a.identity")) | ~F.col("b.entity").eqNullSafe(
        F.col("a.entity")
    )
    action = (
        F.when(F.col("b").isNull(), "create")
        .when(F.col("a").isNull(), "delete")
        .when(replaced, "replace")
        .when(~F.col("b.payload").eqNullSafe(F.col("a.payload")), "update")
        .otherwise("no-op")
    )
    return joined.select(
        "key", F.coalesce("a.entity", "b.entity").alias("entity"), action.alias("action")
    )


def _action_rank(action: Column) -> Column:
    return F.array_position(F.array(*[F.lit(a) for a in S.CHANGE_ACTIONS]), action)


def ordered(changes: DataFrame) -> DataFrame:
    """Changes by redacted key, entity and action order."""
    return changes.withColumn("key", X.redact(F.col("key"))).orderBy(
        "key", "entity", _action_rank(F.col("action"))
    )


def action_counts(changes: DataFrame) -> DataFrame:
    """Count per action, zero-filled, with the two change-set flags.

    The five counts are one aggregation to a single row; the row is then spread
    over the actions.
    """
    counts = [F.count_if(F.col("action") == a).alias(a) for a in S.CHANGE_ACTIONS]
    one = changes.agg(*counts)
    pairs = F.array(
        *[F.struct(F.lit(a).alias("action"), F.col(f"`{a}`").alias("n")) for a in S.CHANGE_ACTIONS]
    )
    total = sum((F.col(f"`{a}`") for a in S.CHANGE_ACTIONS if a != "no-op"), F.lit(0))
    risky = sum((F.col(f"`{a}`") for a in S.DESTRUCTIVE_ACTIONS), F.lit(0))
    return one.select(
        (total > 0).alias("has_changes"), (risky > 0).alias("destructive"), F.inline(pairs)
    )


def row_text(changes: DataFrame) -> Column:
    """Canonical JSON of a row: fields in name order."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(changes.columns)]))


#: distinct rows a leaf of the fingerprint's tree holds on average, at most
LEAF_ROWS = 4096


def fingerprint(
    changes: DataFrame, text: Column | None = None, prefix_chars: int | None = None
) -> DataFrame:
    """Order-free SHA-256 of a change set, independent of partitioning.

    Equal rows are counted before they meet, so any number of copies of one row
    is one entry. Row digests are combined in a tree by digest prefix. Its leaves
    have four hex digits, and two more for each 256 times that the distinct rows
    exceed 65,536 leaves of ``LEAF_ROWS``, so lists stay short however many rows
    there are; every other level joins at most 256 lines.
    """
    digest = F.sha2(row_text(changes) if text is None else text, 256)
    rows = changes.select(digest.alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    if prefix_chars is None:
        rows, prefix_chars = cut_lineage(rows), 4
        distinct = rows.count()
        while distinct > LEAF_ROWS * 16**prefix_chars:
            prefix_chars += 2
    level = rows.select(F.col("d").alias("k"), F.concat_ws(":", "d", "n").alias("line"))
    combined = F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256)
    for width in range(prefix_chars, 0, -2):
        level = (
            level.groupBy(F.substring("k", 1, width).alias("k"))
            .agg(combined.alias("line"))
            .select("k", F.concat_ws(":", "k", "line").alias("line"))
        )
    # at most 256 lines are left; no rows at all give the digest of empty text
    return level.agg(combined.alias("fingerprint"))


def matches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: whether two change sets have the same fingerprint."""
    left = fingerprint(expected).withColumn("side", F.lit("expected"))
    right = fingerprint(actual).withColumn("side", F.lit("actual"))
    return left.unionByName(right).agg((F.count_distinct("fingerprint") <= 1).alias("matches"))


def report_lines(changes: DataFrame) -> DataFrame:
    """Table rows of the change report with escaped cells."""
    return ordered(changes).select(
        F.initcap("action").alias("action"),
        X.markdown_code(F.col("entity")).alias("entity"),
        X.markdown_code(F.col("key")).alias("key"),
    )
