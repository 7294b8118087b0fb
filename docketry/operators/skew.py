"""Lookups and ordered windows that keep working when one key is very hot.

A key is *hot* when it holds more than ``share`` of all rows, so there are at
most ``1 / share`` hot keys: the table of hot keys may be broadcast whatever
the size of the input. ``min_rows`` keeps small inputs on the plain plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_SHARE = 1e-5
HOT_MIN_ROWS = 100_000
SALTS = 64
SEGMENT_SECONDS = 60


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key; partial counts are combined before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))


def hot_keys(
    counts: DataFrame,
    keys: Sequence[str],
    share: float = HOT_SHARE,
    min_rows: int = HOT_MIN_ROWS,
) -> DataFrame:
    """Keys above the share, at most ``1 / share`` of them."""
    total = counts.agg(F.sum("__n")).scalar()
    limit = F.greatest(F.lit(float(min_rows)), total * F.lit(share))
    return counts.where(F.col("__n") > limit).select(*keys, F.lit(True).alias("__hot"))


def found_hot_keys(
    counts: DataFrame,
    keys: Sequence[str],
    share: float = HOT_SHARE,
    min_rows: int = HOT_MIN_ROWS,
) -> DataFrame | None:
    """Hot keys as a local table, or None when there is none.

    One counting job over the key columns, run once: its result steers every
    branch, and without hot keys the callers keep their plain plans. The driver
    receives at most ``1 / share`` keys.
    """
    hot = hot_keys(counts, keys, share, min_rows)
    rows = hot.collect()
    return counts.sparkSession.createDataFrame(rows, hot.schema) if rows else None


def _mark_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(F.broadcast(hot), list(keys), "left")


def salted_lookup(
    fact: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    *,
    counts: DataFrame | None = None,
    share: float = HOT_SHARE,
    min_rows: int = HOT_MIN_ROWS,
    salts: int = SALTS,
    few: bool = False,
) -> DataFrame:
    """Left join of a large fact to a table that is unique on ``keys``.

    ``few`` says that the caller has counted the fact and found it small: then
    its keys are broadcast to ``dim``, so a large ``dim`` is filtered where it
    is read and never shuffled.

    Rows of hot keys are spread over ``salts`` partitions by a hash of
    ``spread_by``; only the matching hot rows of ``dim`` are repeated. Rows
    without a key are spread too, they match nothing.
    """
    if counts is None:
        counts = key_counts(fact, keys)
    if few:
        asked = dim.join(F.broadcast(counts.select(*keys)), list(keys), "left_semi")
        return fact.join(asked, list(keys), "left")
    hot = found_hot_keys(counts, keys, share, min_rows)
    if hot is None:
        return fact.join(dim, list(keys), "left")
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(salts)).cast("int")
    left = _mark_hot(fact, hot, keys).withColumn(
        "__salt", F.when(F.col("__hot") | no_key, salt).otherwise(F.lit(0))
    )
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
    right = _mark_hot(dim, hot, keys).withColumn(
        "__salt", F.explode(F.coalesce(every, F.array(F.lit(0))))
    )
    joined = left.drop("__hot").join(right.drop("__hot"), [*keys, "__salt"], "left")
    return joined.drop("__salt")


def with_segments(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    *,
    seconds: int = SEGMENT_SECONDS,
    share: float = HOT_SHARE,
    min_rows: int = HOT_MIN_ROWS,
) -> tuple[DataFrame, bool]:
    """Add ``__seg``: time slices for hot keys, null for every other key.

    The second value tells whether any key was hot.
    """
    hot = found_hot_keys(key_counts(df, keys), keys, share, min_rows)
    if hot is None:
        return df.withColumn("__seg", F.lit(None).cast("long")), False
    slice_no = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))
    cut = (
        _mark_hot(df, hot, keys)
        .withColumn("__seg", F.when(F.col("__hot"), slice_no))
        .drop("__hot")
    )
    return cut, True


def _segment_key(keys: Sequence[str]) -> list[str]:
    return [*keys, "__seg"]


def segmented_lag(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    ts: str,
    **hot_options,
) -> DataFrame:
    """``prev_<value>``: values of the previous row of the same key.

    Inside a slice this is a plain window. The first row of a slice takes the
    last row of the slice before it, from a table with one row per slice.
    """
    rows, cut = with_segments(df, keys, ts, **hot_options)
    if not cut:
        whole = Window.partitionBy(*keys).orderBy(*order)
        for v in values:
            rows = rows.withColumn(f"prev_{v}", F.lag(v).over(whole))
        return rows.drop("__seg")
    current = F.struct(*[F.col(v) for v in values])
    position = F.struct(*[F.col(o) for o in order])
    inside = Window.partitionBy(*_segment_key(keys)).orderBy(*order)
    tails = (
        rows.where(F.col("__seg").isNotNull())
        .groupBy(*_segment_key(keys))
        .agg(F.max_by(current, position).alias("__tail"))
    )
    carry = tails.withColumn(
        "__carry", F.lag("__tail").over(Window.partitionBy(*keys).orderBy("__seg"))
    ).drop("__tail")
    out = rows.withColumn("__prev", F.lag(current).over(inside)).join(
        carry, _segment_key(keys), "left"
    )
    prev = F.coalesce(F.col("__prev"), F.col("__carry"))
    for v in values:
        out = out.withColumn(f"prev_{v}", prev[v])
    return out.drop("__prev", "__carry", "__seg")


def segmented_row_number(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    ts: str,
    name: str,
    **hot_options,
) -> DataFrame:
    """Rank of a row within its key: rank in the slice plus rows of earlier slices."""
    rows, cut = with_segments(df, keys, ts, **hot_options)
    if not cut:
        whole = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumn(name, F.row_number().over(whole).cast("long")).drop("__seg")
    inside = Window.partitionBy(*_segment_key(keys)).orderBy(*order)
    sizes = (
        rows.where(F.col("__seg").isNotNull())
        .groupBy(*_segment_key(keys))
        .agg(F.count(F.lit(1)).alias("__size"))
    )
    earlier = Window.partitionBy(*keys).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__before", F.sum("__size").over(earlier)).drop("__size")
    return (
        rows.withColumn("__rank", F.row_number().over(inside))
        .join(offsets, _segment_key(keys), "left")
        .withColumn(name, F.col("__rank") + F.coalesce(F.col("__before"), F.lit(0)))
        .drop("__rank", "__before", "__seg")
    )


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Column) -> DataFrame:
    """Earliest row per key by aggregation, so a hot key is combined map-side."""
    position = F.struct(*[F.col(o) for o in order])
    return df.groupBy(*keys).agg(F.min_by(payload, position).alias("first"))
