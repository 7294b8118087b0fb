"""Age limits of stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions import times as TM

# fixed values: days to keep per kind of data
RETENTION_DAYS = {
    "objects": 30,
    "noncurrent_versions": 30,
    "logs": 14,
    "logs_long": 30,
    "queue": 4,
    "dead_letters": 14,
}


def retained(df: DataFrame, ts: str, kind: str, as_of) -> DataFrame:
    """Rows young enough to keep; a plain range filter, so it prunes and pushes down."""
    limit = TM.as_timestamp(as_of) - F.make_dt_interval(days=F.lit(RETENTION_DAYS[kind]))
    return df.where(F.col(ts) >= limit)


def expired_dates(df: DataFrame, date: str, kind: str, as_of) -> DataFrame:
    """Whole date partitions past their age."""
    limit = F.date_sub(TM.as_timestamp(as_of).cast("date"), RETENTION_DAYS[kind])
    return df.select(date).where(F.col(date) < limit).distinct()
