"""Timestamps, leases and durations. The clock is always a parameter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_timestamp(moment: Column | dt.datetime | str) -> Column:
    """Accept a column, an aware or naive-UTC datetime, or timestamp text."""
    if isinstance(moment, Column):
        return moment
    if isinstance(moment, dt.datetime):
        if moment.tzinfo is not None:
            moment = moment.astimezone(dt.timezone.utc).replace(tzinfo=None)
        moment = moment.isoformat(sep=" ")
    return F.to_timestamp(F.lit(f"{moment}+00:00" if "+" not in moment else moment))


def utc_timestamp(text: Column) -> Column:
    """ISO-8601 text with an explicit zero offset, null for anything else."""
    shaped = text.rlike(
        r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?"
        r"(Z|[+-]00:00)\z"
    )
    zulu = F.regexp_replace(text, r"-00:00\z", "+00:00")
    return F.when(shaped, F.try_to_timestamp(zulu))


def plus_seconds(moment: Column, seconds: int) -> Column:
    return moment + F.make_dt_interval(secs=F.lit(seconds))


def lease_expired(as_of: Column, lease_expires_at: Column) -> Column:
    """The boundary counts as expired."""
    return as_of >= lease_expires_at


def duration_ms(seconds: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), seconds) * 1000, 3)
