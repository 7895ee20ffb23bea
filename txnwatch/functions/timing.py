"""Time helpers that work alike on TIMESTAMP and TIMESTAMP_NTZ columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR

AsOf = dt.datetime | None


def type_of(df: DataFrame, column: str = "timestamp") -> str:
    return df.schema[column].dataType.simpleString()


def instant(as_of: AsOf, dtype: str) -> Column:
    """``as_of`` in the column's own type, so that comparisons reach the file scan."""
    if as_of is None:
        return F.current_timestamp().cast(dtype)
    return F.lit(as_of.isoformat(sep=" ")).cast(dtype)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(value: Column, dtype: str) -> Column:
    return F.timestamp_micros(value).cast(dtype)


def bucket(at: Column, width: int) -> Column:
    """Number of the ``width``-microsecond interval that holds ``at``."""
    return F.floor((at - F.pmod(at, F.lit(width))) / F.lit(width))


def minute_of(ts: Column) -> Column:
    return bucket(micros(ts), MINUTE)


def day_start(ts: Column, dtype: str) -> Column:
    return from_micros(bucket(micros(ts), DAY) * F.lit(DAY), dtype)
