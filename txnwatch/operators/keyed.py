"""Per-key helpers: newest row and top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key by ``order`` (compared left to right, then by the other columns).

    An aggregate, not a ranked window: rows are reduced before the shuffle, so a key with
    a third of all rows costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    newest = F.max(F.struct(*order, *rest)).alias("_newest")
    return df.groupBy(*keys).agg(newest).select(*keys, "_newest.*").select(*df.columns)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First ``n`` rows of a total order (each partition keeps at most ``n``)."""
    return df.orderBy(*order).limit(n)


def fill_zero(columns: dict[str, str]) -> dict[str, Column]:
    """Missing features count as zero, in the type named for each column."""
    return {name: F.coalesce(F.col(name), F.lit(0).cast(t)) for name, t in columns.items()}
