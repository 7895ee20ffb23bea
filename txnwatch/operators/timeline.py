"""Running sums along each key's time line, without putting one key into one task.

Rows are grouped by (key, time bucket). Each bucket starts from an opening row that holds
the sum of all earlier buckets. The opening rows come from one row per (key, bucket), which
is reduced before the shuffle, so the only per-key window runs over bucket totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.functions.timing import bucket

OPENING_RANK = -1


def _types(sums: list[str], sum_type: str | dict[str, str]) -> dict[str, str]:
    return sum_type if isinstance(sum_type, dict) else dict.fromkeys(sums, sum_type)


def opening_rows(
    events: DataFrame, key: str, sums: list[str], width: int,
    sum_type: str | dict[str, str] = "bigint",
) -> DataFrame:
    """One row per (key, bucket): sums over all earlier buckets of that key."""
    types = _types(sums, sum_type)
    totals = events.groupBy(key, "bucket").agg(*[F.sum(c).cast(types[c]).alias(c) for c in sums])
    earlier = (
        Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select(
        key,
        "bucket",
        (F.col("bucket") * F.lit(width)).alias("at"),
        F.lit(OPENING_RANK).alias("rank"),
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast(types[c]).alias(c) for c in sums],
    )


def running_sums(
    events: DataFrame, key: str, sums: list[str], width: int,
    sum_type: str | dict[str, str] = "bigint",
) -> DataFrame:
    """Replace each column of ``sums`` by its sum over the key's rows up to (at, rank).

    ``events`` has the columns ``at`` (microseconds) and ``rank`` (order among equal
    times); rows equal in both count together. Other columns pass through. ``sum_type`` is
    one type for all sums or one for each.
    """
    types = _types(sums, sum_type)
    placed = events.withColumn("bucket", bucket(F.col("at"), width))
    opened = placed.unionByName(
        opening_rows(placed, key, sums, width, sum_type), allowMissingColumns=True
    )
    upto = Window.partitionBy(key, "bucket").orderBy("at", "rank")
    passed = [c for c in events.columns if c not in sums]
    return (
        opened.select(*passed, *[F.sum(c).over(upto).cast(types[c]).alias(c) for c in sums])
        .filter(F.col("rank") != OPENING_RANK)
        .select(*events.columns)
    )


def running_max(events: DataFrame, key: str, value: str, width: int) -> DataFrame:
    """Replace ``value`` by its highest value over the key's rows up to (at, rank).

    Grouped like ``running_sums``: each bucket starts from the highest earlier value.
    """
    placed = events.withColumn("bucket", bucket(F.col("at"), width))
    per_bucket = placed.groupBy(key, "bucket").agg(F.max(value).alias(value))
    line = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    opening = per_bucket.select(
        key,
        "bucket",
        (F.col("bucket") * F.lit(width)).alias("at"),
        F.lit(OPENING_RANK).alias("rank"),
        F.max(value).over(line).alias(value),
    )
    upto = Window.partitionBy(key, "bucket").orderBy("at", "rank")
    opened = placed.unionByName(opening, allowMissingColumns=True)
    return (
        opened.withColumn(value, F.max(value).over(upto))
        .filter(F.col("rank") != OPENING_RANK)
        .select(*events.columns)
    )
