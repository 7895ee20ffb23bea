"""Per-user features over batch tables: sliding windows, day totals, rolling hour, baseline.

One user may own a third of all rows. Every operator therefore reduces rows to
(user, minute) or similar before anything is ordered per user.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.functions import money, rules
from txnwatch.functions.parts import (
    AMOUNTS,
    COUNTRY,
    MERCHANT,
    SUMS,
    USED,
    part_sums,
    transaction_parts,
)
from txnwatch.functions.timing import (
    HOUR,
    MINUTE,
    AsOf,
    bucket,
    day_start,
    from_micros,
    instant,
    micros,
    minute_of,
    type_of,
)
from txnwatch.operators.timeline import OPENING_RANK
from txnwatch.schemas import BASELINE_DAYS


def newest_windows(tx: DataFrame, size: int, as_of: dt.datetime, n: int = 5) -> DataFrame:
    """Windows of ``size`` minutes closed at ``as_of``, among them the newest ``n``.

    Every minute of a user with a transaction has a window that ends right after it, so the
    ``n`` newest such minutes bound the windows asked for. They are looked up first (one scan of
    two columns), and windows are built from the transactions they can hold only."""
    dtype, closed = type_of(tx), as_of.replace(second=0, microsecond=0)
    minutes = tx.filter(F.col("timestamp") < instant(closed, dtype)).select(
        "user_id", minute_of(F.col("timestamp")).alias("minute")
    )
    last = minutes.distinct().orderBy(F.desc("minute")).limit(n).agg(F.min("minute")).first()[0]
    ends = dt.datetime(1970, 1, 1) + dt.timedelta(minutes=(last or 0) + 1)
    since = instant(ends - dt.timedelta(minutes=size), dtype)
    return sliding_features(tx.filter(F.col("timestamp") >= since), size).filter(
        F.col("window_end").between(instant(ends, dtype), instant(closed, dtype))
    )


def sliding_features(tx: DataFrame, size: int) -> DataFrame:
    """Statistics per user and sliding window of ``size`` minutes, one window per minute.

    Rows are first reduced to minutes. Instead of copying each minute into ``size``
    windows, every minute marks where its values enter and leave, and a running sum along
    the window starts gives all windows between two marks. A merchant or country marks
    only the windows that its previous minute does not cover, so each window counts it
    once. Windows are written out after the last shuffle, so the shuffled data does not
    grow with ``size``.
    """
    minutes = (
        tx.select(
            "user_id", minute_of(F.col("timestamp")).alias("minute"), F.inline(transaction_parts())
        )
        .filter(USED)
        .groupBy("user_id", "minute", "kind", "value")
        .agg(*part_sums())
    )
    return expanded_runs(window_runs(minutes, size), size, type_of(tx))


def window_runs(minutes: DataFrame, size: int) -> DataFrame:
    """Runs of consecutive windows with equal statistics, one row each: ``first`` and ``last``
    are the minutes in which their first and last window start.

    ``minutes`` has one row per (user_id, minute, kind, value) with the columns of
    ``part_sums``. There are at most two runs per row, whatever the ``size``."""
    minute = F.col("minute")
    same_value = Window.partitionBy("user_id", "kind", "value").orderBy("minute")
    additive = F.col("kind") == AMOUNTS
    opening = minute - (size - 1)
    spans = minutes.select(
        "user_id",
        "minute",
        F.when(additive, opening)
        .otherwise(F.greatest(opening, F.lag("minute").over(same_value) + 1))
        .alias("first"),
        *SUMS,
        (F.col("kind") == MERCHANT).cast("bigint").alias("merchants"),
        (F.col("kind") == COUNTRY).cast("bigint").alias("countries"),
        "peak",
    )
    sums = [*SUMS, "merchants", "countries"]

    def mark(at, signed, peak):
        return F.struct(
            at.alias("at"), *[signed(F.col(c)).alias(c) for c in sums], peak.alias("peak")
        )

    none = F.lit(None).cast("double")
    marks = [mark(F.col("first"), lambda c: c, none), mark(minute + 1, F.negative, none)]
    highest = F.when(
        F.col("peak").isNotNull(), mark(minute, lambda c: F.nullif(c, c), F.col("peak"))
    )
    steps = (
        spans.select("user_id", F.inline(F.array(*marks, highest)))
        .filter("at IS NOT NULL")  # a missing mark; array_compact is evaluated without generated code
        .groupBy("user_id", "at")
        .agg(*[F.sum(c).alias(c) for c in sums], F.max("peak").alias("peak"))
    )
    line = Window.partitionBy("user_id").orderBy("at")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    ahead = line.rangeBetween(0, size - 1)
    states = steps.select(
        "user_id",
        "at",
        F.lead("at").over(line).alias("until"),
        *[F.sum(c).over(upto).alias(c) for c in sums],
        F.max("peak").over(ahead).alias("peak"),
    ).filter(F.col("n") > 0)
    spend = F.when(F.col("known") > 0, money.dollars(F.col("spend")))
    return states.select(
        "user_id",
        F.col("at").alias("first"),
        (F.col("until") - 1).alias("last"),
        F.col("n").alias("tx_count"),
        spend.alias("total_spend"),
        F.when(F.col("known") > 0, spend / F.col("known")).alias("avg_amount"),
        F.col("peak").alias("max_amount"),
        F.col("near").alias("near_threshold_count"),
        F.col("merchants").alias("distinct_merchants"),
        F.col("countries").alias("distinct_countries"),
    )


def expanded_runs(runs: DataFrame, size: int, dtype: str) -> DataFrame:
    """One row per window from ``window_runs``; what all windows of a run share was computed
    once, so a window costs its two times only."""
    rest = [c for c in runs.columns if c not in ("user_id", "first", "last")]
    windows = runs.select("user_id", F.explode(F.sequence("first", "last")).alias("at"), *rest)
    return windows.select(
        "user_id",
        from_micros(F.col("at") * F.lit(MINUTE), dtype).alias("window_start"),
        from_micros((F.col("at") + size) * F.lit(MINUTE), dtype).alias("window_end"),
        *rest,
    )


def latest_windows(features: DataFrame, as_of: AsOf) -> DataFrame:
    """Newest closed window per user from a table of sliding features.

    A user has one row per window end. All columns have a fixed width, so this is a hash
    aggregation that keeps one row per user before the shuffle.
    """
    closed = F.col("window_end") <= instant(as_of, type_of(features, "window_end"))
    rest = [c for c in features.columns if c not in ("user_id", "window_end")]
    return (
        features.filter(closed)
        .groupBy("user_id")
        .agg(F.max("window_end").alias("newest"), *[F.max_by(c, "window_end").alias(c) for c in rest])
        .withColumnRenamed("newest", "window_end")
        .select(*features.columns)
    )


def latest_sliding_features(tx: DataFrame, size: int, as_of: dt.datetime) -> DataFrame:
    """``latest_windows(sliding_features(tx, size), as_of)`` straight from the transactions.

    The newest closed window starts in the user's last minute, or ``size`` minutes before
    ``as_of`` if that is earlier, so only the rows of that one window are aggregated.
    """
    dtype = type_of(tx)
    limit = int(as_of.replace(tzinfo=dt.timezone.utc).timestamp()) // 60
    # a window closed by ``as_of`` cannot hold rows of the minute that is still open
    rows = tx.filter(F.col("timestamp") < instant(as_of.replace(second=0, microsecond=0), dtype))
    rows = rows.select("transaction_id", "user_id", "amount", "merchant", "country",
                       minute_of(F.col("timestamp")).alias("minute"))
    newest = rows.groupBy("user_id").agg(
        F.least(F.max("minute"), F.lit(limit - size)).alias("start")
    )
    inside = rows.join(newest, "user_id").filter(
        (F.col("minute") >= F.col("start")) & (F.col("minute") < F.col("start") + size)
    )
    spent = money.total(F.col("amount"))
    return (
        inside.groupBy("user_id", "start")
        .agg(
            F.count(F.lit(1)).alias("tx_count"),
            spent.alias("total_spend"),
            (spent / F.count("amount")).alias("avg_amount"),
            F.max("amount").alias("max_amount"),
            F.count_if(rules.near_threshold()).alias("near_threshold_count"),
            F.count_distinct("merchant").alias("distinct_merchants"),
            F.count_distinct("country").alias("distinct_countries"),
        )
        .select(
            "user_id",
            from_micros(F.col("start") * F.lit(MINUTE), dtype).alias("window_start"),
            from_micros((F.col("start") + size) * F.lit(MINUTE), dtype).alias("window_end"),
            "tx_count", "total_spend", "avg_amount", "max_amount", "near_threshold_count",
            "distinct_merchants", "distinct_countries",
        )
    )


def multi_window_features(f60: DataFrame, f30: DataFrame, f15: DataFrame) -> DataFrame:
    """Newest 60-minute row per user with the newest 30- and 15-minute rows beside it."""

    def tagged(features: DataFrame, tag: str) -> DataFrame:
        kept = [c for c in features.columns if c not in ("user_id", "window_start", "window_end")]
        return features.select("user_id", *[F.col(c).alias(f"{c}_{tag}") for c in kept])

    return (
        tagged(f60, "60m")
        .join(tagged(f30, "30m"), "user_id", "left")
        .join(tagged(f15, "15m"), "user_id", "left")
    )


def intraday_totals(tx: DataFrame) -> DataFrame:
    """Count and spend per user and UTC day."""
    day = day_start(F.col("timestamp"), type_of(tx))
    return tx.groupBy("user_id", day.alias("day")).agg(
        F.count(F.lit(1)).alias("intraday_tx_count"),
        money.total(F.col("amount")).alias("intraday_total_spend"),
    )


def intraday_features(tx: DataFrame, day: dt.date) -> DataFrame:
    """Totals of one UTC day, one row per user; only that day's rows are read."""
    dtype = type_of(tx)
    begin = dt.datetime.combine(day, dt.time())
    ts = F.col("timestamp")
    today = (ts >= instant(begin, dtype)) & (ts < instant(begin + dt.timedelta(days=1), dtype))
    return intraday_totals(tx.filter(today)).drop("day")


def baseline(tx: DataFrame, as_of: AsOf, include_today: bool = True) -> DataFrame:
    """14-day count and spend per user, with zero intraday columns.

    ``include_today=False`` stops at the UTC midnight before ``as_of``, so that adding
    intraday totals does not count the current day twice.
    """
    dtype = type_of(tx)
    now = instant(as_of, dtype)
    ts = F.col("timestamp")
    rows = tx.filter(ts >= now - F.expr(f"INTERVAL {BASELINE_DAYS} DAY"))
    if not include_today:
        rows = rows.filter(ts < F.date_trunc("day", now).cast(dtype))
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("baseline_tx_count"),
        money.total(F.col("amount")).alias("baseline_total_spend"),
        F.lit(0).cast("bigint").alias("intraday_tx_count"),
        F.lit(0.0).alias("intraday_total_spend"),
    )


def hybrid_features(tx: DataFrame, as_of: dt.datetime, day: dt.date) -> DataFrame:
    """14-day baseline and totals of ``day`` per user, in one pass over the transactions.

    Equal to joining ``baseline`` and ``intraday_features``, which read the table twice.
    """
    dtype = type_of(tx)
    midnight = dt.datetime.combine(day, dt.time())
    since = as_of - dt.timedelta(days=BASELINE_DAYS)
    ts = F.col("timestamp")
    based = ts >= instant(since, dtype)
    today = (ts >= instant(midnight, dtype)) & (
        ts < instant(midnight + dt.timedelta(days=1), dtype)
    )

    def spend(condition):
        whole = F.sum(F.when(condition, money.exact(F.col("amount"))))
        return F.coalesce(money.dollars(whole), F.lit(0.0))

    return (
        tx.filter(based | today)
        .groupBy("user_id")
        .agg(
            F.count_if(based).alias("baseline_tx_count"),
            spend(based).alias("baseline_total_spend"),
            F.count_if(today).alias("intraday_tx_count"),
            spend(today).alias("intraday_total_spend"),
        )
    )


def _presence(tx: DataFrame) -> DataFrame:
    """+1/-1 marks whose running sums are the merchants and countries of the last hour.

    Repeats of a value at most an hour apart form one stretch: it counts from its first
    row until an hour after its last. Repeats inside a minute are reduced before ordering.
    """
    at = micros(F.col("timestamp"))
    named = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.col(column).alias("value"))
            for kind, column in ((MERCHANT, "merchant"), (COUNTRY, "country"))
        ]
    )
    per_minute = (
        tx.select("user_id", at.alias("at"), F.inline(named))
        .filter("value IS NOT NULL")
        .groupBy("user_id", "kind", "value", bucket(F.col("at"), MINUTE).alias("minute"))
        .agg(F.min("at").alias("first"), F.max("at").alias("last"))
    )
    order = Window.partitionBy("user_id", "kind", "value").orderBy("minute")
    gaps = per_minute.select(
        "user_id",
        "kind",
        "first",
        "last",
        F.coalesce(F.col("first") - F.lag("last").over(order) > HOUR, F.lit(True)).alias("begins"),
        F.coalesce(F.lead("first").over(order) - F.col("last") > HOUR, F.lit(True)).alias("ends"),
    )

    def mark(at, rank: int, sign: int):
        counted = [
            F.when(F.col("kind") == kind, F.lit(sign)).otherwise(0).cast("bigint").alias(out)
            for kind, out in ((MERCHANT, "merchants"), (COUNTRY, "countries"))
        ]
        return F.struct(at.alias("at"), F.lit(rank).alias("rank"), *counted)

    begin = F.when(F.col("begins"), mark(F.col("first"), 0, 1))
    finish = F.when(F.col("ends"), mark(F.col("last") + HOUR, 1, -1))
    marks = gaps.select("user_id", F.inline(F.array(begin, finish)))
    return marks.filter("rank IS NOT NULL")  # NULL: a missing mark


def rolling_hour(tx: DataFrame, width: int = 1) -> DataFrame:
    """For every transaction: the user's statistics over the hour up to and including it.

    A row enters at its own time and leaves one hour later, so count, sum and distinct
    counts are running sums over such marks. The marks are grouped by user and ``width``
    minutes (a divisor of 60); a group starts from the sums of the groups before it. The
    highest amount needs three parts: rows of the current group so far, the whole groups
    of the hour before it, and the rows of the group one hour earlier that have not left
    yet.
    """
    if 60 % width:
        raise ValueError("width must divide 60")
    step = width * MINUTE
    events = tx.select(
        "transaction_id", "user_id", micros(F.col("timestamp")).alias("at"), "amount"
    )
    one = F.lit(1).cast("bigint")
    known = F.col("amount").isNotNull().cast("bigint")
    spend = F.coalesce(money.exact(F.col("amount")), F.lit(0).cast(money.EXACT))
    none = F.lit(None).cast("double")

    def mark(at, rank, sign, entering, leaving):
        return F.struct(
            F.lit(rank).alias("rank"), at.alias("at"),
            *[(c if sign > 0 else F.negative(c)).alias(n)
              for n, c in (("n", one), ("known", known), ("spend", spend))],
            entering.alias("entering"), leaving.alias("leaving"),
        )

    amount = F.col("amount")
    marks = events.select(
        "user_id",
        "transaction_id",
        F.inline(
            F.array(
                mark(F.col("at"), 0, 1, amount, none),
                mark(F.col("at") + HOUR, 1, -1, none, amount),
            )
        ),
    ).withColumn("is_row", F.col("rank") == 0)
    marks = marks.unionByName(_presence(tx), allowMissingColumns=True).withColumn(
        "bucket", bucket(F.col("at"), step)
    )

    sums = ["n", "known", "spend", "merchants", "countries"]
    groups = marks.groupBy("user_id", "bucket").agg(
        *[F.sum(c).alias(c) for c in sums], F.max("entering").alias("entering")
    )
    line = Window.partitionBy("user_id").orderBy("bucket")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    opening = groups.select(
        "user_id",
        "bucket",
        (F.col("bucket") * F.lit(step)).alias("at"),
        F.lit(OPENING_RANK).alias("rank"),
        *[F.sum(c).over(before).alias(c) for c in sums],
        F.max("entering").over(line.rangeBetween(1 - 60 // width, -1)).alias("entering"),
    )
    group = Window.partitionBy("user_id", "bucket")
    so_far = group.orderBy("at", "rank")
    from_here = group.orderBy(F.desc("at"), F.desc("rank"))
    states = marks.unionByName(opening, allowMissingColumns=True).select(
        "transaction_id",
        "user_id",
        "is_row",
        *[F.sum(c).over(so_far).alias(c) for c in sums],
        F.greatest(
            F.max("entering").over(so_far), F.max("leaving").over(from_here)
        ).alias("peak"),
    )
    total = F.when(F.col("known") > 0, money.dollars(F.col("spend")))
    return states.filter("is_row").select(
        "transaction_id",
        "user_id",
        F.col("n").alias("tx_count_1h"),
        total.alias("total_spend_1h"),
        F.when(F.col("known") > 0, total / F.col("known")).alias("avg_amount_1h"),
        F.col("peak").alias("max_amount_1h"),
        F.coalesce("merchants", F.lit(0)).alias("distinct_merchants_1h"),
        F.coalesce("countries", F.lit(0)).alias("distinct_countries_1h"),
    )


def hourly_features(tx: DataFrame, as_of: AsOf, hours: int = 24) -> DataFrame:
    """Rolling-hour statistics of each user's last transaction within the last day.

    Equal to the last row per user of ``rolling_hour`` on that input, but only the rows
    of each user's final hour are aggregated.
    """
    dtype = type_of(tx)
    recent = tx.filter(
        F.col("timestamp") >= instant(as_of, dtype) - F.expr(f"INTERVAL {hours} HOUR")
    ).select("transaction_id", "user_id", "timestamp", "amount", "merchant", "country")
    newest = recent.groupBy("user_id").agg(F.max("timestamp").alias("newest"))
    inside = recent.join(newest, "user_id").filter(
        F.col("timestamp") >= F.col("newest") - F.expr("INTERVAL 1 HOUR")
    )
    spent = money.total(F.col("amount"))
    return inside.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("tx_count_1h"),
        spent.alias("total_spend_1h"),
        (spent / F.count("amount")).alias("avg_amount_1h"),
        F.max("amount").alias("max_amount_1h"),
        F.count_distinct("merchant").alias("distinct_merchants_1h"),
        F.count_distinct("country").alias("distinct_countries_1h"),
    )
