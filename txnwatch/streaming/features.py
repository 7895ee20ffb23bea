"""Streaming transformations: event-time windows, day totals, alerts, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.functions import money
from txnwatch.functions.money import dollars
from txnwatch.functions.parts import (
    COUNTRY,
    MERCHANT,
    USED,
    pane_parts,
    part_sums,
    transaction_measures,
)
from txnwatch.functions.timing import minute_of
from txnwatch.operators.features import window_runs
from txnwatch.operators.reports import stateless_alerts
from txnwatch.operators.scoring import score

#: How late rows may come, by their own time, and still count: for windows and for day totals.
DELAY, DAY_DELAY = "1 hour", "1 day"


def timed(tx: DataFrame, delay: str = DELAY) -> DataFrame:
    """Event time from the payload; rows later than ``delay`` behind may be dropped."""
    return tx.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark(
        "timestamp", delay
    )


#: The user of a marker: a row that only moves the watermark.
END_USER = "\x00end"
#: Columns of ``minute_panes``.
PANES = (
    "minute TIMESTAMP, user_id STRING, merchant STRING, country STRING, n BIGINT, known BIGINT, "
    "spend DECIMAL(38,6), near BIGINT, peak DOUBLE"
)


def end_markers(tx: DataFrame, hours: int = 2) -> DataFrame:
    """Two markers for the end of a bounded run of transactions ``tx``, ``hours`` and twice that
    after its last: the second closes the first one's pane, and that pane the last windows.
    ``hours`` must exceed the longest window and the delay of late rows."""
    last = tx.agg(F.max("timestamp").alias("timestamp")).where("timestamp IS NOT NULL")
    times = F.array(*(F.col("timestamp") + F.expr(f"INTERVAL {hours * k} HOURS") for k in (1, 2)))
    own = {"transaction_id": "end", "user_id": END_USER}
    return last.select(F.explode(times).alias("timestamp")).select(
        *(
            F.col(c)
            if c == "timestamp"
            else F.lit(0.0).alias(c)
            if c == "amount"
            else F.lit(own.get(c)).cast("string").alias(c)
            for c in tx.columns
        )
    )


def minute_panes(tx: DataFrame, delay: str = DELAY) -> DataFrame:
    """One-minute panes per (minute, user, merchant, country), for append mode: a busy user
    shrinks before windows.

    There are at most as many panes, and rows of state, as transactions; distinct counts are
    exact and no state row holds a set. A pane is emitted once, when rows of its minute would
    be too late, so panes come in the order of their minutes."""
    rows = timed(tx, delay).select(
        "timestamp", "user_id", "merchant", "country", *transaction_measures()
    )
    keys = [F.window("timestamp", "1 minute"), "user_id", "merchant", "country"]
    panes = rows.groupBy(*keys).agg(*part_sums())
    return panes.withColumn("window", F.window_time("window")).withColumnRenamed("window", "minute")


def runs_of_panes(panes: DataFrame, size: int) -> DataFrame:
    """``features.window_runs`` of a batch of ``minute_panes``. Markers have no windows."""
    minutes = (
        panes.filter(F.col("user_id") != END_USER)
        .select("user_id", minute_of(F.col("minute")).alias("minute"), F.inline(pane_parts()))
        .filter(USED)
        .groupBy("user_id", "minute", "kind", "value")
        .agg(*part_sums())
    )
    return window_runs(minutes, size)


def windows_of_panes(panes: DataFrame, size: int) -> DataFrame:
    """Sliding-window statistics per user from ``minute_panes`` as a streaming aggregation, for
    append mode: windows of ``size`` minutes per (user, kind, value), then windows per user. Its
    state grows with ``size``; ``sinks.start_windows`` keeps none. Markers have no windows."""
    panes = panes.select("minute", "user_id", F.inline(pane_parts())).filter(USED)
    spans = F.window("minute", f"{size} minutes", "1 minute")
    windows = panes.groupBy(spans, "user_id", "kind", "value").agg(*part_sums())
    total = F.when(F.col("known") > 0, dollars(F.col("spend")))
    return (
        windows.groupBy("window", "user_id")
        .agg(
            *part_sums(),
            F.count_if(F.col("kind") == MERCHANT).alias("merchants"),
            F.count_if(F.col("kind") == COUNTRY).alias("countries"),
            # an aggregate, as a filter on the user would go below the watermark
            F.bool_or(F.col("user_id") == END_USER).alias("marker"),
        )
        .where("NOT marker")
        .select(
            "user_id",
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            F.col("n").alias("tx_count"),
            total.alias("total_spend"),
            (total / F.nullif("known", F.lit(0))).alias("avg_amount"),
            F.col("peak").alias("max_amount"),
            F.col("near").alias("near_threshold_count"),
            F.col("merchants").alias("distinct_merchants"),
            F.col("countries").alias("distinct_countries"),
            F.current_timestamp().alias("last_updated"),
        )
    )


def sliding_features_stream(tx: DataFrame, size: int, delay: str = DELAY) -> DataFrame:
    """Sliding-window statistics per user in one query, for append mode. Its state grows with
    ``size``: for long windows or many rows, go through a table of panes (``sinks.start_panes``,
    ``sinks.start_windows``), which also serves several sizes."""
    return windows_of_panes(minute_panes(tx, delay), size)


def intraday_totals_stream(tx: DataFrame, delay: str = DAY_DELAY) -> DataFrame:
    """Running count and spend per user and UTC day; update mode re-emits changed days."""
    return (
        timed(tx, delay)
        .groupBy("user_id", F.window("timestamp", "1 day"))
        .agg(
            F.count(F.lit(1)).alias("intraday_tx_count"),
            money.total(F.col("amount")).alias("intraday_total_spend"),
        )
        .select(
            "user_id",
            F.col("window.start").alias("day"),
            "intraday_tx_count",
            "intraday_total_spend",
        )
    )


def alerts_stream(tx: DataFrame) -> DataFrame:
    """Stateless alerts; append mode."""
    return stateless_alerts(tx)


def score_stream(tx: DataFrame, features: DataFrame) -> DataFrame:
    """Score arriving transactions against one state of a feature table; append mode.

    ``sinks.start_synced_scoring`` follows a view that is synced while the query runs.
    """
    return score(tx, features)
