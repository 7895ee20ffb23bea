"""Hybrid scoring: 14-day baseline + today's totals + the current transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.functions import rules
from txnwatch.functions.money import money_text
from txnwatch.operators.keyed import fill_zero, top
from txnwatch.schemas import SCORE_MIN_AMOUNT, SCORE_RATIO

FEATURES = {
    "baseline_tx_count": "bigint",
    "baseline_total_spend": "double",
    "intraday_tx_count": "bigint",
    "intraday_total_spend": "double",
}


def user_features(baseline: DataFrame, intraday: DataFrame) -> DataFrame:
    """Both feature views side by side, one row per user known to either; missing -> 0."""
    left = baseline.select("user_id", "baseline_tx_count", "baseline_total_spend")
    right = intraday.select("user_id", "intraday_tx_count", "intraday_total_spend")
    return left.join(right, "user_id", "full").withColumns(fill_zero(FEATURES))


def with_features(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Left lookup of the four features by user; users without features get zeros.

    A plain join: Spark broadcasts the features if their measured size allows, and otherwise
    splits users with very many rows at run time.
    """
    joined = rows.join(features.select("user_id", *FEATURES), "user_id", "left")
    return joined.withColumns(fill_zero(FEATURES))


def score(tx: DataFrame, features: DataFrame) -> DataFrame:
    """Score each transaction against its user's combined history.

    An alert needs an amount above twice the average that includes it, and above 500.
    Rows without an amount get neither average nor alert. Works on batch and streaming
    frames.
    """
    columns = [c for c in ("transaction_id", "user_id", "amount", "timestamp") if c in tx.columns]
    joined = with_features(tx.select(*columns), features)
    amount = F.col("amount")
    spend = F.col("baseline_total_spend") + F.col("intraday_total_spend")
    count = F.col("baseline_tx_count") + F.col("intraday_tx_count")
    average = F.col("current_15_day_avg")
    reason = F.concat(
        F.lit("Unusual spend: Amount ($"),
        money_text(amount),
        F.lit(") is > 2x the 15-day moving average ($"),
        money_text(average),
        F.lit(")"),
    )
    alert = (average > 0) & (amount > average * SCORE_RATIO) & (amount > SCORE_MIN_AMOUNT)
    return (
        joined.withColumn("combined_total_spend", spend)
        .withColumn("combined_total_count", count)
        .withColumn("current_15_day_avg", (F.col("combined_total_spend") + amount)
                    / (F.col("combined_total_count") + 1))
        .withColumn("is_alert", F.coalesce(alert, F.lit(False)))
        .withColumn("reason", F.when(F.col("is_alert"), reason).otherwise(""))
        .select(*columns, "current_15_day_avg", "is_alert", "reason",
                "combined_total_spend", "combined_total_count")
    )


def alert_ratio(alerts: DataFrame, features: DataFrame) -> DataFrame:
    """Alert amount against the user's average without it; 0 if there is no average."""
    joined = with_features(alerts, features)
    spend = F.col("baseline_total_spend") + F.col("intraday_total_spend")
    count = F.col("baseline_tx_count") + F.col("intraday_tx_count")
    average = F.when(count > 0, spend / F.nullif(count, F.lit(0))).otherwise(F.lit(0.0))
    ratio = F.when(F.col("avg15d") > 0, F.col("amount") / F.nullif("avg15d", F.lit(0.0)))
    return (
        joined.withColumn("avg15d", average)
        .withColumn("ratio", ratio.otherwise(F.lit(0.0)))
        .select(
            "transaction_id",
            "avg15d",
            "ratio",
            (F.col("ratio") > 2).alias("over_2x"),
            rules.large_movement().alias("is_high_value"),
        )
    )


def enriched_alerts(alerts: DataFrame, features: DataFrame, n: int = 20) -> DataFrame:
    """Newest ``n`` alerts with the four features of their users."""
    newest = top(alerts, n, F.desc("timestamp"), F.col("transaction_id"))
    return with_features(newest, features)


def hybrid_lookup(recent_users: DataFrame, features: DataFrame) -> DataFrame:
    """Features and combined totals of a short list of users."""
    return (
        with_features(recent_users.select("user_id"), features)
        .withColumn(
            "combined_spend", F.col("baseline_total_spend") + F.col("intraday_total_spend")
        )
        .withColumn("combined_count", F.col("baseline_tx_count") + F.col("intraday_tx_count"))
    )
