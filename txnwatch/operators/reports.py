"""Alert lists, rankings, summaries and audits over transactions and feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.functions import money, rules
from txnwatch.functions.timing import AsOf, instant, type_of
from txnwatch.operators.keyed import top


def stateless_alerts(tx: DataFrame) -> DataFrame:
    """Alerts decided from single rows; works on batch and streaming frames."""
    return tx.filter(rules.raises_alert()).select(
        "transaction_id",
        "user_id",
        rules.alert_type().alias("alert_type"),
        "amount",
        "timestamp",
    )


def risk_tiers(hourly: DataFrame) -> DataFrame:
    tier = rules.risk_tier(
        F.col("total_spend_1h"), F.col("distinct_countries_1h"), F.col("tx_count_1h")
    )
    return hourly.select(
        "user_id",
        "tx_count_1h",
        "total_spend_1h",
        "distinct_countries_1h",
        tier.alias("risk_level"),
    ).orderBy(F.desc("total_spend_1h"), "user_id")


_LISTED = ("user_id", "distinct_countries_1h", "total_spend_1h", "tx_count_1h")


def multi_country_users(hourly: DataFrame) -> DataFrame:
    return (
        hourly.filter(F.col("distinct_countries_1h") > 1)
        .select(*_LISTED)
        .orderBy(F.desc("distinct_countries_1h"), "user_id")
    )


def suspicious_users(hourly: DataFrame) -> DataFrame:
    return (
        hourly.filter(rules.suspicious(F.col("total_spend_1h"), F.col("distinct_countries_1h")))
        .select(*_LISTED)
        .orderBy(F.desc("total_spend_1h"), "user_id")
    )


def top_spenders(hourly: DataFrame, n: int = 10) -> DataFrame:
    rows = hourly.select("user_id", "total_spend_1h", "tx_count_1h")
    return top(rows, n, F.desc("total_spend_1h"), F.col("user_id"))


def newest_transactions(tx: DataFrame, n: int = 10) -> DataFrame:
    return top(tx, n, F.desc("timestamp"), F.col("transaction_id"))


def live_activity(features: DataFrame, duration: str = "15m", n: int = 5) -> DataFrame:
    """Newest ``n`` feature rows, tagged with their window length."""
    return top(features, n, F.desc("window_end"), F.col("user_id")).select(
        "user_id", "tx_count", "total_spend", "max_amount", F.lit(duration).alias("duration")
    )


def feed_rollup(activity: DataFrame) -> DataFrame:
    return activity.agg(
        F.coalesce(F.max("total_spend"), F.lit(0.0)).alias("top_spend"),
        F.count(F.lit(1)).alias("active_users"),
    )


def recent_users(features: DataFrame, n: int = 5) -> DataFrame:
    """Users with the newest feature rows."""
    last = features.groupBy("user_id").agg(F.max("window_end").alias("last_window"))
    return top(last, n, F.desc("last_window"), F.col("user_id"))


def newest_per_table(tables: dict[str, DataFrame], n: int = 5) -> DataFrame:
    """Newest ``n`` rows of each feature table in one list."""
    parts = [
        top(df, n, F.desc("window_end"), F.col("user_id")).select(
            F.lit(name).alias("table_name"), "user_id", "window_end", "tx_count"
        )
        for name, df in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def category_summary(tx: DataFrame, as_of: AsOf = None, hours: int | None = 1) -> DataFrame:
    """Totals per category over the last ``hours`` (``None``: all rows)."""
    if hours is not None:
        since = instant(as_of, type_of(tx)) - F.expr(f"INTERVAL {hours} HOUR")
        tx = tx.filter(F.col("timestamp") >= since)
    return (
        tx.groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("transaction_count"),
            money.total(F.col("amount")).alias("total_amount"),
            money.mean(F.col("amount")).alias("avg_amount"),
            F.count_distinct("user_id").alias("unique_users"),
        )
        .orderBy(F.desc("total_amount"), "category")
    )


def amount_bands(tx: DataFrame) -> DataFrame:
    return tx.groupBy(rules.amount_band().alias("band")).agg(
        F.count(F.lit(1)).alias("tx_count"), money.total(F.col("amount")).alias("total_amount")
    )


def null_audit(generated: DataFrame, text: str = "recommendation") -> DataFrame:
    """Row count, rows without text, and the status of one of those."""
    missing = F.col(text).isNull()
    return generated.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(missing).alias("null_count"),
        F.min(F.when(missing, F.col("status"))).alias("sample_status"),
    )


def recent_recommendations(generated: DataFrame, n: int = 20) -> DataFrame:
    """Newest ``n`` rows that have a text."""
    rows = generated.filter(F.col("recommendation").isNotNull())
    return top(rows, n, F.desc("generated_at"), F.col("user_id")).select(
        "user_id", "recommendation", "status"
    )


def recent_ideas(generated: DataFrame, n: int | None = 5) -> DataFrame:
    """Newest ``n`` ideas (``None``: all); those of one time in the order of their tables and
    texts."""
    order = [F.desc("generated_at"), F.col("source_table"), F.col("new_feature_ideas")]
    return generated.orderBy(*order) if n is None else top(generated, n, *order)
