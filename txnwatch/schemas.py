"""Table schemas, descriptions and the fixed thresholds of the rules."""

from pyspark.sql import types as T

# Rule thresholds. The two near-threshold ranges differ on purpose:
# the feature range includes 9000, the graph range does not.
NEAR_THRESHOLD_LOW = 9000.0
NEAR_THRESHOLD_HIGH = 10000.0
LAYERING_MIN_AMOUNT = 5000.0
LARGE_MOVEMENT_AMOUNT = 50000.0
ALERT_COUNTRIES = ("FR", "FRANCE")
SCORE_RATIO = 2.0
SCORE_MIN_AMOUNT = 500.0
SMURFING_MIN_DEPOSITS = 3
BASELINE_DAYS = 14
WINDOW_MINUTES = (15, 30, 60)


def _struct(required: str, **columns: T.DataType) -> T.StructType:
    not_null = set(required.split())
    return T.StructType(
        [T.StructField(name, dtype, name not in not_null) for name, dtype in columns.items()]
    )


_S, _D, _L, _TS = T.StringType(), T.DoubleType(), T.LongType(), T.TimestampType()

RAW_TRANSACTIONS = _struct(
    "transaction_id user_id",
    transaction_id=_S, user_id=_S, amount=_D, timestamp=_TS,
    merchant=_S, category=_S, currency=_S, country=_S,
)

WINDOW_FEATURES = _struct(
    "user_id",
    user_id=_S, tx_count=_L, total_spend=_D, avg_amount=_D,
    distinct_merchants=_L, distinct_countries=_L, max_amount=_D,
    near_threshold_count=_L, last_updated=_TS, window_start=_TS, window_end=_TS,
)

ALERTS = _struct(
    "transaction_id user_id",
    transaction_id=_S, user_id=_S, alert_type=_S, amount=_D, timestamp=_TS,
)

RECOMMENDATIONS = _struct(
    "", user_id=_S, recommendation=_S, status=_S, safety_attributes=_S, generated_at=_TS
)

FEATURE_IDEAS = _struct("", source_table=_S, new_feature_ideas=_S, generated_at=_TS)

BASELINE = _struct(
    "user_id",
    user_id=_S, baseline_tx_count=_L, baseline_total_spend=_D,
    intraday_tx_count=_L, intraday_total_spend=_D, feature_timestamp=_TS,
)

INTRADAY = _struct(
    "", user_id=_S, intraday_tx_count=_L, intraday_total_spend=_D, feature_timestamp=_TS
)

HOURLY_FEATURES = _struct(
    "",
    user_id=_S, tx_count_1h=_L, total_spend_1h=_D, avg_amount_1h=_D, max_amount_1h=_D,
    distinct_merchants_1h=_L, distinct_countries_1h=_L, last_updated=_TS,
)

ACCOUNT_NODES = _struct("", account_id=_S, account_type=_S)
ENTITY_NODES = _struct("", entity_id=_S, entity_type=_S, risk_level=_S)
TRANSACTION_EDGES = _struct(
    "",
    source_account=_S, target_account=_S, amount=_D, timestamp=_TS,
    transaction_id=_S, currency=_S, country=_S,
)
OWNERSHIP_EDGES = _struct("", owner_entity=_S, owned_account=_S, source_doc=_S)

# name -> (schema, description); the description becomes the table comment.
TABLES: dict[str, tuple[T.StructType, str]] = {
    "raw_transactions": (RAW_TRANSACTIONS, "Raw payments, one row per transaction."),
    "user_features_15m": (WINDOW_FEATURES, "Per-user statistics over sliding 15-minute windows."),
    "user_features_30m": (WINDOW_FEATURES, "Per-user statistics over sliding 30-minute windows."),
    "user_features_60m": (WINDOW_FEATURES, "Per-user statistics over sliding 60-minute windows."),
    "user_features": (HOURLY_FEATURES, "Rolling one-hour statistics, one row per user."),
    "aml_alerts": (ALERTS, "Alerts raised from single transactions."),
    "user_recommendations": (RECOMMENDATIONS, "Generated advice and risk notes per user."),
    "feature_ideation": (FEATURE_IDEAS, "Generated ideas for new features per table."),
    "user_baseline_14d": (BASELINE, "Nightly 14-day totals per user."),
    "user_intraday_live": (INTRADAY, "Running totals of the current UTC day per user."),
    "account_nodes": (ACCOUNT_NODES, "Payment graph: accounts."),
    "kyc_entity_nodes": (ENTITY_NODES, "Payment graph: known people and companies."),
    "edges_transactions": (TRANSACTION_EDGES, "Payment graph: transfers between accounts."),
    "edges_kyc_ownership": (OWNERSHIP_EDGES, "Payment graph: who owns which account."),
}
