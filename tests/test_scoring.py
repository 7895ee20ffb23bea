import pytest
from conftest import as_dicts, tx_row

from txnwatch.operators import reports, scoring
from txnwatch.session import local_rows

FEATURES = (
    "user_id STRING, baseline_tx_count BIGINT, baseline_total_spend DOUBLE, "
    "intraday_tx_count BIGINT, intraday_total_spend DOUBLE"
)


def score_one(spark, make_tx, amount, features=()):
    table = local_rows(spark, list(features), FEATURES)
    return as_dicts(scoring.score(make_tx([tx_row(1, "u", amount)]), table))[0]


def test_no_history_gives_no_alert(spark, make_tx):
    row = score_one(spark, make_tx, 100000.0)
    assert (row["current_15_day_avg"], row["is_alert"], row["reason"]) == (100000.0, False, "")
    assert (row["combined_total_spend"], row["combined_total_count"]) == (0.0, 0)


def test_exactly_twice_the_average_is_no_alert(spark, make_tx):
    # (1000 + 3000 + 2000) / (1 + 1 + 1) = 2000; 1000 + x is twice the average at x = 1000
    history = [("u", 2, 500.0, 1, 500.0)]
    row = score_one(spark, make_tx, 1000.0, history)
    assert row["current_15_day_avg"] == 500.0 and not row["is_alert"]
    row = score_one(spark, make_tx, 1000.01, history)
    assert row["is_alert"]
    assert row["reason"] == (
        "Unusual spend: Amount ($1000.01) is > 2x the 15-day moving average ($500.00)"
    )


def test_alert_needs_more_than_the_minimum_amount(spark, make_tx):
    history = [("u", 10, 10.0, 0, 0.0)]
    assert not score_one(spark, make_tx, 500.0, history)["is_alert"]
    assert score_one(spark, make_tx, 500.01, history)["is_alert"]


def test_missing_amount_is_not_scored(spark, make_tx):
    row = score_one(spark, make_tx, None, [("u", 10, 10.0, 0, 0.0)])
    assert row["current_15_day_avg"] is None and row["is_alert"] is False


def test_user_known_to_one_view_only(spark):
    base = local_rows(
        spark, [("a", 1, 10.0)],
        "user_id STRING, baseline_tx_count BIGINT, baseline_total_spend DOUBLE")
    today = local_rows(
        spark, [("b", 2, 20.0)],
        "user_id STRING, intraday_tx_count BIGINT, intraday_total_spend DOUBLE")
    rows = sorted(tuple(r) for r in scoring.user_features(base, today).collect())
    assert rows == [("a", 1, 10.0, 0, 0.0), ("b", 0, 0.0, 2, 20.0)]


def test_alert_ratio(spark, make_tx):
    alerts = reports.stateless_alerts(make_tx([
        tx_row(1, "known", 60000.0), tx_row(2, "new", 60000.0), tx_row(3, "known", 200.0,
                                                                       country="FR")]))
    table = local_rows(spark, [("known", 3, 250.0, 1, 150.0)], FEATURES)
    got = {r["transaction_id"]: tuple(r)[1:] for r in scoring.alert_ratio(alerts, table).collect()}
    assert got == {
        "t0001": (100.0, 600.0, True, True),
        "t0002": (0.0, 0.0, False, True),
        "t0003": (100.0, 2.0, False, False),
    }


@pytest.mark.parametrize("n", [1, 2])
def test_enriched_alerts_keep_the_newest(spark, make_tx, n):
    rows = [tx_row(i, "u", 60000.0, i) for i in range(3)]
    table = local_rows(spark, [], FEATURES)
    alerts = scoring.enriched_alerts(reports.stateless_alerts(make_tx(rows)), table, n)
    assert sorted(r["transaction_id"] for r in alerts.collect()) == ["t0001", "t0002"][-n:]
