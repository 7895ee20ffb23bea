"""Row-level rules as column expressions; usable on batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnwatch import schemas as S


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def near_threshold(amount: Column | str = "amount") -> Column:
    a = _col(amount)
    return (a >= S.NEAR_THRESHOLD_LOW) & (a < S.NEAR_THRESHOLD_HIGH)


def structuring_range(amount: Column | str = "amount") -> Column:
    a = _col(amount)
    return (a > S.NEAR_THRESHOLD_LOW) & (a < S.NEAR_THRESHOLD_HIGH)


def large_movement(amount: Column | str = "amount") -> Column:
    return _col(amount) >= S.LARGE_MOVEMENT_AMOUNT


def alert_country(country: Column | str = "country") -> Column:
    return _col(country).isin(*S.ALERT_COUNTRIES)


def raises_alert(amount: Column | str = "amount", country: Column | str = "country") -> Column:
    return large_movement(amount) | alert_country(country)


def alert_type(amount: Column | str = "amount", country: Column | str = "country") -> Column:
    """The amount is looked at first; the last label is for rows outside the alert filter."""
    return (
        F.when(large_movement(amount), "LARGE_MOVEMENT")
        .when(alert_country(country), "JURISDICTION_SCAN")
        .otherwise("MANUAL_REVIEW_SUGGESTION")
    )


def risk_tier(spend: Column, countries: Column, tx_count: Column) -> Column:
    return (
        F.when((spend > 5000) & (countries > 2), "HIGH RISK")
        .when((spend > 2000) | (tx_count > 20), "MEDIUM RISK")
        .otherwise("LOW RISK")
    )


def suspicious(spend: Column, countries: Column) -> Column:
    return (countries > 2) | (spend > 5000)


def text_risk_level(text: Column | str) -> Column:
    body = F.coalesce(_col(text), F.lit(""))

    def mentions(level: str) -> Column:
        return body.contains(f"Risk Assessment: {level}") | body.contains(f"{level} Risk")

    return F.when(mentions("High"), "High").when(mentions("Medium"), "Medium").otherwise("Low")


def amount_band(amount: Column | str = "amount") -> Column:
    """Structuring lies inside the high-value range, so it is tested first."""
    a = _col(amount)
    return (
        F.when(a.between(9000, 9999), "structuring")
        .when(a.between(1, 10), "micro_deposit")
        .when(a.between(500, 15000), "high_value")
        .otherwise("normal")
    )
