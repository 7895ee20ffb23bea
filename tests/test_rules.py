import pytest
from pyspark.sql import functions as F

from txnwatch.functions import money, replies, rules
from txnwatch.session import local_rows


def evaluate(spark, expression, rows, schema):
    df = local_rows(spark, rows, schema)
    return [r[0] for r in df.select(expression).collect()]


def test_near_threshold_ranges_differ_at_the_lower_edge(spark):
    rows = [(8999.99,), (9000.0,), (9000.01,), (9999.99,), (10000.0,)]
    assert evaluate(spark, rules.near_threshold(), rows, "amount DOUBLE") == [
        False, True, True, True, False]
    assert evaluate(spark, rules.structuring_range(), rows, "amount DOUBLE") == [
        False, False, True, True, False]


def test_alert_type_looks_at_the_amount_first(spark):
    rows = [
        (50000.0, "FR"), (49999.99, "FR"), (1.0, "FRANCE"), (1.0, "fr"), (1.0, "GB"),
        (50000.0, None), (None, "FR"),
    ]
    schema = "amount DOUBLE, country STRING"
    assert evaluate(spark, rules.alert_type(), rows, schema) == [
        "LARGE_MOVEMENT", "JURISDICTION_SCAN", "JURISDICTION_SCAN", "MANUAL_REVIEW_SUGGESTION",
        "MANUAL_REVIEW_SUGGESTION", "LARGE_MOVEMENT", "JURISDICTION_SCAN",
    ]
    kept = local_rows(spark, rows, schema).filter(rules.raises_alert()).count()
    assert kept == 5


def test_risk_tiers(spark):
    rows = [(5001.0, 3, 1), (5001.0, 2, 1), (2000.0, 5, 21), (2000.0, 5, 20)]
    tier = rules.risk_tier(F.col("s"), F.col("c"), F.col("n"))
    assert evaluate(spark, tier, rows, "s DOUBLE, c BIGINT, n BIGINT") == [
        "HIGH RISK", "MEDIUM RISK", "MEDIUM RISK", "LOW RISK"]


def test_amount_bands(spark):
    rows = [(9000.0,), (9999.0,), (9999.5,), (1.0,), (10.0,), (10.5,), (500.0,), (15000.01,)]
    assert evaluate(spark, rules.amount_band(), rows, "amount DOUBLE") == [
        "structuring", "structuring", "high_value", "micro_deposit", "micro_deposit", "normal",
        "high_value", "normal",
    ]


@pytest.mark.parametrize(
    ("text", "level"),
    [("Risk Assessment: High", "High"), ("a High Risk b Medium Risk", "High"),
     ("Medium Risk", "Medium"), ("high risk", "Low"), (None, "Low")],
)
def test_text_risk_level(spark, text, level):
    assert evaluate(spark, rules.text_risk_level("t"), [(text,)], "t STRING") == [level]


def test_money_text(spark):
    rows = [(1234567813.5,), (0.005,), (-0.001,), (-12.345,), (None,), (0.29,), (99.999,)]
    assert evaluate(spark, money.money_text(F.col("x")), rows, "x DOUBLE") == [
        "1234567813.50", "0.01", "0.00", "-12.35", None, "0.29", "100.00"]


def test_exact_totals(spark):
    df = spark.range(1000).select(F.lit(0.1).alias("amount"))
    assert df.agg(money.total(F.col("amount"))).collect()[0][0] == 100.0


def test_response_text_and_broken_responses(spark):
    rows = [
        ('{"candidates":[{"content":{"parts":[{"text":"a"},{"text":"b"}]}}]}',),
        ('{"candidates":[]}',),
        ("not json",),
        (None,),
    ]
    text = replies.response_text(F.col("r"))
    assert evaluate(spark, text, rows, "r STRING") == ["a", None, None, None]


def test_heading_and_summary_fall_back(spark):
    rows = [
        ('```json\n{"heading": "h", "summary": "s"}\n```',),
        ('{"heading": "", "summary": "s"}',),
        ("sorry, no",),
        (None,),
    ]
    parsed = replies.heading_and_summary(F.col("r"), F.lit("H"), F.lit("S"))
    got = [tuple(x) for x in evaluate(spark, parsed, rows, "r STRING")]
    assert got == [("h", "s"), ("H", "s"), ("H", "S"), ("H", "S")]
