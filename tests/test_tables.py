"""Catalog tables, descriptions, appends, snapshots, history files, small reports."""

import datetime as dt
import json

import pytest
from conftest import at, tx_row
from pyspark.sql import functions as F

from txnwatch import schemas
from txnwatch.operators import profile, reports, text
from txnwatch.plans.queries import all_queries
from txnwatch.session import local_rows
from txnwatch.sources import catalog, planted, tables
from txnwatch.sources import transactions as src


@pytest.fixture(scope="module")
def database(spark):
    spark.sql("CREATE DATABASE monitoring")
    for name in schemas.TABLES:
        catalog.create_table(spark, name, "monitoring")
    yield "monitoring"
    spark.sql("DROP DATABASE monitoring CASCADE")


def test_tables_have_their_columns_and_descriptions(spark, database):
    for name, (schema, _) in schemas.TABLES.items():
        created = spark.table(f"{database}.{name}").schema
        assert [(f.name, f.dataType) for f in created] == [(f.name, f.dataType) for f in schema]
    described = {r["table_name"]: r["option_value"] for r in
                 catalog.table_descriptions(spark, database).collect()}
    assert described == {name: text for name, (_, text) in schemas.TABLES.items()}
    # creating again changes nothing
    catalog.create_table(spark, "raw_transactions", database)


def test_a_description_can_be_changed(spark, database):
    catalog.describe_table(spark, f"{database}.aml_alerts", "It's about \\ alerts")
    described = {r["table_name"]: r["option_value"] for r in
                 catalog.table_descriptions(spark, database).collect()}
    assert described["aml_alerts"] == "It's about \\ alerts"
    catalog.describe_table(spark, f"{database}.aml_alerts", schemas.TABLES["aml_alerts"][1])


def test_append_matches_columns_by_name(spark, database, make_tx):
    tx = make_tx([tx_row(1), tx_row(2)]).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    shuffled = tx.select(*reversed(tx.columns))
    tables.append_to_table(shuffled, f"{database}.raw_transactions")
    tables.append_to_table(shuffled, f"{database}.raw_transactions")
    stored = spark.table(f"{database}.raw_transactions")
    assert stored.count() == 4
    assert {r["user_id"] for r in stored.collect()} == {"u"}


def test_replace_table(spark, database):
    name = f"{database}.replaced"
    for n in (3, 2):
        tables.replace_table(spark.range(n), name)
        assert spark.table(name).count() == n


def test_clustered_table_joins_without_a_shuffle(spark, database):
    users = spark.range(100).select(F.concat(F.lit("u"), "id").alias("user_id"), "id")
    for name in ("left_features", "right_features"):
        tables.write_clustered(users, f"{database}.{name}", buckets=4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = spark.table(f"{database}.left_features").join(
            spark.table(f"{database}.right_features"), "user_id"
        )
        assert joined.count() == 100
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_files_are_split_by_day(spark, make_tx, tmp_path):
    path = str(tmp_path / "raw")
    tx = make_tx([tx_row(1, when=at(0)), tx_row(2, when=at(60 * 24))])
    tables.append_files(tx, path, "timestamp")
    tables.append_files(tx, path, "timestamp")
    stored = spark.read.parquet(path)
    assert stored.groupBy("day").count().count() == 2 and stored.count() == 4


def test_feature_view_takes_the_newest_row(spark):
    rows = [("a", 1, dt.datetime(2024, 1, 1)), ("a", 2, dt.datetime(2024, 1, 2)),
            ("b", 3, dt.datetime(2024, 1, 1))]
    df = local_rows(spark, rows, "user_id STRING, n BIGINT, feature_timestamp TIMESTAMP_NTZ")
    got = {r["user_id"]: r["n"] for r in tables.feature_view(df).collect()}
    assert got == {"a": 2, "b": 3}


def test_history_files(spark, tmp_path):
    rows = [dict(zip(src.COLUMNS, tx_row(i))) for i in range(3)]
    for row in rows:
        row["timestamp"] = row["timestamp"].isoformat() + "+00:00"
    (tmp_path / "h.json").write_text("\n".join(json.dumps(r) for r in rows))
    history = src.read_history(spark, str(tmp_path))
    assert history.count() == 3
    assert history.select(F.col("timestamp").cast("timestamp_ntz")).collect()[0][0] == at(0)


def test_injected_rows_are_appended(spark, make_tx):
    tx = make_tx([tx_row(1)])
    rows = planted.planted_transactions(spark, at(0))
    assert rows.count() == 7
    assert planted.inject(tx, rows).count() == 8


def test_column_profile_and_metadata(spark, make_tx):
    tx = make_tx([tx_row(1, amount=None), tx_row(2), tx_row(3)])
    got = {r["column_name"]: tuple(r)[1:] for r in profile.column_profile(tx).collect()}
    assert got["amount"] == (3, 1, 1)
    assert got["transaction_id"] == (3, 0, 3)
    listed = profile.column_metadata(tx, "raw").orderBy("ordinal_position").collect()
    assert [r["column_name"] for r in listed] == tx.columns
    assert tuple(listed[2])[2:] == ("double", "YES", 3)


def test_grounded_prompt_lists_all_columns_in_order(spark, database, make_tx):
    columns = profile.column_metadata(make_tx([]), "raw_transactions")
    prompt = text.grounded_prompt(columns, catalog.table_descriptions(spark, database))
    body = prompt.collect()[0]["prompt"]
    lines = [x for x in body.split("\n") if " | Column: " in x]
    assert [x.split(" | ")[1] for x in lines] == [f"Column: {c}" for c in src.COLUMNS]
    assert body.count(" | Description: ") >= len(schemas.TABLES)


def test_null_audit_and_recent_rows(spark):
    rows = [(f"u{i}", None if i == 3 else f"text {i}", "blocked" if i == 3 else "", at(i))
            for i in range(30)]
    df = local_rows(
        spark, rows,
        "user_id STRING, recommendation STRING, status STRING, generated_at TIMESTAMP_NTZ")
    assert tuple(reports.null_audit(df).collect()[0]) == (30, 1, "blocked")
    recent = [r["user_id"] for r in reports.recent_recommendations(df).collect()]
    assert recent == [f"u{i}" for i in range(29, 9, -1)]


def test_recent_ideas(spark):
    rows = [(f"t{i}", f"idea {i}", at(i)) for i in range(8)]
    df = local_rows(
        spark, rows, "source_table STRING, new_feature_ideas STRING, generated_at TIMESTAMP_NTZ")
    assert [r["source_table"] for r in reports.recent_ideas(df, 5).collect()] == [
        "t7", "t6", "t5", "t4", "t3"]
    assert [r["source_table"] for r in reports.recent_ideas(df, None).collect()] == [
        f"t{i}" for i in range(7, -1, -1)]


def test_recent_ideas_are_all_ideas(spark, small):
    """Both wordings of all four tables, in order (a LIMIT 5 left three out)."""
    got = [tuple(r) for r in all_queries()["recent_ideas"](spark, small).collect()]
    assert len(got) == 8 and got == sorted(got)


def test_feed_rollup_of_nothing(spark):
    df = local_rows(spark, [], "total_spend DOUBLE")
    assert tuple(reports.feed_rollup(df).collect()[0]) == (0.0, 0)
