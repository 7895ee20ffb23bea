"""Catalog tables: create, describe, list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txnwatch.schemas import TABLES
from txnwatch.session import local_rows

_DESCRIPTION_SCHEMA = "table_name STRING, option_name STRING, option_value STRING"


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def create_table(
    spark: SparkSession, name: str, database: str = "default", location: str | None = None
) -> str:
    """Create one of the known tables if it is missing; returns its full name."""
    schema, description = TABLES[name]
    columns = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}"
        for f in schema.fields
    )
    place = f" LOCATION {_quoted(location)}" if location else ""
    full = f"{database}.{name}"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {full} ({columns}) USING parquet"
        f" COMMENT {_quoted(description)}{place}"
    )
    return full


def describe_table(spark: SparkSession, table: str, description: str) -> None:
    spark.sql(f"COMMENT ON TABLE {table} IS {_quoted(description)}")


def table_descriptions(spark: SparkSession, database: str = "default") -> DataFrame:
    """Described tables of a database, one row each."""
    rows = [
        (t.name, "description", t.description)
        for t in spark.catalog.listTables(database)
        if t.description and not t.isTemporary
    ]
    return local_rows(spark, sorted(rows), _DESCRIPTION_SCHEMA)
