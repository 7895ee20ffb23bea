"""Table and column metadata as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.session import local_rows


def column_metadata(df: DataFrame, table_name: str) -> DataFrame:
    """Name, type, nullability and position of each column."""
    rows = [
        (table_name, f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO", i + 1)
        for i, f in enumerate(df.schema.fields)
    ]
    schema = (
        "table_name STRING, column_name STRING, data_type STRING, is_nullable STRING, "
        "ordinal_position INT"
    )
    return local_rows(df.sparkSession, rows, schema)


def column_profile(df: DataFrame) -> DataFrame:
    """Row, null and distinct count per column in one pass over the table.

    Each row becomes one (column, value) pair per column, counted per value before the
    shuffle, so neither a frequent value nor a column of unique values fills one task.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value"))
            for c in df.columns
        ]
    )
    per_value = (
        df.select(F.inline(pairs))
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return per_value.groupBy("column_name").agg(
        F.sum("rows").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("rows"))), F.lit(0)).alias(
            "null_count"
        ),
        F.count("value").alias("distinct_count"),
    )
