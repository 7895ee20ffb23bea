"""Known laundering patterns, appended to a transaction table to check detection."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.session import local_rows

# Fixed values: (id, sender, amount, minutes after the start, receiver, category).
LAYERING_ROWS = (
    ("plant_1", "Layer_Alice", 6000.0, 0, "Layer_Bob", "P2P_Transfer"),
    ("plant_2", "Layer_Bob", 5900.0, 5, "Layer_Charlie", "P2P_Transfer"),
    ("plant_3", "Layer_Charlie", 5800.0, 10, "Layer_Dave", "P2P_Transfer"),
)
CIRCULAR_ROWS = (
    ("plant_4", "Circ_Eve", 2500.0, 0, "Circ_Frank", "P2P_Transfer"),
    ("plant_5", "Circ_Frank", 2400.0, 2, "Circ_Grace", "P2P_Transfer"),
    ("plant_6", "Circ_Grace", 2300.0, 4, "Circ_Eve", "P2P_Transfer"),
)
OWNER_ROWS = (("plant_7", "Innocent_Retail", 15000.0, 0, "Shady_Shell_Corp", "Investment"),)
# Our own addition: four deposits just below the limit into one account.
SMURFING_ROWS = tuple(
    (f"plant_{7 + i}", f"Smurf_{i}", 9500.0, i, "Sink_1", "P2P_Transfer") for i in range(1, 5)
)
# Entities (id, type, risk) and ownership (owner, account). The documents' names
# are own ones.
ENTITIES = (
    ("Shell_Corp_1", "Company", "Monitor"),
    ("Jane_Doe", "Person", "Low Risk"),
    ("Cartel_Boss", "Person", "High Risk"),
    ("Shady_Shell_Corp", "Company", "High Risk"),
)
OWNERSHIP = (
    ("Jane_Doe", "Shell_Corp_1", "UBO_extracted_from_PDF"),
    ("Cartel_Boss", "Shady_Shell_Corp", "SAR_parsed_from_PDF"),
)

KNOWN_ROWS = LAYERING_ROWS + CIRCULAR_ROWS + OWNER_ROWS


def planted_transactions(
    spark: SparkSession, start: dt.datetime, rows=KNOWN_ROWS, dtype: str = "timestamp_ntz"
) -> DataFrame:
    values = [
        (i, sender, amount, (start + dt.timedelta(minutes=m)).isoformat(sep=" "), to, category)
        for i, sender, amount, m, to, category in rows
    ]
    schema = (
        "transaction_id STRING, user_id STRING, amount DOUBLE, at STRING, merchant STRING, "
        "category STRING"
    )
    return local_rows(spark, values, schema).select(
        "transaction_id",
        "user_id",
        "amount",
        F.col("at").cast(dtype).alias("timestamp"),
        "merchant",
        "category",
        F.lit("USD").alias("currency"),
        F.lit("US").alias("country"),
    )


def inject(tx: DataFrame, planted: DataFrame) -> DataFrame:
    """The table after inserting the planted rows."""
    return tx.unionByName(planted)


def entities(spark: SparkSession, rows=ENTITIES) -> DataFrame:
    return local_rows(spark, rows, "entity_id STRING, entity_type STRING, risk_level STRING")


def ownership(spark: SparkSession, rows=OWNERSHIP) -> DataFrame:
    return local_rows(spark, rows, "owner_entity STRING, owned_account STRING, source_doc STRING")
