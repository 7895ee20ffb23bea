"""Transactions: from the event table, from JSON messages, from JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.schemas import RAW_TRANSACTIONS

COLUMNS = RAW_TRANSACTIONS.fieldNames()
AMOUNT_FACTOR = 150
RECEIVING_USERS = 15
COUNTRY_CODES = ("GB", "US", "DE", "FR", "SG", "AE")


def events_as_transactions(events: DataFrame) -> DataFrame:
    """View an event table as payments; half of the receivers are user accounts."""
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id")
    country = F.element_at(
        F.array(*[F.lit(c) for c in COUNTRY_CODES]),
        (F.pmod(F.col("event_id"), F.lit(len(COUNTRY_CODES))) + 1).cast("int"),
    )
    return events.select(
        F.concat(F.lit("txn_"), F.col("event_id").cast("string")).alias("transaction_id"),
        F.concat(F.lit("user_"), user.cast("string")).alias("user_id"),
        F.round(F.col("value") * AMOUNT_FACTOR, 2).alias("amount"),
        F.col("ts").alias("timestamp"),
        F.when(k < 50, F.concat(F.lit("merchant_"), k.cast("string")))
        .otherwise(F.concat(F.lit("user_"), ((user + k) % RECEIVING_USERS).cast("string")))
        .alias("merchant"),
        F.col("event_type").alias("category"),
        F.lit("GBP").alias("currency"),
        country.alias("country"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_transactions(spark.read.parquet(f"{sf_dir}/events.parquet"))


def encode_messages(tx: DataFrame, *also: str) -> DataFrame:
    """One JSON message (UTF-8 bytes) per transaction, as a message broker carries them, and
    the columns ``also``."""
    when = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")
    fields = [when if c == "timestamp" else F.col(c) for c in COLUMNS]
    return tx.select(F.to_json(F.struct(*fields)).cast("binary").alias("value"), *also)


def decode_messages(messages: DataFrame) -> DataFrame:
    """JSON messages in ``value`` -> transaction columns and ``is_rejected``.

    Bad JSON gives NULL columns instead of an error. Rows without ids or amount are
    marked, because the feature path cannot use them.
    """
    row = F.from_json(F.col("value").cast("string"), _nullable())
    # inline() keeps later filters and projections from parsing the text again per column
    parsed = messages.select(F.inline(F.array(row)))
    return parsed.withColumn("is_rejected", missing_required())


def _nullable() -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in RAW_TRANSACTIONS)


def missing_required(*columns: str) -> Column:
    names = columns or ("transaction_id", "user_id", "amount")
    flag = F.lit(False)
    for name in names:
        flag = flag | F.col(name).isNull()
    return flag


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.filter(~F.col("is_rejected")).drop("is_rejected")


def rejected(decoded: DataFrame) -> DataFrame:
    return decoded.filter("is_rejected").drop("is_rejected")


def rejected_messages(messages: DataFrame) -> DataFrame:
    """The text of messages that the feature path cannot use, for a sink of their own."""
    kept = messages.withColumn("row", F.from_json(F.col("value").cast("string"), _nullable()))
    return kept.select("row.*", F.col("value").cast("string").alias("message")).filter(
        missing_required()
    ).select("message")


def landable(decoded: DataFrame) -> DataFrame:
    """Rows the raw table takes: both ids present, the amount may be missing."""
    return decoded.filter(~missing_required("transaction_id", "user_id")).drop("is_rejected")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited JSON files with the fixed schema (no inference pass)."""
    return spark.read.schema(RAW_TRANSACTIONS).json(path)


def stream_messages(spark: SparkSession, **options: str) -> DataFrame:
    """Unbounded JSON messages from a Kafka topic (needs the Kafka connector package)."""
    return spark.readStream.format("kafka").options(**options).load().select("value")


def stream_message_files(
    spark: SparkSession, path: str, files_per_batch: int | None = None
) -> DataFrame:
    """JSON lines arriving as files, one message per line."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select(F.col("value").cast("binary").alias("value"))


def stream_table(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    """Appends to a table folder as a stream; the query checkpoint holds the position."""
    return spark.readStream.schema(schema).format(fmt).load(path)
