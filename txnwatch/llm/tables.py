"""Small helpers all operators here share: tables, words, row counts, buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.session import written

#: Words of a text: runs of anything but ASCII white space. ``bytes.split()`` cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a result that is read more than once to the shared folder and read it back."""
    return written(df, f"llm-{name}")


def buckets(spark: SparkSession, per_partition: int = 1) -> int:
    """How many groups hashed work is split into: it follows ``spark.sql.shuffle.partitions``,
    which is sized with the input."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) * per_partition)


def word_count(text) -> F.Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def checked(df: DataFrame, name: str, max_rows: int = 1_000_000) -> DataFrame:
    """``df`` as a table, marked for broadcast only if it was counted to have at most
    ``max_rows`` rows (a few numbers each, so tens of MB); a larger one is left to be joined by
    shuffling."""
    stored = kept(df, name)
    return F.broadcast(stored) if stored.count() <= max_rows else stored


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores behind it until no column of ``frames`` is called that."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
