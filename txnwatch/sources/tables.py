"""Writing result tables: append, replace, clustered, snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.operators.keyed import latest_per_key


def append_to_table(df: DataFrame, table: str) -> None:
    """INSERT INTO table SELECT ..., columns matched by name."""
    columns = df.sparkSession.table(table).columns
    df.select(*columns).write.insertInto(table)


def replace_table(df: DataFrame, table: str, fmt: str = "parquet") -> None:
    """CREATE OR REPLACE TABLE table AS SELECT ..."""
    df.write.format(fmt).mode("overwrite").saveAsTable(table)


def append_files(df: DataFrame, path: str, day_column: str | None = None) -> None:
    """Append to a Parquet folder, split by UTC day of ``day_column`` if given."""
    if day_column:
        df = df.withColumn("day", F.to_date(day_column))
        df.write.mode("append").partitionBy("day").parquet(path)
    else:
        df.write.mode("append").parquet(path)


def write_clustered(
    df: DataFrame, table: str, key: str = "user_id", buckets: int = 64, fmt: str = "parquet"
) -> None:
    """Bucketed and sorted by ``key``, so that later joins on it need no shuffle.

    Meant for tables with one row per key; a fact table would put a hot key in one bucket.
    """
    writer = df.repartition(buckets, key).write.format(fmt).mode("overwrite")
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def numbered_folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers N of the complete folders ``path/name=N``, in order."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}=*/_SUCCESS")
    files = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(pattern) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def sync_feature_view(features: DataFrame, path: str, sync_id: int) -> DataFrame:
    """Write the view's rows as the snapshot ``sync_id`` and return them as a table.

    Scoring reads this instead of computing features again. Ids grow; a sync that is run
    again replaces its own snapshot."""
    folder = f"{path.rstrip('/')}/sync={sync_id}"
    features.write.mode("overwrite").parquet(folder)
    return features.sparkSession.read.schema(features.schema).parquet(folder)


def newest_sync(spark: SparkSession, path: str) -> tuple[int | None, DataFrame | None]:
    """Id and rows of the newest sync that was written whole; two times None before the first.

    A sync that is being written, or was cut off, has no success mark and is passed over."""
    syncs = numbered_folders(spark, path.rstrip("/"), "sync")
    if not syncs:
        return None, None
    return syncs[-1], spark.read.parquet(f"{path.rstrip('/')}/sync={syncs[-1]}")


def feature_view(history: DataFrame, key: str = "user_id") -> DataFrame:
    """Newest row per key of an appended feature table."""
    return latest_per_key(history, [key], ["feature_timestamp"])
