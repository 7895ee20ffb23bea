"""Session builder and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def build_session(app: str = "txnwatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # state stores larger than memory live on disk
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder every executor can reach.

    It lies under ``spark.checkpoint.dir``. Only a local session without that setting
    falls back to a temporary folder of the machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="txnwatch-")
    return f"{base.rstrip('/')}/txnwatch/{name}-{uuid.uuid4().hex}"


def local_rows(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A few literal rows as a local relation, whose exact size the planner knows."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    arrow_schema = to_arrow_schema(T._parse_datatype_string(schema))
    arrays = [pa.array(c, t.type) for c, t in zip(columns, arrow_schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow_schema))


def written(df: DataFrame, name: str) -> DataFrame:
    """Store an intermediate result that is read several times, and read it back.

    It is written to the shared folder, so a lost executor does not lose it.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
