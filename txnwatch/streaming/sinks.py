"""Starting streaming queries and keeping current values per key."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from txnwatch.functions.timing import minute_of
from txnwatch.operators.features import expanded_runs
from txnwatch.operators.keyed import latest_per_key
from txnwatch.operators.scoring import FEATURES, score
from txnwatch.schemas import WINDOW_MINUTES
from txnwatch.session import local_rows
from txnwatch.sources.tables import newest_sync, numbered_folders
from txnwatch.sources.transactions import stream_table
from txnwatch.streaming.features import (
    DAY_DELAY,
    DELAY,
    END_USER,
    PANES,
    intraday_totals_stream,
    minute_panes,
    runs_of_panes,
    sliding_features_stream,
)

EVERY_5_SECONDS = {"processingTime": "5 seconds"}
EVERY_MINUTE = {"processingTime": "60 seconds"}
WHAT_IS_THERE = {"availableNow": True}


def append_stream(
    df: DataFrame, path: str, checkpoint: str, trigger: dict[str, Any] = WHAT_IS_THERE
) -> StreamingQuery:
    """Append finished rows to a Parquet folder, exactly once."""
    writer = df.writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start(path)


def append_table_stream(
    df: DataFrame, table: str, checkpoint: str, trigger: dict[str, Any] = WHAT_IS_THERE
) -> StreamingQuery:
    """Append finished rows to a catalog table, which is created if missing."""
    writer = df.writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).toTable(table)


def upsert_stream(
    df: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict[str, Any] = EVERY_5_SECONDS,
    compaction: Compaction | None = None,
) -> StreamingQuery:
    """Keep changed rows per micro-batch in ``path/batch_id=N``.

    A batch writes only what changed, however many keys exist. A batch that is run again
    after a failure replaces its own folder, so nothing is counted twice. With ``compaction``
    the stream itself folds batches into snapshots, every so many batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if compaction and (batch_id + 1) % compaction.every == 0:
            compact(batch.sparkSession, path, compaction.keys, compaction.order, compaction.expire,
                    compaction.buckets)

    writer = df.writeStream.outputMode("update").foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


@dataclass(frozen=True)
class Compaction:
    """How often a stream folds its batches into snapshots, and by what key."""

    keys: list[str]
    order: tuple[str, ...] = ()
    every: int = 100
    expire: bool = False
    buckets: int = 64


def pane_changes(
    spark: SparkSession, path: str, keys: list[str], values: list[str]
) -> DataFrame:
    """The changelog of an accumulating stream: every pane that fired, from the batches of
    ``upsert_stream`` that are still there, with its number among its key's panes (from 1), what
    it adds to the pane before (``added_<value>``) and whether it is the last."""
    folders = [f"{path}/batch_id={n}" for n in numbered_folders(spark, path, "batch_id")]
    fired = spark.read.option("basePath", path).parquet(*folders or [path])
    order = Window.partitionBy(*keys).orderBy("batch_id")
    before = {v: F.coalesce(F.lag(v).over(order), F.lit(0)) for v in values}
    return fired.select(
        *keys,
        "batch_id",
        *values,
        F.row_number().over(order).alias("pane"),
        *((F.col(v) - b).alias(f"added_{v}") for v, b in before.items()),
        F.lead("batch_id").over(order).isNull().alias("is_last"),
    )


def _snapshots(path: str) -> str:
    return f"{path.rstrip('/')}-snapshots"


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _bucket_folders(spark: SparkSession, path: str) -> dict[int, str]:
    """The newest folder of each bucket among complete snapshots."""
    jvm, kept = spark.sparkContext._jvm, _snapshots(path)
    complete = numbered_folders(spark, kept, "upto")
    pattern = jvm.org.apache.hadoop.fs.Path(f"{kept}/upto=*/bucket=*")
    files = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    newest: dict[int, int] = {}
    for found in files.globStatus(pattern) or []:
        place = found.getPath()
        bucket = int(place.getName().split("=")[1])
        upto = int(place.getParent().getName().split("=")[1])
        if upto in complete:
            newest[bucket] = max(upto, newest.get(bucket, upto))
    return {b: f"{kept}/upto={n}/bucket={b}" for b, n in newest.items()}


def _later(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The last batch that snapshots hold, and the batches after it."""
    upto = max(numbered_folders(spark, _snapshots(path), "upto"), default=None)
    batches = numbered_folders(spark, path, "batch_id")
    return upto, [n for n in batches if upto is None or n > upto]


def _updates(
    spark: SparkSession, path: str, later: list[int], buckets: list[int] | None = None
) -> DataFrame:
    """Buckets of the newest snapshots and the batches after them, with their ``batch_id``."""
    held = _bucket_folders(spark, path)
    snapshots = [f for b, f in held.items() if buckets is None or b in buckets]
    folders = [f"{path}/batch_id={n}" for n in later]
    parts = []
    if snapshots:
        parts.append(spark.read.parquet(*snapshots))
    if folders or not held:
        reader = spark.read.option("basePath", path)
        parts.append(reader.parquet(*folders) if folders else reader.parquet(path))
    if not parts:  # no such bucket, and no batch since
        parts.append(spark.read.parquet(*held.values()).limit(0))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def current_values(
    spark: SparkSession, path: str, keys: list[str], order: tuple[str, ...] = ()
) -> DataFrame:
    """Last written row per key: by ``order`` first, then by batch.

    Reads the newest snapshot of every bucket and the batches written after."""
    updates = _updates(spark, path, _later(spark, path)[1])
    return latest_per_key(updates, keys, [*order, "batch_id"]).drop("batch_id")


def current_value(
    spark: SparkSession,
    path: str,
    key: dict[str, Any],
    order: tuple[str, ...] = (),
    buckets: int = 64,
) -> DataFrame:
    """``current_values`` of one key (its columns in the order of the compaction's): reads one
    bucket and the batches written after."""
    names = list(key)
    updates = _updates(spark, path, _later(spark, path)[1], [])
    typed = [F.lit(v).cast(updates.schema[n].dataType).alias(n) for n, v in key.items()]
    bucket = spark.range(1).select(*typed).select(_bucket(names, buckets)).first()[0]
    updates = _updates(spark, path, _later(spark, path)[1], [bucket])
    for name, value in key.items():
        updates = updates.where(F.col(name).eqNullSafe(F.lit(value)))
    return latest_per_key(updates, names, [*order, "batch_id"]).drop("batch_id")


def compact(
    spark: SparkSession,
    path: str,
    keys: list[str],
    order: tuple[str, ...] = (),
    expire: bool = False,
    buckets: int = 64,
) -> list[int]:
    """Fold all batches so far into snapshots, while the stream may go on writing; returns the
    buckets that were rewritten.

    Rows are split into ``buckets`` by a hash of the key (the same number every time), and only
    buckets with a changed key are read and written. A snapshot that was cut off has no success
    mark and is not read. With ``expire``, folders that newer ones hold are deleted; no reader
    that began before may still need them."""
    _, later = _later(spark, path)
    touched: list[int] = []
    if later:
        kept, bucket = _snapshots(path), _bucket(keys, buckets)
        changed = spark.read.option("basePath", path).parquet(*(f"{path}/batch_id={n}" for n in later))
        touched = sorted(r[0] for r in changed.select(bucket).distinct().collect())
        updates = _updates(spark, path, later, touched)
        values = latest_per_key(updates, keys, [*order, "batch_id"]).withColumn("bucket", bucket)
        values = values.repartition("bucket")
        values.write.mode("overwrite").partitionBy("bucket").parquet(f"{kept}/upto={later[-1]}")
    if expire:
        _delete_superseded(spark, path)
    return touched


def _delete_superseded(spark: SparkSession, path: str) -> None:
    upto, _ = _later(spark, path)
    if upto is None:
        return
    jvm, newest = spark.sparkContext._jvm, set(_bucket_folders(spark, path).values())
    pattern = jvm.org.apache.hadoop.fs.Path(f"{_snapshots(path)}/upto=*/bucket=*")
    files = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in files.globStatus(pattern) or []:
        place = found.getPath()
        if f"{_snapshots(path)}/{place.getParent().getName()}/{place.getName()}" not in newest:
            files.delete(place, True)
    for n in numbered_folders(spark, path, "batch_id"):
        if n <= upto:
            files.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={n}"), True)


def start_synced_scoring(
    tx: DataFrame,
    view: str,
    path: str,
    checkpoint: str,
    trigger: dict[str, Any] = EVERY_5_SECONDS,
) -> StreamingQuery:
    """Score arriving transactions against the newest complete sync of a feature view.

    The sync is looked up for every micro-batch, so a running query sees the next one as soon
    as it is whole; before the first one, users have no history. Rows go to
    ``path/batch_id=N`` with the id of the sync they were scored with. A batch that is run again
    replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        sync, features = newest_sync(session, view)
        if features is None:
            types = [f"{name} {kind}" for name, kind in FEATURES.items()]
            features = local_rows(session, [], ", ".join(["user_id string", *types]))
        scored = score(batch, features).withColumn("sync", F.lit(sync).cast("long"))
        scored.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = tx.writeStream.foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def start_sliding_features(
    tx: DataFrame,
    folder: str,
    checkpoint: str,
    delay: str = DELAY,
    trigger: dict[str, Any] = EVERY_MINUTE,
    sizes: tuple[int, ...] = WINDOW_MINUTES,
) -> dict[int, StreamingQuery]:
    """One query and one output folder per window size, all from the same source."""
    return {
        size: append_stream(
            sliding_features_stream(tx, size, delay),
            f"{folder}/user_features_{size}m",
            f"{checkpoint}/user_features_{size}m",
            trigger,
        )
        for size in sizes
    }


def start_panes(
    tx: DataFrame,
    path: str,
    checkpoint: str,
    delay: str = DELAY,
    trigger: dict[str, Any] = EVERY_MINUTE,
) -> StreamingQuery:
    """Minute panes to a Parquet folder: the source is read and reduced once for all sizes."""
    return append_stream(minute_panes(tx, delay), path, checkpoint, trigger)


def _closing(
    size: int, path: str, kept: str, until: dt.datetime | None, as_runs: bool
) -> Callable[[DataFrame, int], None]:
    """Writer of the windows that a batch of panes closes: those that end after the last pane
    start (or ``until``) of earlier batches, and not after the one so far."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, minute = batch.sparkSession, minute_of(F.col("minute"))
        earlier = [n for n in numbered_folders(spark, kept, "batch_id") if n < batch_id]
        known, closed = batch, None
        if earlier:
            before = spark.read.schema(PANES).parquet(f"{kept}/batch_id={max(earlier)}")
            closed = before.agg(F.max(minute)).first()[0]
            known = batch.unionByName(before)
        if until:
            stamp = F.lit(until.replace(tzinfo=dt.timezone.utc))
            last = {"minute": stamp, "user_id": F.lit(END_USER)}
            fields = [
                last.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in batch.schema
            ]
            known = known.unionByName(spark.range(1).select(*fields))
        horizon = known.agg(F.max(minute)).first()[0]
        first, last = F.col("first"), F.lit(horizon).cast("bigint") - size
        if closed is not None:
            first = F.greatest(first, F.lit(closed - size + 1))
        runs = runs_of_panes(known, size).withColumns(
            {"first": first, "last": F.least("last", last)}
        )
        runs = runs.filter("first <= last").withColumn("last_updated", F.current_timestamp())
        windows = runs if as_runs else expanded_runs(runs, size, "timestamp")
        windows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        still = known.filter(minute > horizon - size) if horizon is not None else known
        still.write.mode("overwrite").parquet(f"{kept}/batch_id={batch_id}")

    return write


def read_windows(spark: SparkSession, folder: str, size: int) -> DataFrame:
    """The windows that ``start_windows`` wrote ``as_runs``."""
    runs = spark.read.parquet(f"{folder}/user_features_{size}m").drop("batch_id")
    return expanded_runs(runs, size, "timestamp")


def closed_until(query: StreamingQuery) -> dt.datetime | None:
    """The UTC time before which a finished query took no more rows: its last watermark."""
    marks = [p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in p["eventTime"]]
    return max((dt.datetime.fromisoformat(m.rstrip("Z")) for m in marks), default=None)


def start_windows(
    spark: SparkSession,
    panes: str,
    folder: str,
    checkpoint: str,
    trigger: dict[str, Any] = EVERY_MINUTE,
    sizes: tuple[int, ...] = WINDOW_MINUTES,
    until: dt.datetime | None = None,
    as_runs: bool = False,
) -> dict[int, StreamingQuery]:
    """One query and output folder per window size, all from the folder of ``start_panes``.

    Panes come in the order of their minutes, so a window closes when a pane comes that starts at
    its end or later, or at the UTC time ``until`` before which no pane will come any more. A
    batch computes the windows that it closes by running sums over its panes and those of the last
    ``size`` minutes before, which are kept under ``checkpoint``: nothing grows with the window
    length but the rows written. With ``as_runs`` consecutive windows with equal statistics are
    written as one row, which ``read_windows`` expands. Rows go to
    ``user_features_<size>m/batch_id=N``; a batch that is run again replaces its own folder."""
    table = stream_table(spark, panes, PANES)
    return {
        size: table.writeStream.foreachBatch(
            _closing(size, f"{folder}/user_features_{size}m", f"{checkpoint}/open_{size}m", until, as_runs)
        )
        .option("checkpointLocation", f"{checkpoint}/user_features_{size}m")
        .trigger(**trigger)
        .start()
        for size in sizes
    }


def start_intraday(
    tx: DataFrame,
    path: str,
    checkpoint: str,
    delay: str = DAY_DELAY,
    trigger: dict[str, Any] = EVERY_5_SECONDS,
    compaction: Compaction | None = None,
) -> StreamingQuery:
    """Running totals per user and day. Every trigger fires a pane per changed day, which holds
    all of the day so far; the last one after the watermark."""
    return upsert_stream(intraday_totals_stream(tx, delay), path, checkpoint, trigger, compaction)


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that came too late for a window or day, over the batches the query remembers (100);
    ``late.LateRows`` keeps the counts of all batches."""
    return sum(
        operator.get("numRowsDroppedByWatermark", 0)
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )


def finish(*queries: StreamingQuery) -> None:
    """Wait for queries that stop by themselves; a failure is raised here."""
    for query in queries:
        query.awaitTermination()
