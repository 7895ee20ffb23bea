"""Mixing sources to target weights by systematic sampling.

Sources share a budget of words by weight, water-filled under a cap of copies. Within a source
every document expects target / size copies. Along an order of the documents the expected copies
are prefix-summed, one random offset is added, and a copy is emitted for each integer boundary a
document crosses. The order is by size, so neighbours weigh alike and the words taken are near
the target whatever the sizes; doc_id breaks ties.

The prefix sum never puts a source into one task: rows are range-partitioned by (source, size,
doc_id), which splits a large source evenly, numbered within their partition, and shifted by the
totals of earlier partitions of the source (a table of one row per partition and source in it).
The partitioned rows are a table in the shared folder, as range bounds come from a sample and
must not change between the two readings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from txnwatch.llm.tables import buckets, fresh, kept, word_count

WEIGHTS = (5.0, 2.0, 1.0)


def targets(
    totals: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """(source, source_size, target, offset) from (source, source_size).

    ``share`` times all words are dealt by weight; no target exceeds ``cap`` times its source's
    words, and what is above goes to the others by weight until none is above. With the
    sources in the order of cap per weight, the dealt level is the largest of (budget - caps so
    far) / (weights not yet capped). One row per source passes through one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    ranked = (
        totals.withColumn("rank", F.row_number().over(order) - 1)
        .withColumn(
            "weight",
            F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")),
        )
        .withColumn("cap", F.col("source_size") * F.lit(cap))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
    )
    level = (
        F.sum("source_size").over(everything) * F.lit(share)
        - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    return (
        ranked.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .select(
            "source",
            "source_size",
            F.least("cap", F.col("level") * F.col("weight")).alias("target"),
        )
    )


def offset(source: F.Column, seed: int) -> F.Column:
    """The random offset in [0, 1) of a source: 48 bits of a digest of seed and source."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, source) with its size in words, source_size, target
    of its source, and copies the mix takes of it (taken = copies * size).

    ``keep``: columns of ``docs`` to carry along. A null or empty text has size 0 and is taken
    as often as its source's rate says, for 0 words. A null source is a source of its own, last
    in order. Rows that tie or repeat are each counted and dealt in one order. A source of
    size 0 has target 0 and no copies. An empty table gives an empty result. Reruns agree.
    """
    spark = docs.sparkSession
    light = docs.select(
        *keep,
        F.col("doc_id").alias("_id"),
        F.col("source").alias("_source"),
        word_count(F.col("text")).alias("_size"),
    )
    spread = light.repartitionByRange(buckets(spark), "_source", "_size", "_id")
    # numbered in the order of the sort, from the same start in all rows of a partition
    dealt = spread.sortWithinPartitions("_source", "_size", "_id").select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")
    )
    dealt = kept(dealt, "mix-ordered")
    parts = dealt.groupBy("_source", "_part").agg(
        F.count("*").alias("_rows"), F.sum("_size").alias("_words"), F.min("_at").alias("_first")
    )
    parts = kept(parts, "mix-parts")
    totals = parts.groupBy(F.col("_source").alias("source")).agg(
        F.sum("_words").alias("source_size")
    )
    wanted = targets(totals, weights, share, cap)
    earlier = Window.partitionBy("_source").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        parts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .join(wanted, F.col("_source").eqNullSafe(F.col("source")))
        .select(
            F.col("_source").alias("_s"),
            F.col("_part").alias("_p"),
            (F.col("_before") - F.col("_first")).alias("_shift"),
            "source_size",
            "target",
        )
    )
    ranked = dealt.join(
        starts, (F.col("_part") == F.col("_p")) & F.col("_source").eqNullSafe(F.col("_s"))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank, start = F.col("_at") + F.col("_shift") + 1, offset(F.col("_source"), seed)
    crossed = F.floor(rate * rank + start) - F.floor(rate * (rank - 1) + start)
    return ranked.select(
        *keep,
        F.col("_size").alias("size"),
        "source_size",
        "target",
        # a rate at the cap can cross one boundary too many by rounding alone
        F.least(crossed, F.lit(int(-(-cap // 1)))).cast(T.LongType()).alias("copies"),
    )


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with its columns unchanged,
    numbered in a last column ``copy`` (``copy_`` if there is a column of that name, and so on)."""
    name = fresh("copy", docs)
    whole = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "doc_id", "text", "source"
    )
    taken = mix(whole, keep=["doc"], **options).where("copies > 0")
    return taken.select("doc.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(name))
