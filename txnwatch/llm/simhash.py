"""SimHash near-duplicates: pivot distance tables over 64-bit fingerprints.

A fingerprint bit is set if it is set in over half of the hashes of a text's word shingles.
Two fingerprints are linked if at most two bits differ.

Method. Every distinct fingerprint x gets its Hamming distances to 65 reference fingerprints
(the pivots): zero, and for each 16-bit block its fifteen Walsh codes and the full block. By the
triangle inequality linked fingerprints differ by at most two in every coordinate, and since two
changed bits leave at least two of the four blocks alone, their coordinates relative to the zero
pivot are equal for all pivots of some two blocks. So the table is hash-joined on the
coordinates of each pair of blocks, pairs with a coordinate difference over two are discarded,
and the survivors are verified on the fingerprints themselves. Nothing is lost: the coordinates
of a block determine its bits.

Groups of equal coordinates with more than ``max_group`` fingerprints (one text with very many
near copies) would make pairs by the square of their size. Their members are linked another,
equally exact way: each is written under itself and its 64 one-bit neighbours. Fingerprints
within two bits of each other share one of these, and such a group (65 at most) is linked as a
star, as all of its members are within two bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.links import components
from txnwatch.llm.tables import checked, fresh, kept

BLOCKS, WIDTH, SLAB = 4, 16, 1 << 17


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _pivots() -> list[list[int]]:
    """Reference fingerprints of each block: Walsh codes 1 to 15, and all of its bits."""
    codes = [
        sum(1 << i for i in range(WIDTH) if (i & j).bit_count() % 2) for j in range(1, WIDTH)
    ]
    codes.append((1 << WIDTH) - 1)
    return [[_signed(c << WIDTH * b) for c in codes] for b in range(BLOCKS)]


PIVOTS = _pivots()


def fingerprint(text: str | bytes | None, words: int = 3) -> int:
    """Unsigned fingerprint of one text: A-Z lower-cased, shingles with their repeats."""
    raw = text.encode() if isinstance(text, str) else text or b""
    parts = raw.lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        shingles, n = iter([b" ".join(parts)]), 1
    else:
        shingles = map(b" ".join, zip(*(islice(parts, k, None) for k in range(words))))
        n = len(parts) - words + 1
    hashes, set_bits = map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.zeros(64, np.int64)
    for start in range(0, n, SLAB):
        slab = np.fromiter(hashes, dtype=">u8", count=min(SLAB, n - start))
        bits = np.unpackbits(slab.view(np.uint8)).reshape(-1, 64)
        set_bits += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row, whole texts; null texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = [_signed(fingerprint(texts[i].as_py(), words)) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"]
            )

    return docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("binary")
    ).mapInArrow(run, "doc_id long, fp long")


def pivot_distances(fp: F.Column) -> tuple[F.Column, list[list[F.Column]]]:
    """Distance to the zero pivot, and for each block those to its pivots."""
    return F.bit_count(fp), [
        [F.bit_count(fp.bitwiseXOR(F.lit(p))) for p in block] for block in PIVOTS
    ]


def coordinate_difference(x: F.Column, y: F.Column) -> F.Column:
    """Largest difference of two fingerprints' distances to any pivot."""
    (x0, xs), (y0, ys) = pivot_distances(x), pivot_distances(y)
    pairs = [(x0, y0), *zip(sum(xs, []), sum(ys, []))]
    return F.greatest(*(F.abs(a - b) for a, b in pairs))


def links(distinct: DataFrame, max_bits: int = 2, max_group: int = 64) -> DataFrame:
    """Links (a, b) between rows of (fp, rep) with distinct fp, enough of them that two
    fingerprints are connected if and only if a chain of near ones joins them.

    ``max_bits`` of 2 or less, as the join on two of four blocks is complete for no more.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("two equal blocks of four are sure for at most two changed bits")
    zero, far = pivot_distances(F.col("fp"))
    blocks = [F.xxhash64(*(d - zero for d in block)) for block in far]
    signed = distinct.select("fp", "rep", *(b.alias(f"b{i}") for i, b in enumerate(blocks)))
    keys = signed.select(
        "fp",
        "rep",
        F.explode(
            F.array(
                *(
                    F.xxhash64(F.lit(i * BLOCKS + j), f"b{i}", f"b{j}")
                    for i, j in combinations(range(BLOCKS), 2)
                )
            )
        ).alias("key"),
    )
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = kept(keys.join(sizes, "key"), "simhash-groups")
    few = crowded.where(F.col("n") <= max_group)
    pairs = (
        few.select("key", F.col("fp").alias("x"), F.col("rep").alias("a"))
        .join(few.select("key", F.col("fp").alias("y"), F.col("rep").alias("b")), "key")
        .where("x < y")
        .where(coordinate_difference(F.col("x"), F.col("y")) <= max_bits)
        .where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= max_bits)
        .select("a", "b")
    )
    many = crowded.where(F.col("n") > max_group).select("fp", "rep").distinct()
    return pairs.union(_stars(many, max_bits))


def _stars(rows: DataFrame, max_bits: int) -> DataFrame:
    """Links of rows of large groups: all that share a fingerprint within one bit."""
    if max_bits < 2:  # a flipped bit, or none: look the neighbour itself up
        steps = [] if max_bits == 0 else [_signed(1 << i) for i in range(64)]
        near = rows.select(
            F.col("rep").alias("a"),
            F.explode(
                F.array(*(F.col("fp").bitwiseXOR(F.lit(s)) for s in steps)).cast("array<bigint>")
            ).alias("fp"),
        )
        return near.join(rows.withColumnRenamed("rep", "b"), "fp").select("a", "b")
    steps = [0, *(_signed(1 << i) for i in range(64))]
    near = rows.select(
        "rep", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(s)) for s in steps))).alias("z")
    )
    stars = near.groupBy("z").agg(F.min("rep").alias("b"), F.collect_list("rep").alias("all"))
    return stars.where(F.size("all") > 1).select(F.explode("all").alias("a"), "b").where("a <> b")


def near_duplicates(docs: DataFrame, max_bits: int = 2, max_group: int = 64) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text, anything else).

    component_id is the smallest doc_id that links of at most ``max_bits`` reach. Texts that are
    null, empty or without words have fingerprint 0 and are linked like any other. Rows that
    repeat a doc_id get one row each. Rows with a null doc_id take no part in linking and have a
    null component_id. Other columns are not read. An empty table gives an empty result.
    """
    fps = kept(fingerprints(docs), "fingerprints")
    distinct = fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    distinct = kept(distinct, "distinct-fingerprints")
    roots = components(links(distinct, max_bits, max_group))
    by_fp = distinct.join(roots, distinct.rep == roots.node, "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return fps.join(by_fp, "fp", "left").select(
        "doc_id",
        "fp",
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents of which each group of near-duplicates keeps the smallest doc_id; rows
    with a null doc_id are kept, and of rows that repeat the kept doc_id all stay."""
    # an id may have several texts: it stays if one of its rows stands for its group
    found, name = near_duplicates(docs), fresh("gone", docs)
    gone = (
        found.groupBy("doc_id")
        .agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("stays"))
        .where("stays = 0")
        .select(F.col("doc_id").alias(name))
    )
    return docs.join(checked(gone, "near-copies"), F.col("doc_id") == F.col(name), "left_anti")
