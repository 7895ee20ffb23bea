"""Prefix trie of conversations, with subtree sums by the Euler-tour technique.

A node is a distinct sequence of first turns. Turns are hashed with their place, so a sequence is
known by its length and the exclusive or of its turns' hashes (128 bits), and prefixes need no
walk along a conversation: exclusive ors run within parts of it and are joined across parts.

Nodes are numbered in the order of (depth, parent), so siblings have consecutive numbers. Every
node has an enter and an exit arc; the successor of an arc follows from the node's first child,
whether it is its parent's last child, and its number. The list of arcs is ranked by
contraction: every arc tosses a coin, and arcs that toss heads behind an arc with tails are spliced
out, which takes out a quarter of them in a round whatever the trie looks like; when at most
``LAST`` arcs are left, they are walked, and the spliced ones follow their predecessors in reverse
order. The work of all rounds is some four times that of the first. Sums of leaves and savings
run along the ranked arcs in blocks of equal size, and a node's subtree is the difference between
its exit and its enter arc.

No step holds a node's children or members, a conversation's turns or a long list in one task:
numbers and prefixes carry totals over from one part of a range partitioning to the next, and
a node's long list of members is joined into pieces of text before it is digested piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.llm.tables import buckets, kept

#: Rows a task of the list ranking takes, arcs that are walked at once, and arcs of a block of sums (a power
#: of two).
ROWS, LAST, BLOCK_BITS = 50_000, 1 << 15, 16
KEY = ["depth", "k1", "k2"]
PARENT = ["depth", "p1", "p2"]


def turns(conversations: DataFrame, order: str = "turn") -> DataFrame:
    """(conv_id, pos, h1, h2, bytes) of every row of ``conversations`` (conv_id, turn, role,
    text, anything else): its place from 0 in its conversation, two hashes of role and text, and
    the text's UTF-8 bytes.

    Turns are in the order of ``turn``, null first; ties, repeated rows too, are turns of their
    own, in an order that depends on role and text only. A null role or text is empty; rows with
    a null conv_id are left out.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"),
        F.col(order).alias("turn"),
        *(F.xxhash64(F.lit(k), role, text).alias(f"h{k}") for k in (1, 2)),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    dealt = _dealt(rows, ["conv_id", "turn", "h1", "h2"])
    inside = Window.partitionBy("conv_id", "part").orderBy("at")
    return kept(
        dealt.withColumn("nth", F.row_number().over(inside))
        .join(_before(dealt, F.sum, before=F.count("*")), ["conv_id", "part"])
        .select("conv_id", (F.col("before") + F.col("nth") - 1).alias("pos"), "h1", "h2", "bytes"),
        "trie-turns",
    )


def _dealt(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows in a stored range partitioning by ``order``: ``part`` and ``at`` follow that order."""
    spread = rows.repartitionByRange(buckets(rows.sparkSession), *order)
    return kept(
        spread.sortWithinPartitions(*order).select(
            "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")
        ),
        "trie-dealt",
    )


def _before(dealt: DataFrame, fold: Callable[[str], Column], **totals: Column) -> DataFrame:
    """Totals of a conversation's rows in the parts before each of its parts, folded: one row
    per conversation and part."""
    counts = dealt.groupBy("conv_id", "part").agg(*(t.alias(n) for n, t in totals.items()))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        "conv_id", "part", *(F.coalesce(fold(n).over(earlier), F.lit(0)).alias(n) for n in totals)
    )


def chains(rebuilt: DataFrame) -> DataFrame:
    """Every prefix of one turn or more of every conversation of ``rebuilt`` (as from ``turns``,
    places without gaps): conv_id, its key (depth, k1, k2), the parent's (p1, p2), bytes of the last turn, and
    whether the conversation ends there."""
    salted = rebuilt.select(
        "conv_id", "pos", "bytes", *(F.xxhash64("pos", h).alias(h) for h in ("h1", "h2"))
    )
    dealt = _dealt(salted, ["conv_id", "pos"])
    inside = Window.partitionBy("conv_id", "part").orderBy("at")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    keys = [F.col(f"before{k}").bitwiseXOR(F.bit_xor(f"h{k}").over(upto)) for k in (1, 2)]
    ends = rebuilt.groupBy("conv_id").agg(F.max("pos").alias("last"))
    before = _before(dealt, F.bit_xor, before1=F.bit_xor("h1"), before2=F.bit_xor("h2"))
    whole = (
        dealt.join(before, ["conv_id", "part"])
        .select("conv_id", "pos", "bytes", "h1", "h2", keys[0].alias("k1"), keys[1].alias("k2"))
        .join(ends, "conv_id")
    )
    return kept(
        whole.select(
            "conv_id",
            (F.col("pos") + 1).alias("depth"),
            "k1",
            "k2",
            *(F.col(f"k{k}").bitwiseXOR(F.col(f"h{k}")).alias(f"p{k}") for k in (1, 2)),
            "bytes",
            (F.col("pos") == F.col("last")).alias("ends"),
        ),
        "trie-chains",
    )


def nodes(prefixes: DataFrame, all_ids: DataFrame) -> DataFrame:
    """The trie's nodes, numbered by depth and parent from 0, the root: id, key, parent's key,
    conv_id (smallest member), n_convs, cost (what sharing the last turn saves), n_children,
    first (child), last_of (the parent whose last child it is). ``all_ids``: conv_id of every
    conversation, those without turns too."""
    found = prefixes.groupBy(*KEY).agg(
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.max("bytes").alias("bytes"),
    )
    zero = F.lit(0).cast("long")
    root = all_ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(
        *(zero.alias(c) for c in (*KEY, "p1", "p2")), "conv_id", "n_convs", zero.alias("bytes")
    )
    dealt = _dealt(found.unionByName(root), [*PARENT, "k1", "k2"])
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))
    # one row per part of the range partitioning
    shift = F.coalesce(
        F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    ) - F.col("first_at")
    starts = F.broadcast(kept(parts.select("part", shift.alias("shift")), "trie-parts"))
    cost = (F.col("n_convs") - 1) * F.col("bytes")
    numbered = kept(
        dealt.join(starts, "part").select(
            (F.col("at") + F.col("shift")).alias("id"),
            *KEY, "p1", "p2", "conv_id", "n_convs", cost.alias("cost"),
        ),
        "trie-numbered",
    )
    families = numbered.where("depth > 0").groupBy(*PARENT).agg(
        F.min("id").alias("first"), F.count("*").alias("n_children")
    )
    families = families.select(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), "first", "n_children"
    )
    grown = kept(
        numbered.join(families, KEY, "left").withColumn(
            "n_children", F.coalesce("n_children", F.lit(0))
        ),
        "trie-families",
    )
    lasts = grown.where("n_children > 0").select(
        (F.col("first") + F.col("n_children") - 1).alias("id"), F.col("id").alias("last_of")
    )
    return kept(grown.join(lasts, "id", "left"), "trie-nodes")


def tour(found: DataFrame) -> DataFrame:
    """The Euler tour of ``nodes`` as arcs (id, next): enter 2 * node, exit 2 * node + 1."""
    enter, leave = 2 * F.col("id"), 2 * F.col("id") + 1
    down = F.when(F.col("n_children") > 0, 2 * F.col("first")).otherwise(leave)
    after = (
        F.when(F.col("id") == 0, F.lit(None).cast("long"))
        .when(F.col("last_of").isNotNull(), 2 * F.col("last_of") + 1)
        .otherwise(2 * (F.col("id") + 1))
    )
    arcs = F.array(
        F.struct(enter.alias("id"), down.alias("next")), F.struct(leave.alias("id"), after.alias("next"))
    )
    return found.select(F.inline(arcs))


def _spread(df: DataFrame, rows: int, key: str) -> DataFrame:
    return df.repartition(min(buckets(df.sparkSession), rows // ROWS + 1), key)


def list_ranks(arcs: DataFrame, last: int = LAST) -> DataFrame:
    """(id, pos) of every arc of a list (id, next; the last one's next is null): pos counts the
    arcs before it. Ids are unique, each but the first's is one arc's next; a ring, or arcs that
    are no one list, raise."""
    last = max(last, 1)  # the first arc is never spliced out
    left = kept(arcs.select("id", "next", F.lit(1).cast("long").alias("w")), "rank-list")
    spliced, rows = [], left.count()
    while rows > last:
        heads = F.xxhash64(F.lit(len(spliced)), "id") % 2 != 0
        x = _spread(left.where(~heads), rows, "next")
        y = left.where(heads).select(
            F.col("id").alias("y"), F.col("next").alias("y_next"), F.col("w").alias("y_w")
        )
        met = kept(x.join(_spread(y, rows, "y"), x["next"] == F.col("y"), "full"), "rank-round")
        gone = met.where("id IS NOT NULL AND y IS NOT NULL").select(
            F.col("y").alias("id"), F.col("id").alias("after"), F.col("w").alias("off")
        )
        left = met.select(
            F.coalesce("id", "y").alias("id"),
            F.when(F.col("y").isNotNull(), F.col("y_next")).otherwise(F.col("next")).alias("next"),
            (F.coalesce("w", F.lit(0)) + F.coalesce("y_w", F.lit(0))).alias("w"),
        )
        spliced.append((gone, rows))
        rows = left.count()
        if len(spliced) > 400:
            raise ValueError("the arcs are no one list")
    ranks = kept(_walked(left, last), "rank-walked")
    for gone, rows in reversed(spliced):
        known = _spread(ranks.select(F.col("id").alias("after"), "pos"), rows, "after")
        added = _spread(gone, rows, "after").join(known, "after")
        added = added.select("id", (F.col("pos") + F.col("off")).alias("pos"))
        ranks = kept(ranks.unionByName(added), "rank-ranks")
    return ranks


def _walked(arcs: DataFrame, last: int) -> DataFrame:
    """Ranks of at most ``last`` arcs (id, next, w), walked in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, ids = {}, set()
        for batch in batches:
            for one, following, w in zip(*(c.to_pylist() for c in batch.columns)):
                after[one] = (following, w)
                ids.add(one)
                if len(after) > last:
                    raise ValueError("more arcs than are walked at once")
        if not after:
            return
        starts = ids - {following for following, _ in after.values()}
        if len(starts) != 1:
            raise ValueError("the arcs are no one list")
        at, pos, order, places = starts.pop(), 0, [], []
        while at is not None:
            order.append(at)
            places.append(pos)
            at, w = after.pop(at)
            pos += w
        if after:
            raise ValueError("the arcs are no one list")
        yield pa.RecordBatch.from_arrays([pa.array(order), pa.array(places)], ["id", "pos"])

    return arcs.select("id", "next", "w").coalesce(1).mapInArrow(run, "id long, pos long")


def subtree_sums(found: DataFrame, last: int = LAST) -> DataFrame:
    """(id, n_leaves, saved) of every node: sums over its subtree, its top included, of nodes
    without children and of costs."""
    ranks = list_ranks(tour(found), last)
    own = found.select(
        (2 * F.col("id")).alias("id"), (F.col("n_children") == 0).cast("long").alias("leaf"), "cost"
    )
    placed = kept(
        ranks.join(own, "id", "left").select(
            "id",
            "pos",
            F.shiftright("pos", BLOCK_BITS).alias("block"),
            *(F.coalesce(c, F.lit(0)).alias(c) for c in ("leaf", "cost")),
        ),
        "trie-placed",
    )
    blocks = placed.groupBy("block").agg(*(F.sum(c).alias(c) for c in ("leaf", "cost")))
    # one row per block
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "block", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("leaf", "cost"))
    )
    inside = Window.partitionBy("block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.select(
        "id", "block", *((F.sum(c).over(inside) - F.col(c)).alias(c) for c in ("leaf", "cost"))
    ).join(starts, "block")
    upto = [(F.col(c) + F.col(f"{c}_before")) for c in ("leaf", "cost")]
    # sums never fall along the tour: a node's exit has the larger ones of its two
    return (
        running.select(F.shiftright("id", 1).alias("id"), upto[0].alias("leaf"), upto[1].alias("cost"))
        .groupBy("id")
        .agg(
            (F.max("leaf") - F.min("leaf")).alias("n_leaves"),
            (F.max("cost") - F.min("cost")).alias("saved"),
        )
    )


def end_digests(ends: DataFrame, piece: int = 1000) -> DataFrame:
    """(depth, k1, k2, ends_sha256) for the conversations (depth, k1, k2, conv_id) that end at a
    node: SHA-256 of their decimal ids, ascending, comma-joined. Ids are joined into texts of
    ``piece`` of them where they are sorted; only these meet in one task, which reads them one
    after the other."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, rows = None, None, [], []
        for batch in batches:
            for *at, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (at != key or len(held) == piece):
                    rows.append((*key, first, ",".join(held)))
                    held = []
                if not held:
                    key, first = at, conv_id
                held.append(str(conv_id))
            if len(rows) > 10_000:
                yield _batch(rows, [*KEY, "first", "ids"])
                rows = []
        if held:
            rows.append((*key, first, ",".join(held)))
        if rows:
            yield _batch(rows, [*KEY, "first", "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, rows = None, None, []
        for batch in batches:
            for *at, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if at != key:
                    if key is not None:
                        rows.append((*key, digest.hexdigest()))
                    key, digest = at, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if len(rows) > 10_000:
                yield _batch(rows, [*KEY, "ends_sha256"])
                rows = []
        if key is not None:
            rows.append((*key, digest.hexdigest()))
            yield _batch(rows, [*KEY, "ends_sha256"])

    order = [*KEY, "conv_id"]
    spread = ends.select(*order).repartitionByRange(buckets(ends.sparkSession), *order)
    texts = spread.sortWithinPartitions(*order).mapInArrow(
        joined, "depth long, k1 long, k2 long, first long, ids string"
    )
    together = texts.repartition(buckets(ends.sparkSession), *KEY).sortWithinPartitions(*KEY, "first")
    return together.select(*KEY, "ids").mapInArrow(
        digested, "depth long, k1 long, k2 long, ends_sha256 string"
    )


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)


def rebuilt(own: DataFrame, base: Column, taken: Column) -> DataFrame:
    """Conversations (as from ``turns``) whose first ``taken`` turns are replaced by the first of
    conversation ``base`` (all if it has fewer, none if there is none); both are expressions of
    conv_id. Turns after the first ``taken`` stay. One that has none of either has no rows."""
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    asked = sizes.select("conv_id", base.alias("base"), taken.cast("long").alias("h"))
    known = kept(
        asked.join(sizes.select(F.col("conv_id").alias("base"), "n"), "base", "left").select(
            "conv_id", "base", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("got")
        ),
        "trie-bases",
    )
    longest = known.agg(F.max("h")).first()[0] or 0
    firsts = own.where(F.col("pos") < longest).withColumnRenamed("conv_id", "base")
    lent = known.join(firsts, "base").where("pos < h").select(*own.columns)
    stay = own.join(known, "conv_id").where("pos >= h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "h1", "h2", "bytes"
    )
    return kept(lent.unionByName(stay), "trie-rebuilt")


def trie(rows: DataFrame, all_ids: DataFrame, last: int = LAST) -> DataFrame:
    """One row per node of the prefix trie of ``rows`` (as from ``turns``): conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    ``all_ids`` has the conv_id of each conversation once; one without rows ends at the root.
    An empty table gives an empty result."""
    prefixes = chains(rows)
    found = nodes(prefixes, all_ids)
    ends = prefixes.where("ends").select(*KEY, "conv_id")
    zero = F.lit(0).cast("long")
    turnless = all_ids.join(ends.select("conv_id"), "conv_id", "left_anti")
    ends = ends.unionByName(turnless.select(*(zero.alias(c) for c in KEY), "conv_id"))
    above = found.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"),
        F.col("k1").alias("p1"),
        F.col("k2").alias("p2"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    whole = (
        found.join(subtree_sums(found, last), "id")
        .join(end_digests(ends), KEY, "left")
        .join(above, PARENT, "left")
    )
    nothing = hashlib.sha256(b"").hexdigest()
    return whole.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
