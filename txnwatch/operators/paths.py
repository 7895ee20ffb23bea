"""Multi-hop patterns over transfer edges: layering chains and circular transfers.

Three forms are offered, because the number of chains through a busy account grows with
the product of its in- and outgoing transfers:

* counts per end account, computed with running sums: cost grows with the edges only;
* the first ``k`` chains of a total order, which expands only chains that can be in it;
* all chains, where every intermediate row is part of at least one result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.functions.money import EXACT, dollars, exact
from txnwatch.functions.timing import HOUR, MINUTE, bucket, micros
from txnwatch.operators.keyed import top
from txnwatch.operators.timeline import running_max, running_sums
from txnwatch.schemas import LAYERING_MIN_AMOUNT
from txnwatch.session import written

WIDE = "decimal(38,0)"
_FIELDS = ("id", "src", "dst", "amount", "at", "currency")


def _edges(transfers: DataFrame) -> DataFrame:
    """The columns the patterns need; an edge without both ends or a time joins nothing."""
    return transfers.select(
        F.col("transaction_id").alias("id"),
        F.col("source_account").alias("src"),
        F.col("target_account").alias("dst"),
        "amount",
        micros(F.col("timestamp")).alias("at"),
        "currency",
    ).filter("src IS NOT NULL AND dst IS NOT NULL AND at IS NOT NULL")


def _named(edges: DataFrame, hop: int) -> DataFrame:
    return edges.select(*[F.col(c).alias(f"{c}{hop}") for c in _FIELDS])


def _first_hops(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("amount") > LAYERING_MIN_AMOUNT)


# Counting -------------------------------------------------------------------------------


Types = str | dict[str, str]


def _gathered(line: DataFrame, sums: list[str], sum_type: Types) -> DataFrame:
    """Asking rows (rank 0) with the sums of the giving rows (rank 1) of their account that
    lie strictly before them on the line."""
    summed = running_sums(line, "account", sums, MINUTE, sum_type)
    return summed.filter((F.col("rank") == 0) & (F.col(sums[0]) > 0)).select("edge.*", *sums)


def _giving(end: str, sign: int, sums: dict[str, Column]) -> list[Column]:
    return [
        F.col(end).alias("account"),
        (F.col("at") * sign).alias("at"),
        F.lit(1).alias("rank"),
        *[c.alias(name) for name, c in sums.items()],
    ]


def _asking(end: str, sign: int, sums: list[str], sum_type: Types, kept: tuple[str, ...]):
    types = sum_type if isinstance(sum_type, dict) else dict.fromkeys(sums, sum_type)
    return [
        F.col(end).alias("account"),
        (F.col("at") * sign).alias("at"),
        F.lit(0).alias("rank"),
        *[F.lit(0).cast(types[name]).alias(name) for name in sums],
        F.struct(*kept).alias("edge"),
    ]


def _both_roles(edges: DataFrame, giving: list[Column], gives: Column, asking: list[Column],
                kept: tuple[str, ...]) -> DataFrame:
    """Each edge as an asking row and, where ``gives`` holds, as a giving row: one scan."""
    nothing = F.when(F.lit(False), F.struct(*kept)).alias("edge")
    roles = F.array(F.struct(*asking), F.when(gives, F.struct(*giving, nothing)))
    return edges.select(F.inline(F.array_compact(roles)))


def chains_per_first_hop(transfers: DataFrame) -> DataFrame:
    """First-hop edges that start at least one layering chain, with their number of chains."""
    edges = _edges(transfers)
    sums, end = ["chains"], ("src", "at")
    one = F.lit(1).cast("bigint")
    later = _both_roles(
        edges, _giving("src", -1, {"chains": one}), F.lit(True),
        _asking("dst", -1, sums, "bigint", end), end,
    )
    second = _gathered(later, sums, "bigint")
    wide = {"chains": F.col("chains").cast(WIDE)}
    line = _first_hops(edges).select(*_asking("dst", -1, sums, WIDE, _FIELDS)).unionByName(
        second.select(*_giving("src", -1, wide)), allowMissingColumns=True
    )
    return _gathered(line, sums, WIDE)


def chains_per_last_hop(transfers: DataFrame) -> DataFrame:
    """Last-hop edges that end at least one layering chain, with the number of chains and
    the sum of their first amounts."""
    edges = _edges(transfers)
    sums, end = ["chains", "first_sum"], ("dst", "at")
    narrow = {"chains": "bigint", "first_sum": EXACT}
    types = {"chains": WIDE, "first_sum": EXACT}
    values = {"chains": F.lit(1).cast("bigint"), "first_sum": exact(F.col("amount"))}
    earlier = _both_roles(
        edges, _giving("dst", 1, values), F.col("amount") > LAYERING_MIN_AMOUNT,
        _asking("src", 1, sums, narrow, end), end,
    )
    second = _gathered(earlier, sums, narrow)
    wide = {c: F.col(c).cast(t) for c, t in types.items()}
    line = edges.select(*_asking("src", 1, sums, types, ("dst",))).unionByName(
        second.select(*_giving("dst", 1, wide)), allowMissingColumns=True
    )
    return _gathered(line, sums, types)


def layering_sources(transfers: DataFrame) -> DataFrame:
    """Chains and summed first amounts per account that starts them."""
    hops = chains_per_first_hop(transfers)
    weighted = (exact(F.col("amount")) * F.col("chains")).cast(EXACT)
    return hops.groupBy(F.col("src").alias("first_account")).agg(
        F.sum("chains").cast(WIDE).alias("paths"),
        dollars(F.sum(weighted)).alias("total_first_amount"),
    )


def layering_sinks(transfers: DataFrame) -> DataFrame:
    """Chains and summed first amounts per account that ends them."""
    hops = chains_per_last_hop(transfers)
    return hops.groupBy(F.col("dst").alias("last_account")).agg(
        F.sum("chains").cast(WIDE).alias("paths"),
        dollars(F.sum("first_sum")).alias("total_first_amount"),
    )


# Layering chains ------------------------------------------------------------------------

LAYERING_COLUMNS = (
    "account_a", "account_b", "account_c", "account_d",
    "transaction_1", "transaction_2", "transaction_3",
    "amount_1", "amount_2", "amount_3", "currency_1", "currency_2", "currency_3",
)


def _chain_columns(chains: DataFrame) -> DataFrame:
    return chains.select(
        F.col("src1").alias("account_a"),
        F.col("dst1").alias("account_b"),
        F.col("dst2").alias("account_c"),
        F.col("dst3").alias("account_d"),
        *[F.col(f"id{i}").alias(f"transaction_{i}") for i in (1, 2, 3)],
        *[F.col(f"amount{i}").alias(f"amount_{i}") for i in (1, 2, 3)],
        *[F.col(f"currency{i}").alias(f"currency_{i}") for i in (1, 2, 3)],
    )


def _last_out(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("dst2")).agg(F.max("at").alias("last_out"))


def _follow(
    left: DataFrame, right: DataFrame, hop: int, max_gap: int | None, closing: bool = False
) -> DataFrame:
    """Join transfer ``hop`` to transfer ``hop + 1`` through the shared account, in time
    order. A gap limit (microseconds) also splits each account by time. A ``closing`` transfer
    goes back to where the first came from."""
    early, late = F.col(f"at{hop}"), F.col(f"at{hop + 1}")
    shared = F.col(f"dst{hop}") == F.col(f"src{hop + 1}")
    if closing:
        shared = shared & (F.col(f"dst{hop + 1}") == F.col("src1"))
    if max_gap is None:
        return left.join(right, shared & (early < late))
    slot = bucket(early, max_gap)
    left = left.withColumn("_slot", F.explode(F.array(slot, slot + 1)))
    right = right.withColumn("_late_slot", bucket(late, max_gap))
    near = (F.col("_slot") == F.col("_late_slot")) & (late - early <= max_gap)
    return left.join(right, shared & near & (early < late)).drop("_slot", "_late_slot")


def layering_chains(transfers: DataFrame, max_gap: int | None = None) -> DataFrame:
    """All chains a -> b -> c -> d in time order whose first amount exceeds the minimum.

    Middle transfers are kept only if some first transfer precedes and some last transfer
    follows them, so without a gap limit each joined pair is part of a result row. Hot
    accounts are split by Spark's skew-join handling, as no later step needs the join's
    partitioning.
    """
    edges = _edges(transfers)
    first_in = (
        _first_hops(edges)
        .groupBy(F.col("dst").alias("src2"))
        .agg(F.min("at").alias("first_in"))
    )
    middle = _named(edges, 2).join(first_in, "src2").filter("at2 > first_in")
    middle = middle.join(_last_out(edges), "dst2").filter("at2 < last_out")
    begun = _follow(_named(_first_hops(edges), 1), middle, 1, max_gap)
    return _chain_columns(_follow(begun, _named(edges, 3), 2, max_gap))


def layering_top(transfers: DataFrame, k: int = 100) -> DataFrame:
    """First ``k`` chains by first amount (descending), then by the three ids.

    No chains are counted. A transfer starts a chain if it comes before the last transfer of
    its receiver that some transfer follows: two maximum aggregates. Each of the first ``k``
    starts, and then each of their first ``k`` pairs in order, has a chain, so no others are
    needed, and the broadcast sides hold at most ``k`` rows.
    """
    edges = _edges(transfers)
    followed = _named(edges, 2).join(_last_out(edges), "dst2").filter("at2 < last_out")
    last_start = followed.groupBy(F.col("src2").alias("dst1")).agg(F.max("at2").alias("last_start"))
    starts = _named(_first_hops(edges), 1).join(last_start, "dst1").filter("at1 < last_start")
    starts = top(starts.drop("last_start"), k, F.desc("amount1"), F.col("id1"))
    pairs = followed.drop("last_out").join(
        F.broadcast(starts),
        (F.col("src2") == F.col("dst1")) & (F.col("at2") > F.col("at1")),
    )
    pairs = top(pairs, k, F.desc("amount1"), F.col("id1"), F.col("id2"))
    third = _named(edges, 3).join(
        F.broadcast(pairs),
        (F.col("src3") == F.col("dst2")) & (F.col("at3") > F.col("at2")),
    )
    return top(
        _chain_columns(third),
        k,
        F.desc("amount_1"),
        *[F.col(f"transaction_{i}") for i in (1, 2, 3)],
    )


# Circular transfers ---------------------------------------------------------------------


def _account_pairs(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) with first and last transfer time."""
    return edges.groupBy("src", "dst").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at")
    )


def _closed_walks(pairs: DataFrame) -> DataFrame:
    """Account triples (a, b, c) with transfers a -> b, b -> c and c -> a.

    Each closed walk is searched from its account with the fewest partners, which bounds
    the two-step paths that have to be tried, also around accounts with very many partners.
    """
    ends = pairs.select("src", "dst")
    degree = (
        ends.select(F.explode(F.array("src", "dst")).alias("account"))
        .groupBy("account")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def ranked(end: str) -> DataFrame:
        return degree.select(
            F.col("account").alias(end), F.struct("n", "account").alias(f"{end}_rank")
        )

    placed = ends.join(ranked("src"), "src").join(ranked("dst"), "dst")
    onward = placed.filter("src_rank <= dst_rank").select(
        F.col("src").alias("root"), F.col("dst").alias("next")
    )
    inward = placed.filter("dst_rank <= src_rank").select(
        F.col("dst").alias("root"), F.col("src").alias("prev")
    )
    closing = ends.select(F.col("src").alias("next"), F.col("dst").alias("prev"))
    walks = onward.join(inward, "root").join(closing, ["next", "prev"])
    rotations = [("root", "next", "prev"), ("next", "prev", "root"), ("prev", "root", "next")]
    triples = F.array(
        *[F.struct(*[F.col(c).alias(n) for c, n in zip(r, "abc")]) for r in rotations]
    )
    return walks.select(F.inline(triples)).distinct()


def _inner_pairs(edges: DataFrame) -> DataFrame:
    """Account pairs whose both ends send and receive; only these can lie on a cycle.

    Read several times below, and far smaller than the edges, so it is written once.
    """
    pairs = _account_pairs(edges)
    roles = F.array(
        F.struct(F.col("src").alias("account"), F.lit(True).alias("sends")),
        F.struct(F.col("dst").alias("account"), F.lit(False).alias("sends")),
    )
    both = (
        edges.select(F.inline(roles))
        .groupBy("account")
        .agg(F.bool_or("sends").alias("sends"), F.bool_and("sends").alias("only_sends"))
        .filter("sends AND NOT only_sends")
    )
    inner = pairs.join(both.select(F.col("account").alias("src")), "src", "left_semi").join(
        both.select(F.col("account").alias("dst")), "dst", "left_semi"
    )
    return written(inner, "account_pairs")


def _timed_walks(edges: DataFrame) -> DataFrame:
    """Closed walks (a, b, c) that hold at least one cycle in time order.

    With the first time on a -> b, the last time on c -> a, and the latest time on b -> c
    before that last time. A cycle exists if that latest time follows the first one. The
    latest time is looked up on the pair's time line, without joining walks to transfers.
    """
    inner = _inner_pairs(edges)
    opening = inner.select(F.col("src").alias("a"), F.col("dst").alias("b"), "first_at")
    closing = inner.select(F.col("src").alias("c"), F.col("dst").alias("a"), "last_at")
    walks = (
        _closed_walks(inner)
        .join(opening, ["a", "b"])
        .join(closing, ["c", "a"])
        .filter("first_at < last_at")
    )
    asking = walks.select(
        F.struct("b", "c").alias("pair"),
        F.col("last_at").alias("at"),
        F.lit(0).alias("rank"),
        F.lit(None).cast("bigint").alias("latest"),
        F.struct("a", "b", "c", "first_at", "last_at").alias("walk"),
    )
    given = edges.select(
        F.struct(F.col("src").alias("b"), F.col("dst").alias("c")).alias("pair"),
        "at",
        F.lit(1).alias("rank"),
        F.col("at").alias("latest"),
    )
    line = asking.unionByName(given, allowMissingColumns=True)
    timed = running_max(line, "pair", "latest", MINUTE).filter(F.col("rank") == 0)
    return timed.select("walk.*", "latest").filter("latest > first_at")


def _middle(edges: DataFrame, walks: DataFrame) -> DataFrame:
    """Transfers b -> c that fit between a first and a last transfer of a walk: every one
    is part of a cycle."""
    return _named(edges, 2).join(
        walks,
        (F.col("src2") == F.col("b"))
        & (F.col("dst2") == F.col("c"))
        & (F.col("at2") > F.col("first_at"))
        & (F.col("at2") < F.col("last_at")),
    )


def _closed(middle: DataFrame, edges: DataFrame) -> DataFrame:
    first = _named(edges, 1)
    last = _named(edges, 3)
    cycles = middle.join(
        first,
        (F.col("src1") == F.col("a")) & (F.col("dst1") == F.col("b"))
        & (F.col("at1") < F.col("at2")),
    ).join(
        last,
        (F.col("src3") == F.col("c")) & (F.col("dst3") == F.col("a"))
        & (F.col("at3") > F.col("at2")),
    )
    return cycles.select(
        F.col("a").alias("originating_account"),
        F.col("b").alias("intermediary_1"),
        F.col("c").alias("intermediary_2"),
        F.col("amount1").alias("init_amount"),
        F.col("amount3").alias("return_amount"),
        *[F.col(f"id{i}").alias(f"transaction_{i}") for i in (1, 2, 3)],
        F.col("amount2").alias("middle_amount"),
        *[F.col(f"currency{i}").alias(f"currency_{i}") for i in (1, 2, 3)],
    )


def circular_transfers(transfers: DataFrame) -> DataFrame:
    """All cycles a -> b -> c -> a in time order.

    Closed walks are found on distinct account pairs first; single transfers are joined
    only along those, and only where a full cycle exists.
    """
    edges = _edges(transfers)
    return _closed(_middle(edges, _timed_walks(edges)), edges)


def circular_counts(transfers: DataFrame) -> DataFrame:
    """Number of cycles a -> b -> c -> a in time order per account triple.

    Counted by running sums along each closed walk, not by listing cycles: a transfer b -> c
    continues as many beginnings as there are earlier ones a -> b, a transfer c -> a closes as
    many as earlier ones b -> c continue. Work grows with the transfers along closed walks, while
    the cycles of a busy triple grow with the product of its three pairs."""
    edges = _edges(transfers)
    walks = written(_timed_walks(edges), "timed_walks")

    def along(src: str, dst: str) -> DataFrame:
        fits = (F.col("src") == F.col(src)) & (F.col("dst") == F.col(dst))
        inside = F.col("at").between(F.col("first_at"), F.col("last_at"))
        found = edges.select("src", "dst", "at").join(walks, fits & inside)
        return found.select(F.struct("a", "b", "c").alias("walk"), "at")

    def earlier(given: DataFrame, asking: DataFrame) -> DataFrame:
        """``asking`` with the sum ``n`` of ``given`` rows of the walk that are earlier."""
        none = F.lit(0).cast(WIDE)
        line = given.select("walk", "at", F.lit(1).alias("rank"), F.col("n").cast(WIDE).alias("n"))
        asked = asking.select("walk", "at", F.lit(0).alias("rank"), none.alias("n"))
        summed = running_sums(line.unionByName(asked), "walk", ["n"], HOUR, WIDE)
        return summed.filter(F.col("rank") == 0).select("walk", "at", "n")

    begun = along("a", "b").withColumn("n", F.lit(1))
    closed = earlier(earlier(begun, along("b", "c")), along("c", "a"))
    return (
        closed.groupBy("walk")
        .agg(F.sum("n").cast(WIDE).alias("cycles"))
        .filter(F.col("cycles") > 0)
        .select(
            F.col("walk.a").alias("originating_account"),
            F.col("walk.b").alias("intermediary_1"),
            F.col("walk.c").alias("intermediary_2"),
            "cycles",
        )
    )


def rapid_cycles(transfers: DataFrame, max_gap: int) -> DataFrame:
    """All cycles a -> b -> c -> a whose transfers follow each other within ``max_gap``
    microseconds. Accounts are split by time, so work is bounded by what passes through an
    account within the gap, whatever its whole history."""
    edges = _edges(transfers)
    begun = _follow(_named(edges, 1), _named(edges, 2), 1, max_gap)
    closed = _follow(begun, _named(edges, 3), 2, max_gap, closing=True)
    return closed.select(
        F.col("src1").alias("originating_account"),
        F.col("dst1").alias("intermediary_1"),
        F.col("dst2").alias("intermediary_2"),
        F.col("amount1").alias("init_amount"),
        F.col("amount3").alias("return_amount"),
        *[F.col(f"id{i}").alias(f"transaction_{i}") for i in (1, 2, 3)],
    )


def circular_top(transfers: DataFrame, k: int = 3) -> DataFrame:
    """First ``k`` cycles by the three accounts, then by the three ids.

    Every timed walk has a cycle, and so has every walk with a fitting first, or first and
    second, transfer. So only the first ``k`` of each in the total order are expanded, and no
    broadcast side holds more than ``k`` rows.
    """
    edges = _edges(transfers)
    names = ["a", "b", "c"]
    walks = F.broadcast(top(_timed_walks(edges), k, *[F.col(c) for c in names]))
    first = _named(edges, 1).join(
        walks,
        (F.col("src1") == F.col("a")) & (F.col("dst1") == F.col("b"))
        & (F.col("at1") < F.col("latest")),
    )
    first = top(first, k, *names, "id1")
    second = _named(edges, 2).join(
        F.broadcast(first),
        (F.col("src2") == F.col("b")) & (F.col("dst2") == F.col("c"))
        & (F.col("at2") > F.col("at1")) & (F.col("at2") < F.col("last_at")),
    )
    second = top(second, k, *names, "id1", "id2")
    third = _named(edges, 3).join(
        F.broadcast(second),
        (F.col("src3") == F.col("c")) & (F.col("dst3") == F.col("a"))
        & (F.col("at3") > F.col("at2")),
    )
    found = third.select(
        F.col("a").alias("originating_account"),
        F.col("b").alias("intermediary_1"),
        F.col("c").alias("intermediary_2"),
        *[F.col(f"id{i}").alias(f"transaction_{i}") for i in (1, 2, 3)],
        *[F.col(f"amount{i}").alias(f"amount_{i}") for i in (1, 2, 3)],
        *[F.col(f"currency{i}").alias(f"currency_{i}") for i in (1, 2, 3)],
    )
    return top(
        found, k, "originating_account", "intermediary_1", "intermediary_2",
        "transaction_1", "transaction_2", "transaction_3",
    )
