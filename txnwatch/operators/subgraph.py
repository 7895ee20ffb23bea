"""From pattern rows to a displayed subgraph: nodes, links, findings, verdict.

The input is the first few rows of each pattern, so the frames here hold at most a few
dozen rows, whatever the size of the graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.functions import wording as W
from txnwatch.operators import paths
from txnwatch.operators.graph import (
    RECEIVER_TYPE,
    SENDER_TYPE,
    TxnGraph,
    owner_risk,
    smurfing_pairs,
)
from txnwatch.operators.keyed import top
from txnwatch.session import written


def _link(source: str, target: str, amount: str, currency: str) -> Column:
    value = F.coalesce(F.col(amount), F.lit(0.0))
    text = F.concat(F.lit("$"), F.call_function("format_number", value, F.lit("#,##0.###")))
    return F.struct(
        F.col(source).alias("source"),
        F.col(target).alias("target"),
        value.alias("amount"),
        F.coalesce(F.col(currency), F.lit("USD")).alias("currency"),
        F.when(value != 0, text).otherwise("TRANSACTED").alias("label"),
    )


def _ownership_link(owner: str, owned: str) -> Column:
    return F.struct(
        F.col(owner).alias("source"),
        F.col(owned).alias("target"),
        F.lit(0.0).alias("amount"),
        F.lit("USD").alias("currency"),
        F.lit("OWNS").alias("label"),
    )


def _node(column: str, entity_level: str | None = None) -> Column:
    level = F.col(entity_level) if entity_level else F.lit(None).cast("string")
    return F.struct(F.col(column).alias("id"), level.alias("level"))


def _findings(rows: DataFrame, pattern: str, place: int, order, nodes, links) -> DataFrame:
    number = F.row_number().over(Window.orderBy(*order))
    return rows.select(
        F.lit(place).alias("place"),
        F.lit(pattern).alias("anomaly_type"),
        number.alias("row_no"),
        F.array(*nodes).alias("nodes"),
        F.array(*links).alias("links"),
    )


def findings(graph: TxnGraph, layering: int = 3, circular: int = 3, smurfing: int = 5,
             owner: int = 3) -> DataFrame:
    """First rows of each pattern in a total order, with their path nodes and links.

    The transfers are read by many steps, so they are derived and written once."""
    transfers = written(graph.transfers, "transfers")
    chains = paths.layering_top(transfers, layering)
    cycles = paths.circular_top(transfers, circular)
    deposits = smurfing_pairs(transfers, smurfing)
    owners = top(
        owner_risk(transfers, graph.owns, graph.entities),
        owner,
        F.col("transaction_id"),
        F.col("beneficiary"),
    )
    ids = [f"transaction_{i}" for i in (1, 2, 3)]
    cycle_ends = ["originating_account", "intermediary_1", "intermediary_2", "originating_account"]
    return (
        _findings(
            chains, W.LAYERING, 1, [F.desc("amount_1"), *ids],
            [_node(f"account_{x}") for x in "abcd"],
            [_link(f"account_{s}", f"account_{t}", f"amount_{i}", f"currency_{i}")
             for i, (s, t) in enumerate(zip("abc", "bcd"), 1)],
        )
        .unionByName(_findings(
            cycles, W.CIRCULAR, 2, [*cycle_ends[:3], *ids],
            [_node(c) for c in cycle_ends[:3]],
            [_link(s, t, f"amount_{i}", f"currency_{i}")
             for i, (s, t) in enumerate(zip(cycle_ends, cycle_ends[1:]), 1)],
        ))
        .unionByName(_findings(
            deposits, W.SMURFING, 3, ["transaction_id"],
            [_node("sender"), _node("target")],
            [_link("sender", "target", "amount", "currency")],
        ))
        .unionByName(_findings(
            owners, W.OWNER, 4, ["transaction_id", "beneficiary"],
            [_node("sender"), _node("receiving_account"), _node("beneficiary", "risk_level")],
            [_link("sender", "receiving_account", "transfer_amount", "currency"),
             _ownership_link("beneficiary", "receiving_account")],
        ))
    )


def _placed_nodes(found: DataFrame) -> DataFrame:
    return found.select(
        "place", "row_no", "anomaly_type", F.posexplode("nodes").alias("pos", "node")
    ).select("place", "row_no", "anomaly_type", "pos", "node.*")


def first_seen_nodes(found: DataFrame) -> DataFrame:
    """Distinct nodes with the position of their first appearance."""
    seen = F.struct("place", "row_no", "pos", "level").alias("seen")
    return _placed_nodes(found).groupBy("id").agg(F.min(seen).alias("seen")).select("id", "seen.*")


def subgraph_nodes(found: DataFrame, accounts: DataFrame) -> DataFrame:
    """Node id and group: the risk level of entities, the account type of accounts.

    An account that sends and receives belongs to the sender group.
    """
    types = (
        accounts.groupBy(F.col("account_id").alias("id"))
        .agg(F.max(F.col("account_type") == SENDER_TYPE).alias("sends"))
        .select("id", F.when(F.col("sends"), SENDER_TYPE).otherwise(RECEIVER_TYPE)
                .alias("account_type"))
    )
    nodes = first_seen_nodes(found)
    group = F.coalesce("level", "account_type", F.lit("Unknown")).alias("group")
    return nodes.join(types, "id", "left").select("id", group)


def subgraph_links(found: DataFrame) -> DataFrame:
    return found.select(F.col("anomaly_type").alias("pattern"), F.inline("links")).select(
        "source", "target", "amount", "currency", "pattern", "label"
    )


def anomaly_summaries(found: DataFrame) -> DataFrame:
    """Heading and text of each finding, naming its first, last or high-risk node."""
    ids = F.array_distinct(F.transform("nodes", lambda n: n["id"]))
    risky = F.filter("nodes", lambda n: n["level"] == "High Risk")
    first, last = F.get(ids, F.lit(0)), F.element_at(ids, -1)
    owner = F.coalesce(F.get(risky, F.lit(0))["id"], F.lit("a High-Risk UBO"))
    named = {W.LAYERING: [first, last], W.CIRCULAR: [first], W.SMURFING: [first], W.OWNER: [owner]}
    kind = F.col("anomaly_type")
    heading = summary = F.lit(None).cast("string")
    for pattern, values in named.items():
        text = F.format_string(W.SUMMARIES[pattern], *values)
        heading = F.when(kind == pattern, W.HEADINGS[pattern]).otherwise(heading)
        summary = F.when(kind == pattern, text).otherwise(summary)
    return found.select(
        "place", "row_no", kind, heading.alias("heading"), summary.alias("summary")
    )


def _whole(found: DataFrame) -> DataFrame:
    """One row: node ids in first-seen order and all links in order."""
    rows = F.array_sort(F.collect_list(F.struct("place", "row_no", "nodes", "links")))
    ids = F.flatten(F.transform("rows", lambda r: F.transform(r["nodes"], lambda n: n["id"])))
    return found.agg(rows.alias("rows")).select(
        F.array_distinct(ids).alias("ids"),
        F.flatten(F.transform("rows", lambda r: r["links"])).alias("links"),
    )


def _verdict() -> list[Column]:
    count = F.size("ids")
    heading = (
        F.when(count > 6, W.NETWORK_HEADING)
        .when(count > 0, W.ALERT_HEADING)
        .otherwise(W.NOTHING_HEADING)
    )
    text = F.format_string(
        W.VERDICT_SUMMARY,
        count.cast("string"),
        F.size("links").cast("string"),
        F.array_join(F.slice("ids", 1, 3), ", "),
    )
    summary = F.when(count > 0, text).otherwise(W.NOTHING_SUMMARY)
    return [heading.alias("heading"), summary.alias("summary")]


def graph_verdict(found: DataFrame) -> DataFrame:
    """One row: overall heading and summary, with the first three names seen."""
    return _whole(found).select(*_verdict())


def anomaly_of_node(found: DataFrame) -> DataFrame:
    """For each node, the first finding that contains it."""
    first = F.min(F.struct("place", "row_no", "anomaly_type")).alias("first")
    return (
        _placed_nodes(found)
        .groupBy(F.col("id").alias("node_id"))
        .agg(first)
        .select("node_id", "first.anomaly_type")
    )


def _prompt() -> Column:
    names = F.array_join("ids", ", ")
    return F.format_string(W.GRAPH_PROMPT, names, F.to_json("links")).alias("prompt")


def graph_prompt(found: DataFrame) -> DataFrame:
    """One row: prompt that lists all nodes and links of the findings."""
    return _whole(found).select(_prompt())


def graph_prompt_and_verdict(found: DataFrame) -> DataFrame:
    """One row: the prompt, and the heading and summary to fall back on."""
    return _whole(found).select(_prompt(), *_verdict())
