"""Payment graph: node and edge tables, integrity check, one-hop patterns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.functions import money, rules
from txnwatch.operators.keyed import top
from txnwatch.schemas import SMURFING_MIN_DEPOSITS

# Account types in their declared order.
SENDER_TYPE = "Retail"
RECEIVER_TYPE = "Merchant/P2P"


def account_nodes(tx: DataFrame) -> DataFrame:
    """Senders and receivers; an account that does both has one row per type."""
    ends = F.array(
        F.struct(F.col("user_id").alias("account_id"), F.lit(SENDER_TYPE).alias("account_type")),
        F.struct(F.col("merchant").alias("account_id"), F.lit(RECEIVER_TYPE).alias("account_type")),
    )
    return tx.select(F.inline(ends)).distinct()


def transaction_edges(tx: DataFrame) -> DataFrame:
    return tx.select(
        F.col("user_id").alias("source_account"),
        F.col("merchant").alias("target_account"),
        "amount",
        "timestamp",
        "transaction_id",
        "currency",
        "country",
    )


@dataclass(frozen=True)
class TxnGraph:
    """Two node tables, two edge tables; edges refer to nodes by id."""

    accounts: DataFrame
    entities: DataFrame
    transfers: DataFrame
    owns: DataFrame

    @classmethod
    def from_transactions(cls, tx: DataFrame, entities: DataFrame, owns: DataFrame) -> TxnGraph:
        return cls(account_nodes(tx), entities, transaction_edges(tx), owns)

    def account_ids(self) -> DataFrame:
        """One row per account with its types in declared order."""
        return self.accounts.groupBy("account_id").agg(
            F.reverse(F.array_sort(F.collect_set("account_type"))).alias("account_types")
        )

    def bound(self) -> TxnGraph:
        """The graph without edges that refer to a missing node.

        Not needed for ``from_transactions``: there every transfer end is a node.
        """
        ids = self.accounts.select("account_id").distinct()
        owners = self.entities.select("entity_id").distinct()
        transfers = self.transfers.join(
            ids.withColumnRenamed("account_id", "source_account"), "source_account", "left_semi"
        ).join(
            ids.withColumnRenamed("account_id", "target_account"), "target_account", "left_semi"
        )
        owns = self.owns.join(
            ids.withColumnRenamed("account_id", "owned_account"), "owned_account", "left_semi"
        ).join(owners.withColumnRenamed("entity_id", "owner_entity"), "owner_entity", "left_semi")
        return TxnGraph(
            self.accounts,
            self.entities,
            transfers.select(*self.transfers.columns),
            owns.select(*self.owns.columns),
        )

    def dangling_ownership(self) -> DataFrame:
        """Ownership edges with a missing owner or account."""
        accounts = self.accounts.select(F.col("account_id").alias("owned_account")).distinct()
        owners = self.entities.select(F.col("entity_id").alias("owner_entity")).distinct()
        edges = self.owns.select("owner_entity", "owned_account")
        known = edges.join(accounts, "owned_account", "left_semi").join(
            owners, "owner_entity", "left_semi"
        )
        return edges.join(known, ["owner_entity", "owned_account"], "left_anti")

    def dangling_transfers(self) -> DataFrame:
        """Transfers with an end that is no account: transaction_id, both ends, and which of them
        are missing. An end without a name is missing too.

        Only distinct ends are compared with the accounts, so a busy account is reduced before
        the shuffle; transfers are then looked up among the ends found missing, which Spark
        broadcasts if they are few and otherwise splits where one of them has very many."""
        known = self.accounts.select(F.col("account_id").alias("end")).distinct()
        edges = self.transfers.select("transaction_id", "source_account", "target_account")
        ends = edges.select(F.explode(F.array("source_account", "target_account")).alias("end"))
        missing = ends.distinct().join(known, "end", "left_anti")
        for side in ("source", "target"):
            lost = missing.select(F.col("end").alias(f"{side}_end"), F.lit(True).alias(f"{side}_lost"))
            edges = edges.join(
                lost, F.col(f"{side}_account").eqNullSafe(F.col(f"{side}_end")), "left"
            )
        flags = {f"{side}_missing": F.coalesce(f"{side}_lost", F.lit(False)) for side in ("source", "target")}
        return (
            edges.withColumns(flags)
            .filter("source_missing OR target_missing")
            .select("transaction_id", "source_account", "target_account", *flags)
        )

    def dangling(self) -> DataFrame:
        """All edges that refer to a missing node: kind, id (of a transfer), both ends, and which
        are missing."""
        owners = self.entities.select(F.col("entity_id").alias("owner")).distinct()
        accounts = self.accounts.select(F.col("account_id").alias("account")).distinct()
        lost = self.dangling_ownership().join(owners.withColumn("owner_known", F.lit(True)),
                                              F.col("owner_entity") == F.col("owner"), "left")
        lost = lost.join(accounts.withColumn("account_known", F.lit(True)),
                         F.col("owned_account") == F.col("account"), "left")
        ownership = lost.select(
            F.lit("ownership").alias("kind"),
            F.lit(None).cast("string").alias("edge_id"),
            F.col("owner_entity").alias("from_id"),
            F.col("owned_account").alias("to_id"),
            F.col("owner_known").isNull().alias("from_missing"),
            F.col("account_known").isNull().alias("to_missing"),
        )
        transfers = self.dangling_transfers().select(
            F.lit("transfer"), "transaction_id", "source_account", "target_account",
            "source_missing", "target_missing",
        )
        return ownership.union(transfers)


def smurfing_sinks(edges: DataFrame, more_than: int = SMURFING_MIN_DEPOSITS) -> DataFrame:
    """Accounts with more than three deposits just below the reporting limit."""
    return (
        edges.filter(rules.structuring_range())
        .groupBy(F.col("target_account"))
        .agg(
            F.count("transaction_id").alias("structuring_deposit_count"),
            money.total(F.col("amount")).alias("total_structured_amount"),
        )
        .filter(F.col("structuring_deposit_count") > more_than)
        .orderBy(F.desc("total_structured_amount"), "target_account")
    )


def smurfing_pairs(edges: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` single deposits just below the limit."""
    hits = edges.filter(rules.structuring_range())
    return top(hits, n, F.col("transaction_id")).select(
        F.col("source_account").alias("sender"),
        "transaction_id",
        "amount",
        F.col("target_account").alias("target"),
        "currency",
    )


def owner_risk(edges: DataFrame, owns: DataFrame, entities: DataFrame) -> DataFrame:
    """Payments into accounts owned by a high-risk entity.

    The owner side is reduced to high-risk owners first. It carries no broadcast hint:
    Spark picks the join by its measured size.
    """
    risky = entities.filter(F.col("risk_level") == "High Risk").select(
        F.col("entity_id").alias("owner_entity"), "risk_level"
    )
    owned = owns.join(risky, "owner_entity").select(
        F.col("owned_account").alias("target_account"), "owner_entity", "risk_level"
    )
    return edges.join(owned, "target_account").select(
        F.col("source_account").alias("sender"),
        F.col("amount").alias("transfer_amount"),
        F.col("target_account").alias("receiving_account"),
        F.col("owner_entity").alias("beneficiary"),
        "transaction_id",
        "currency",
        "risk_level",
    )


def element_json(df: DataFrame, label: str, columns: list[str], out: str) -> DataFrame:
    """A node or edge row as JSON with its label and non-NULL properties."""
    element = F.struct(
        F.array(F.lit(label)).alias("labels"), F.struct(*columns).alias("properties")
    )
    return df.withColumn(out, F.to_json(element))
