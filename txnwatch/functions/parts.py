"""One transaction as three rows, so that one aggregation serves sums and distinct counts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnwatch.functions import rules
from txnwatch.functions.money import EXACT, exact

AMOUNTS, MERCHANT, COUNTRY = 0, 1, 2
SUMS = ("n", "known", "spend", "near")
USED = "kind = 0 OR value IS NOT NULL"


def transaction_parts() -> Column:
    """Array of (kind, value, n, known, spend, near, peak).

    Kind 0 carries count, amount and flags; kinds 1 and 2 only name the merchant and the
    country, so that grouping by (kind, value) leaves one row per distinct value.
    """
    return _parts(transaction_measures())


def transaction_measures() -> list[Column]:
    """n, known, spend, near and peak of one transaction."""
    amount = F.col("amount")
    measures = {
        "n": F.lit(1).cast("bigint"),
        "known": amount.isNotNull().cast("bigint"),
        "spend": F.coalesce(exact(amount), F.lit(0).cast(EXACT)),
        "near": F.coalesce(rules.near_threshold(amount).cast("bigint"), F.lit(0).cast("bigint")),
        "peak": amount,
    }
    return [c.alias(name) for name, c in measures.items()]


def pane_parts() -> Column:
    """``transaction_parts`` of a row that holds the sums of several transactions with one
    merchant and country."""
    return _parts([F.col(c) for c in (*SUMS, "peak")])


def _parts(own: list[Column]) -> Column:
    types = {name: "bigint" for name in SUMS} | {"spend": EXACT, "peak": "double"}
    # NULL, as sums pass over it: adding up wide zeros took most of the time
    empty = {"spend": None, "peak": None}
    bare = [F.lit(empty.get(name, 0)).cast(t).alias(name) for name, t in types.items()]

    def part(kind: int, value: Column, columns: list[Column]) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), value.cast("string").alias("value"), *columns
        )

    return F.array(
        part(AMOUNTS, F.lit(None), own),
        part(MERCHANT, F.col("merchant"), bare),
        part(COUNTRY, F.col("country"), bare),
    )


def part_sums() -> list[Column]:
    return [*[F.sum(c).alias(c) for c in SUMS], F.max("peak").alias("peak")]
