"""Site-relative line frequency: lines on too large a part of a host's pages are boilerplate.

Only DataFrame functions are used. A page's distinct lines are hashed in place, so what is
shuffled is (host, 64-bit line hash, partial count); a host or a line that owns a third of all
rows is summed before its shuffle. Whole texts are never shuffled by host: the boilerplate of a
host is one row. It has at most (distinct lines of a page) / ratio entries, as each of them is on
more than ``max_ratio`` of the pages. These rows are broadcast when counted to be few; otherwise
the join is a plain one that adaptive execution can split. Two lines of one host with equal
64-bit hashes would count as one; among a billion lines of a host the odds are 3 %.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.tables import fresh, kept

#: Half of a tenth: a line that a site puts on every tenth page is on 10 % of n pages give or take
#: 0.3 / sqrt(n), so on 500 pages 5 % is four deviations below it. Small hosts go by MIN_PAGES. Not
#: lower, as copies of one document would then lose all their lines before one of them is kept.
MAX_RATIO, MIN_PAGES = 0.05, 3
#: Hashes that may be broadcast (8 bytes each).
MAX_BROADCAST = 2_000_000


def lines(text: F.Column) -> F.Column:
    return F.split(text, "\n", -1)


def line_key(line: F.Column) -> F.Column:
    """Lines count as equal if they are so up to spaces, tabs and CR at either end."""
    return F.xxhash64(F.btrim(line, F.lit(" \t\r")))


def _blank(line: F.Column) -> F.Column:
    return F.btrim(line, F.lit(" \t\r")) == ""


def boilerplate(
    docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """(host, pages, line_hash, line_pages) of lines on more than ``max_ratio`` of a host's
    pages and on at least ``min_pages`` of them. Blank lines are never boilerplate; a null host
    is a host of its own; null texts count as pages without lines."""
    site = docs.select(F.col(host).alias("host"), F.col("text"))
    pages = site.groupBy("host").agg(F.count("*").alias("pages"))
    keys = F.array_distinct(
        F.transform(F.filter(lines(F.col("text")), lambda x: ~_blank(x)), line_key)
    )
    counts = (
        site.select("host", F.explode(keys).alias("line_hash"))
        .groupBy("host", "line_hash")
        .agg(F.count("*").alias("line_pages"))
        .where(F.col("line_pages") >= min_pages)
    )
    total = pages.select(F.col("host").alias("_host"), "pages")
    return (
        counts.join(total, F.col("host").eqNullSafe(F.col("_host")))
        .where(F.col("line_pages") > F.col("pages") * F.lit(max_ratio))
        .select("host", "pages", "line_hash", "line_pages")
    )


def drop_boilerplate(
    docs: DataFrame,
    host: str = "source",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    counted: str | None = None,
) -> DataFrame:
    """``docs`` with its columns and rows, without boilerplate lines in ``text``.

    The other lines stay as they are and in their order. A text that loses no line is returned
    unchanged, one that loses all of them is empty, a null text stays null. ``counted`` names an
    extra column with the number of lines dropped. Rows that repeat count as pages of their own.
    An empty table gives an empty result.
    """
    found = (
        boilerplate(docs, host, max_ratio, min_pages)
        .groupBy("host")
        .agg(F.collect_list("line_hash").alias("hashes"))
    )
    found = kept(found, "boilerplate")
    n = found.agg(F.sum(F.size("hashes") + 8)).first()[0] or 0
    their, hashes, cut = (fresh(name, docs) for name in ("_host", "_hashes", "_cut"))
    hosts = found.select(F.col("host").alias(their), F.col("hashes").alias(hashes))
    if n <= MAX_BROADCAST:
        hosts = F.broadcast(hosts)
    joined = docs.join(hosts, F.col(f"`{host}`").eqNullSafe(F.col(their)), "left")
    split = lines(F.col("text"))
    stay = F.filter(split, lambda x: _blank(x) | ~F.array_contains(F.col(hashes), line_key(x)))
    found_any = F.col(hashes).isNotNull() & F.col("text").isNotNull()
    both = F.struct((F.size(split) - F.size(stay)).cast("long").alias("lost"), F.array_join(stay, "\n").alias("text"))
    marked = joined.withColumn(cut, F.when(found_any, both))
    lost = F.coalesce(F.col(f"{cut}.lost"), F.lit(0))
    text = F.when(lost > 0, F.col(f"{cut}.text")).otherwise(F.col("text"))
    out = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return marked.select(*out, *([lost.alias(counted)] if counted else []))
