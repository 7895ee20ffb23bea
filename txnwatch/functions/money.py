"""Money as wide decimals, so that sums are exact and independent of row order."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Six decimals, for currencies with three and for unit prices and rates.
EXACT = "decimal(38,6)"


def exact(amount: Column) -> Column:
    """An amount to a millionth, halves away from zero; NULL for one that is not finite."""
    return amount.try_cast(EXACT)


def dollars(total: Column) -> Column:
    return total.cast("double")


def total(amount: Column) -> Column:
    """Aggregate: exact sum of amounts as a double."""
    return dollars(F.sum(exact(amount)))


def mean(amount: Column) -> Column:
    """Aggregate: exact sum divided by the number of known amounts."""
    return total(amount) / F.count(amount)


def money_text(amount: Column) -> Column:
    """Two decimals without exponent, at any size."""
    rounded = F.floor(F.abs(amount) * F.lit(100.0) + F.lit(0.5))
    sign = F.when((amount < 0) & (rounded > 0), F.lit("-")).otherwise(F.lit(""))
    return F.when(
        amount.isNotNull(),
        F.format_string("%s%d.%02d", sign, F.floor(rounded / 100), F.pmod(rounded, F.lit(100))),
    )
