"""Numbers, weeks and money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COST = "decimal(18,6)"


def round_even(value: Column | str, digits: int) -> Column:
    """Round to ``digits`` decimals, halves to even, on the binary value.

    ``bround`` rounds the printed decimal instead: it turns the double 4.475, which is a little less than that, into 4.48.
    """
    number = F.col(value) if isinstance(value, str) else value
    scale = F.lit(float(10**digits))
    return F.rint(number * scale) / scale


def week_index(date: Column, origin: Column) -> Column:
    """Whole weeks since ``origin``, rounded down."""
    days = F.datediff(date, origin)
    return F.floor(days / F.lit(7)).cast("int")


def week_start(week: Column, origin: Column) -> Column:
    return F.date_add(origin, (week * 7).cast("int"))


def week_label(week: Column) -> Column:
    """``W01`` for week 0."""
    return F.format_string("W%02d", week + 1)


def call_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """USD of one call, to six decimals. Exact, so later sums do not depend on the order of rows."""
    def amount(tokens: Column, price: Column) -> Column:
        return tokens.cast("decimal(18,0)") * price.cast("decimal(12,4)")

    return ((amount(tokens_in, price_in) + amount(tokens_out, price_out)) / F.lit(1000000)).cast(COST)
