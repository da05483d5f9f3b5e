"""Prices, ledger rows and cost estimates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import DEFAULT_PRICE
from ..functions.numbers import call_cost
from ..schemas import PRICE
from .joins import literal_table


def price_table(spark: SparkSession, prices: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(model, price_in, price_out) in USD per million tokens."""
    return literal_table(spark, [(m, float(i), float(o)) for m, (i, o) in prices.items()], PRICE)


def with_call_cost(
    calls: DataFrame, prices: DataFrame, default: tuple[float, float] = DEFAULT_PRICE
) -> DataFrame:
    """Cost of every call; a model without a listed price takes ``default``."""
    priced = calls.join(prices, "model", "left")
    price_in = F.coalesce("price_in", F.lit(float(default[0])))
    price_out = F.coalesce("price_out", F.lit(float(default[1])))
    cost = call_cost(F.col("tokens_in"), F.col("tokens_out"), price_in, price_out)
    return priced.withColumn("cost_usd", cost).drop("price_in", "price_out")


def estimate_cost(
    pending: DataFrame,
    batch_size: int = 10,
    tokens_in: int = 130,
    tokens_out: int = 45,
    price: tuple[float, float] = (1.0, 5.0),
    confirm_above: float = 0.5,
) -> DataFrame:
    """One row: pending rows, calls, estimated cost, and whether the cost needs a confirmation first."""
    per_row = (tokens_in * price[0] + tokens_out * price[1]) / 1e6
    rows = pending.agg(F.count("*").alias("pending"))
    return rows.select(
        "pending",
        F.ceil(F.col("pending") / batch_size).cast("bigint").alias("calls"),
        F.round(F.col("pending") * per_row, 6).alias("est_cost_usd"),
        (F.col("pending") * per_row > confirm_above).alias("needs_confirmation"),
    )
