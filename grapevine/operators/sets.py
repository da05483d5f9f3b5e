"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_by_name(*frames: DataFrame) -> DataFrame:
    return reduce(lambda left, right: left.unionByName(right), frames)


def intersect_pairs(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Pairs found on both sides."""
    return left.select(*keys).intersect(right.select(*keys))


def except_pairs(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Pairs of the left side that the right side lacks."""
    return left.select(*keys).subtract(right.select(*keys))


def distinct_groups(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys).distinct()
