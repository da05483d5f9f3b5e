"""Positions, running totals and first-n rows that stay distributed when one group is huge.

A plain ``row_number()`` sorts each group in one task. Here the order column is cut into blocks, the
blocks are counted with map-side combine, and only the block totals (one row per block) are accumulated;
rows are numbered inside their block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDINAL_SHIFT = 16  # 65,536 consecutive ordinals per block
HASH_SHIFT = 40  # 2**20 equal ranges of a 60-bit hash


def seeded_hash(column: Column, seed: int | Column) -> Column:
    """A reproducible pseudo-random bigint per value: the first 60 bits of an md5 that other engines have too."""
    digest = F.md5(F.concat(column.cast("string"), F.lit("|"), seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _blocks(df: DataFrame, order: Column, within: Sequence[str], shift: int) -> DataFrame:
    """Add ``_order`` and ``_block``: the group and the block of the order, as one key.

    One struct key serves the count, the window and the join below, so the rows are shuffled and sorted once. Inside a
    struct null equals null.
    """
    ordered = df.withColumn("_order", order.cast("bigint"))
    number = F.shiftright("_order", shift)
    return ordered.withColumn("_block", F.struct(*within, number.alias("_number")) if within else number)


def _offsets(rows: DataFrame, within: Sequence[str], amount: Column) -> DataFrame:
    """(block, total of ``amount`` in the earlier blocks of its group); one row per block."""
    totals = rows.groupBy("_block").agg(F.sum(amount).alias("_total"))
    group = [F.col("_block")[c] for c in within]
    number = F.col("_block")["_number"] if within else F.col("_block")
    earlier = Window.partitionBy(*group).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(F.col("_block").alias("_at"), F.sum("_total").over(earlier).alias("_before"))


def with_position(
    df: DataFrame,
    order: Column,
    within: Sequence[str] = (),
    name: str = "position",
    shift: int = ORDINAL_SHIFT,
    ties: Sequence[Column] = (),
) -> DataFrame:
    """0-based position of each row in ``order``, per ``within`` group or over the whole table.

    ``order`` must be a whole number that is unique inside a group, or is with ``ties``: a file ordinal, or a hash with
    ``shift=HASH_SHIFT``. No task ever sorts more than the blocks dealt to it.
    """
    rows = _blocks(df, order, within, shift)
    inside = Window.partitionBy("_block").orderBy("_order", *ties)
    placed = rows.withColumn("_here", F.row_number().over(inside) - 1)
    joined = placed.join(_offsets(rows, within, F.lit(1)), F.col("_block") == F.col("_at"))
    position = F.coalesce(F.col("_before"), F.lit(0)) + F.col("_here")
    return joined.withColumn(name, position.cast("bigint")).drop("_order", "_block", "_at", "_before", "_here")


def with_total_before(
    df: DataFrame,
    order: Column,
    amount: Column,
    name: str = "total_before",
    within: Sequence[str] = (),
    shift: int = ORDINAL_SHIFT,
) -> DataFrame:
    """Sum of ``amount`` over all rows that come earlier in ``order``; null where there are none.

    Use a decimal ``amount`` for a result that does not depend on how rows are spread.
    """
    rows = _blocks(df.withColumn("_amount", amount), order, within, shift)
    inside = Window.partitionBy("_block").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_here", F.sum("_amount").over(inside))
    joined = placed.join(_offsets(rows, within, F.col("_amount")), F.col("_block") == F.col("_at"))
    both = F.when(
        F.col("_before").isNotNull() | F.col("_here").isNotNull(),
        F.coalesce(F.col("_before"), F.lit(0)) + F.coalesce(F.col("_here"), F.lit(0)),
    )
    return joined.withColumn(name, both).drop("_order", "_block", "_at", "_before", "_here", "_amount")


def first_n(
    df: DataFrame,
    within: Sequence[str],
    order: Sequence[Column],
    n: int | Column,
    spread: Sequence[Column] | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """The first ``n`` rows of each group in ``order``; ``n`` may be a column (a quota per group).

    Ranked twice: first inside random slices of a group, then over what the slices kept, so the final
    task of a hot group sees at most ``n`` rows per slice. With a literal ``n`` of up to 1,000 Spark also
    cuts each input partition before the shuffle; large ``n`` belong to ``with_position``. ``spread`` names what deals rows to slices (default: the order
    columns); it must differ between the rows of a group. ``at_most`` is the largest quota, given when ``n`` is a
    column, so that the early cut works there too.
    """
    limit = n if at_most is None else at_most
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*(spread or order)), F.lit(slices)))
    by_slice = Window.partitionBy(*within, "_slice").orderBy(*order)
    by_group = Window.partitionBy(*within).orderBy(*order)
    return (
        sliced.withColumn("_rank", F.row_number().over(by_slice))
        .where(F.col("_rank") <= limit)
        .withColumn("_rank", F.row_number().over(by_group))
        .where(F.col("_rank") <= n)
        .drop("_slice", "_rank")
    )


def cut_points(df: DataFrame, within: Sequence[str], order: Column, n: Column, shift: int = HASH_SHIFT) -> DataFrame:
    """(at, cut, room, ties): where the first ``n`` rows of each group end in ``order``; groups of fewer than ``n`` rows have no row.

    ``at`` is a struct of the group columns (null equals null inside), ``cut`` the order value of the n-th row, ``ties`` how many rows have
    it and ``room`` how many of these are among the first ``n``. ``n`` is one whole number per group. Only group, order and n move:
    the rows of each hash block are counted, and those of the block that holds the n-th row are counted by value. Blocks are counted with
    map-side combine, so neither a group of any size nor one value that most of its rows have comes into one task.
    """
    group = F.struct(*within) if within else F.struct(F.lit(0).alias("all"))
    rows = df.select(group.alias("at"), n.cast("bigint").alias("_n"), order.cast("bigint").alias("_order"))
    rows = rows.withColumn("_block", F.shiftright("_order", shift))

    def holding(counts: DataFrame, value: str, before: Column) -> DataFrame:
        """The value whose rows, after ``before`` and those of smaller values, include the n-th."""
        upto = Window.partitionBy("at").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        counted = counts.withColumn("_upto", before + F.sum("_total").over(upto)).withColumn("_before", F.col("_upto") - F.col("_total"))
        return counted.where((F.col("_upto") >= F.col("_n")) & (F.col("_before") < F.col("_n")))

    blocks = rows.groupBy("at", "_block").agg(F.count("*").alias("_total"), F.max("_n").alias("_n"))
    block = holding(blocks, "_block", F.lit(0)).select("at", "_block", F.col("_before").alias("_earlier"))
    inside = rows.join(block, ["at", "_block"])
    values = inside.groupBy("at", "_order", "_earlier").agg(F.count("*").alias("_total"), F.max("_n").alias("_n"))
    last = holding(values, "_order", F.col("_earlier"))
    return last.select("at", F.col("_order").alias("cut"), (F.col("_n") - F.col("_before")).alias("room"), F.col("_total").alias("ties"))


def nth_value(
    df: DataFrame, within: Sequence[str], order: Column, n: str, shift: int = HASH_SHIFT
) -> DataFrame:
    """Per group the ``n``-th smallest ``order`` value (column ``cut``); ``n`` is a column of ``df``.

    Finds the block that holds the n-th row from the block counts, then ranks that block only, so a group
    of any size costs one counting pass and one small sort.
    """
    rows = df.select(
        *within, F.col(n).cast("bigint").alias("_n"), order.cast("bigint").alias("_order")
    ).withColumn("_block", F.shiftright("_order", shift))
    totals = rows.groupBy(*within, "_block").agg(F.count("*").alias("_total"), F.max("_n").alias("_n"))
    upto = Window.partitionBy(*within).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = (
        totals.withColumn("_upto", F.sum("_total").over(upto))
        .where((F.col("_upto") >= F.col("_n")) & (F.col("_upto") - F.col("_total") < F.col("_n")))
        .select(*within, "_block", (F.col("_upto") - F.col("_total")).alias("_before"))
    )
    block = Window.partitionBy(*within, "_block").orderBy("_order")
    return (
        rows.join(blocks, [*within, "_block"])
        .withColumn("_rank", F.col("_before") + F.row_number().over(block))
        .where(F.col("_rank") == F.col("_n"))
        .select(*within, F.col("_order").alias("cut"))
    )
