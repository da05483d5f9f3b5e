"""Splits, samples, folds and batches. All are seeded or follow an explicit ordinal, never row arrival."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .positions import HASH_SHIFT, ORDINAL_SHIFT, cut_points, first_n, seeded_hash, with_position, with_total_before


def dev_test_split(
    rows: DataFrame, strata: Sequence[str], ordinal: str, dev_rows: int = 8, name: str = "split"
) -> DataFrame:
    """In each stratum the first ``dev_rows`` in file order are ``dev``, the rest ``test``.

    Only the dev rows are ranked; they are then marked by their unique ordinal, so the large rest is never sorted. Their ordinals are
    written first: Spark then knows how few they are, and marks the rows where they lie.
    """
    dev = first_n(rows.select(*strata, ordinal), strata, [F.col(ordinal)], dev_rows)
    marks = materialise(dev.select(F.col(ordinal).alias("_dev")), name="dev")
    marked = rows.join(marks, F.col(ordinal) == F.col("_dev"), "left")
    return marked.withColumn(name, F.when(F.col("_dev").isNotNull(), "dev").otherwise("test")).drop("_dev")


def _take(rows: DataFrame, strata: Sequence[str], id_column: str, quota: int | Column | None, seed: int) -> DataFrame:
    """The first ``quota`` rows per stratum in a seeded random order of their ids, all for None; a null quota takes none.

    The order value of each stratum's last row is found from counts (``cut_points``) and written, one row per stratum; the table is
    then filtered by it where it lies. Only strata, ids and quotas are read for the first pass, and no other column is shuffled.
    Where rows share the last order value, which ids that repeat do, these rows are ranked by id.
    """
    if quota is None:
        return rows
    names = ["_quota", "_order", "_at", "at", "cut", "room", "ties"]
    if set(names) & set(rows.columns):
        raise ValueError(f"columns {sorted(set(names) & set(rows.columns))} are used here")
    wanted = (quota if isinstance(quota, Column) else F.lit(quota)).cast("bigint")
    order = seeded_hash(F.col(id_column), seed)
    cuts = materialise(cut_points(rows, strata, order, wanted), name="cuts")
    asked = rows.withColumns({"_quota": wanted, "_order": order}).where(F.col("_quota") > 0)
    if strata:
        marked = asked.withColumn("_at", F.struct(*strata)).join(cuts, F.col("_at") == F.col("at"), "left")
    else:  # at most one cut: a literal
        row = cuts.first()
        values = {c: F.lit(row[c] if row else None).cast("bigint") for c in ("cut", "room", "ties")}
        marked = asked.withColumns(values)
    whole = F.col("cut").isNull() | (F.col("_order") < F.col("cut")) | ((F.col("_order") == F.col("cut")) & (F.col("room") >= F.col("ties")))
    taken = marked.where(whole)
    if not cuts.where("room < ties").isEmpty():
        some = marked.where((F.col("_order") == F.col("cut")) & (F.col("room") < F.col("ties")))
        taken = taken.unionByName(first_n(some, strata, [F.col(id_column)], F.col("room")))
    return taken.select(*[F.col(f"`{c}`") for c in rows.columns])


def stratified_sample(
    rows: DataFrame, strata: Sequence[str], id_column: str, n: int | None, seed: int = 42, strict: bool = False
) -> DataFrame:
    """``n`` rows per stratum in a seeded random order, all for None; a short stratum gives what it has.

    ``strict`` refuses short strata instead, after one counting pass.
    """
    if strict and n is not None:
        short = rows.groupBy(*strata).agg(F.count("*").alias("n")).where(F.col("n") < n).limit(1).collect()
        if short:
            raise ValueError(f"a stratum has fewer than {n} rows: {short[0].asDict()}")
    return _take(rows, strata, id_column, n, seed)


def sample_per_group(
    rows: DataFrame, groups: Sequence[str], id_column: str, quota: int | Column | None, seed: int = 0
) -> DataFrame:
    """Up to ``quota`` rows per group, all for None. The quota may be a column."""
    return _take(rows, groups, id_column, quota, seed)


def sample_n(rows: DataFrame, id_column: str, n: int | None, seed: int = 1) -> DataFrame:
    """``n`` random rows of the table, all for None."""
    return _take(rows, [], id_column, n, seed)


def first_examples(rows: DataFrame, condition: Column, ordinal: str, n: int = 6) -> DataFrame:
    """The first rows in file order that meet a condition."""
    return rows.where(condition).orderBy(ordinal).limit(n)


def top_groups(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The most frequent values."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(column)).limit(n)


def stratified_folds(
    rows: DataFrame, label: str, id_column: str, folds: int = 5, seed: int = 0, name: str = "fold"
) -> DataFrame:
    """Fold numbers whose sizes differ by at most one row within every label."""
    order = seeded_hash(F.col(id_column), seed)
    placed = with_position(rows, order, [label], "_position", HASH_SHIFT, [F.col(id_column)])
    return placed.withColumn(name, (F.col("_position") % folds).cast("int")).drop("_position")


def batch_number(rows: DataFrame, ordinal: str, size: int, name: str = "batch") -> DataFrame:
    """Consecutive groups of ``size`` rows in file order, numbered from 0."""
    placed = with_position(rows, F.col(ordinal), name="_position")
    return placed.withColumn(name, F.floor(F.col("_position") / size).cast("bigint")).drop("_position")


def assign_round_robin(
    rows: DataFrame, ordinal: str, key: str, items: Mapping[str, Sequence[str]], name: str
) -> DataFrame:
    """Row i gets item ``i mod length`` of the list that its ``key`` selects."""
    pairs = []
    for value, names in items.items():
        pairs += [F.lit(value), F.array(*[F.lit(n) for n in names])]
    choices = F.try_element_at(F.create_map(*pairs), F.col(key))
    placed = with_position(rows, F.col(ordinal), name="_position")
    index = (F.col("_position") % F.size(choices)).cast("int")
    return placed.withColumn(name, F.get(choices, index)).drop("_position")


def budget_gate(
    calls: DataFrame,
    ordinal: str,
    cost: str,
    cap_usd: float,
    spent: Column | float = 0.0,
    name: str = "admission",
    shift: int = ORDINAL_SHIFT,
) -> DataFrame:
    """``admit`` a call while the spend before it is below the cap, else ``deferred``."""
    placed = with_total_before(calls, F.col(ordinal), F.col(cost), "_earlier", shift=shift)
    already = spent if isinstance(spent, Column) else F.lit(spent)
    before = F.coalesce(F.col("_earlier"), F.lit(0)).cast("decimal(38,6)") + already.cast("decimal(18,6)")
    admitted = before < F.lit(cap_usd).cast("decimal(18,6)")
    return placed.withColumn(name, F.when(admitted, "admit").otherwise("deferred")).drop("_earlier")
