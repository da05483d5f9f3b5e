"""Labelled anomalies: move rows of a group into a target week, and measure how well rules find them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import WINDOW
from ..storage import materialise, spread
from .joins import literal_table
from .positions import first_n, nth_value, seeded_hash
from .trends import detect_spikes

Spike = tuple  # (group, week, factor)


def _needs(rows: DataFrame, group: str, spikes: Sequence[Spike], n_weeks: Column) -> DataFrame:
    """(group, target week, rows to move): enough to reach factor x the mean weekly count, if there are so many."""
    kind = dict(rows.dtypes)[group]
    wanted = literal_table(rows.sparkSession, list(spikes), f"{group} {kind}, _target int, _factor double")
    sizes = rows.join(wanted, group).groupBy(group, "_target", "_factor").agg(
        F.count("*").alias("_n"), F.count_if(F.col("week") == F.col("_target")).alias("_already")
    )
    goal = F.rint(F.col("_factor") * F.col("_n") / n_weeks).cast("bigint")
    need = F.least(F.greatest(goal - F.col("_already"), F.lit(0)), F.col("_n") - F.col("_already"))
    return sizes.select(group, "_target", need.alias("_need"))


def plant_spikes(
    rows: DataFrame, group: str, id_column: str, spikes: Sequence[Spike], n_weeks: Column | int, seed: int = 0
) -> DataFrame:
    """Reassign ``week`` so that each (group, week, factor) spike appears; no row is added or lost.

    The rows to move are those below a cut-off of a seeded hash of their id. The cut-off is found from block counts,
    and the move itself is a map over the table with a lookup of at most one row per spike, so a group of any size
    is neither sorted nor shuffled. Spikes of one group apply in order.
    """
    weeks = n_weeks if isinstance(n_weeks, Column) else F.lit(n_weeks)
    rounds: list[list[Spike]] = []
    for spike in spikes:
        turn = next((r for r in rounds if all(s[0] != spike[0] for s in r)), None)
        if turn is None:
            rounds.append([spike])
        else:
            turn.append(spike)
    order = seeded_hash(F.col(id_column), seed)
    for turn in rounds:
        need = F.broadcast(_needs(rows, group, turn, weeks).where(F.col("_need") > 0))
        movable = rows.join(need, group).where(F.col("week") != F.col("_target"))
        # written once: a later round, and the result, apply the cut-offs instead of finding them again
        cuts = materialise(nth_value(movable, [group, "_target"], order, "_need"), name="cuts")
        marked = rows.join(F.broadcast(cuts), group, "left")
        moves = F.col("cut").isNotNull() & (order <= F.col("cut"))
        rows = marked.withColumn("week", F.when(moves, F.col("_target")).otherwise(F.col("week"))).drop("_target", "cut")
    return rows


HASH_DIGITS, BLOCK_DIGITS = 15, 2  # hexadecimal digits of an order value, and of them those that one counting pass reads
BLOCK_ROWS = 1 << 20
REACH = 8  # standard deviations to each side of where a cut-off should be, within which values are counted one by one


def _seeded(rows: DataFrame, first_seed: int, runs: int) -> DataFrame:
    """Each row once per seed with its order value: the digits that ``seeded_hash`` reads as a number, whose order text keeps."""
    salts = F.array(*[F.lit(f"|{seed}") for seed in range(first_seed, first_seed + runs)])
    salted = rows.select("*", F.posexplode(salts).alias("_at", "_salt"))
    order = F.substring(F.md5(F.concat("_id", "_salt")), 1, HASH_DIGITS)
    return salted.withColumns({"seed": F.col("_at") + F.lit(first_seed), "_order": order}).drop("_id", "_at", "_salt")


def _digits(share: Column) -> Column:
    """The order value that this share (0 to 1) of all possible values lies below."""
    inside = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    number = F.least(F.floor(inside * F.lit(float(16**HASH_DIGITS))), F.lit(16**HASH_DIGITS - 1))
    return F.lower(F.lpad(F.hex(number), HASH_DIGITS, "0"))


def _brackets(need: DataFrame) -> DataFrame:
    """``need`` with the order values ``_low`` and ``_high`` that its cut-offs should lie between, whatever the seed.

    Of n even values the k-th is near k / (n + 1), with a deviation of about sqrt(k (n - k) / n^3).
    """
    n, k = F.col("_movable").cast("double"), F.col("_need").cast("double")
    wide = F.lit(float(REACH)) * (F.sqrt(k * (n - k) / (n * n * n)) + 4 / n)
    return need.withColumns({"_low": _digits(k / (n + 1) - wide), "_high": _digits(k / (n + 1) + wide)})


def _first_ones(counted: DataFrame, group: str) -> DataFrame:
    """Of (seed, group, week, target, left, value, count): all without a value, and the ``_left`` rows of the smallest values."""
    ranked = counted.where("_value IS NOT NULL").withColumn("_number", F.dense_rank().over(Window.partitionBy("seed", group).orderBy("_value")))
    before = Window.partitionBy("seed", group).orderBy("_number").rangeBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).where(F.col("_before") < F.col("_left"))
    columns = ["seed", group, "week", "_target", "count"]
    return counted.where("_value IS NULL").select(*columns).unionByName(ranked.select(*columns))


def _moved_by_blocks(seeded: DataFrame, cuts: DataFrame, group: str, passes: int) -> DataFrame:
    """(seed, group, week, target, count) of the rows up to each cut-off, which is found from counts of ever smaller blocks.

    ``cuts`` holds (seed, group, the digits known of the cut-off, how many rows are still to be taken from behind them); only its seeds and
    groups are read. A pass counts the blocks of hash values, 256 per seed and group.
    """
    running = Window.partitionBy("seed", group).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    for done in range(passes):
        at = done * BLOCK_DIGITS
        inside = seeded.join(F.broadcast(cuts), ["seed", group]).where(F.substring("_order", 1, at) == F.col("_known"))
        blocks = inside.groupBy("seed", group, F.substring("_order", at + 1, BLOCK_DIGITS).alias("_block")).agg(F.count("*").alias("_total"))
        holding = blocks.withColumn("_upto", F.sum("_total").over(running)).join(F.broadcast(cuts), ["seed", group]).where(
            (F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_total") < F.col("_left")))
        cuts = materialise(holding.select(
            "seed", group, F.concat("_known", "_block").alias("_known"), (F.col("_left") - F.col("_upto") + F.col("_total")).alias("_left")), name="cuts")
    start = F.substring("_order", 1, passes * BLOCK_DIGITS)
    near = seeded.join(F.broadcast(cuts), ["seed", group]).where(start <= F.col("_known"))  # a row per seed and spike
    value = F.when(start == F.col("_known"), F.col("_order"))
    counted = near.groupBy("seed", group, "week", "_target", "_left", value.alias("_value")).agg(F.count("*").alias("count"))
    return _first_ones(materialise(counted, name="near-cuts"), group)


def planted_counts(rows: DataFrame, group: str, id_column: str, spikes: Sequence[Spike], n_weeks: int, runs: int, first_seed: int = 0) -> DataFrame:
    """(seed, group, week, count) after planting, once per seed; at most one spike per group.

    Each seed orders a group's rows by its own hash and moves those up to a cut-off, as ``plant_spikes`` does. Rows meet the seeds once, inside
    the tasks that read them. Hash values are even, so a cut-off lies near a known share of them: rows beyond are left at once,
    rows before are counted per week, those between by value. Whether a cut-off was among these is seen from the counts; where it
    was not (ids that many rows repeat), that seed and group are read again, block by block. Values written are no more than the rows.
    """
    if len({s[0] for s in spikes}) < len(spikes):
        raise ValueError("a backtest plants one spike per group")
    week = F.col("week").cast("int").alias("week")
    narrow = rows.select(F.col(id_column).cast("string").alias("_id"), group, week)
    need = materialise(_needs(narrow, group, spikes, F.lit(n_weeks)).where(F.col("_need") > 0), name="needs")  # at most a row per spike
    movable = spread(narrow).join(F.broadcast(need.select(group, "_target")), group).where(F.col("week") != F.col("_target"))
    # rows without an id stay where they are, and count as the first ones
    sizes = movable.groupBy(group).agg(F.count("_id").alias("_movable"), F.count_if(F.col("_id").isNull()).alias("_none"))
    need = need.join(sizes, group).withColumn("_need", F.col("_need") - F.col("_none")).where(F.col("_need") > 0).drop("_none")
    need = materialise(_brackets(need), name="brackets")
    seeds = F.explode(F.sequence(F.lit(first_seed), F.lit(first_seed + runs - 1)))
    within = movable.join(F.broadcast(need.select(group, "_low", "_high")), group)
    value = F.when(F.col("_order") >= F.col("_low"), F.col("_order"))
    near = _seeded(within, first_seed, runs).where(F.col("_order") <= F.col("_high"))
    counted = materialise(near.groupBy("seed", group, "week", "_target", value.alias("_value")).agg(F.count("*").alias("count")), name="near-cuts")
    # (seed, group): the rows before the bracket and up to its end; the cut-off is inside if the need is between them
    upto = counted.groupBy("seed", group).agg(
        F.coalesce(F.sum(F.when(F.col("_value").isNull(), F.col("count"))), F.lit(0)).alias("_under"), F.sum("count").alias("_upto"))
    cuts = need.select(seeds.alias("seed"), group, "_need").join(upto, ["seed", group], "left")
    inside = (F.col("_under") < F.col("_need")) & (F.col("_need") <= F.col("_upto"))
    cuts = materialise(cuts.withColumn("_inside", F.coalesce(inside, F.lit(False))), name="cut-offs")
    good = cuts.where("_inside").select("seed", group, (F.col("_need") - F.col("_under")).alias("_left"))
    moved = _first_ones(counted.join(F.broadcast(good), ["seed", group]), group)
    missed = cuts.where("NOT _inside").select("seed", group, F.lit("").alias("_known"), F.col("_need").alias("_left"))
    if not missed.isEmpty():
        largest = need.agg(F.max("_movable")).first()[0]
        size, passes = 16**BLOCK_DIGITS, 1
        while size**passes < max(runs, largest / BLOCK_ROWS):
            passes += 1
        moved = moved.unionByName(_moved_by_blocks(_seeded(movable, first_seed, runs), missed, group, passes))
    gone = moved.select("seed", group, "week", (-F.col("count")).alias("count"))
    come = moved.select("seed", group, F.col("_target").alias("week"), "count")
    base = rows.groupBy(group, week).agg(F.count("*").alias("count")).withColumn("seed", seeds)
    parts = base.select("seed", group, "week", "count").unionByName(gone).unionByName(come)
    return parts.groupBy("seed", group, "week").agg(F.sum("count").alias("count"))


def backtest(
    rows: DataFrame, group: str, id_column: str, spikes: Sequence[Spike], n_weeks: int, runs: int = 200, window: int = WINDOW, **rule_options
) -> DataFrame:
    """Per rule: mean precision, recall, precision at k and false alarms over ``runs`` seeded plants in ``rows`` (with ``week``).

    A last row ``quiet`` gives the false alarms of the z rule without a plant. All timelines go through the detector in
    one job, with the seed as part of the group key.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[group]
    pairs = sorted({(g, int(w)) for g, w, _ in spikes})
    planted = literal_table(spark, [(*p, True) for p in pairs], f"{group} {kind}, week int, planted boolean")
    timelines = planted_counts(rows, group, id_column, spikes, n_weeks, runs)
    flags = materialise(detect_spikes(timelines, F.lit(n_weeks), ["seed", group], window, **rule_options), name="timelines")
    marked = flags.join(planted, [group, "week"], "left").withColumn("planted", F.coalesce("planted", F.lit(False)))
    k = len(pairs)
    rules = ["flag_z", "flag_ewma"]
    per_seed = marked.groupBy("seed").agg(
        *[F.count_if(F.col(r) & F.col("planted")).alias(f"tp_{r}") for r in rules],
        *[F.count_if(F.col(r) & ~F.col("planted")).alias(f"fp_{r}") for r in rules],
    )
    order = [F.desc("z"), F.asc(group), F.asc("week")]
    hits = first_n(marked, ["seed"], order, k, [F.col(group), F.col("week")]).groupBy("seed").agg(F.count_if("planted").alias("hits"))
    cells = F.array(
        *[F.struct(F.lit(r).alias("rule"), F.col(f"tp_{r}").alias("tp"), F.col(f"fp_{r}").alias("fp")) for r in rules]
    )
    measured = (
        per_seed.join(hits, "seed").select(F.inline(cells), "hits").groupBy("rule")
        .agg(
            F.avg(F.try_divide("tp", F.col("tp") + F.col("fp"))).alias("precision"),
            F.avg(F.col("tp") / F.lit(k)).alias("recall"),
            F.avg(F.col("hits") / F.lit(k)).alias("precision_at_k"),
            F.avg("fp").cast("double").alias("false_alarms"),
        )
    )
    none = F.lit(None).cast("double")
    counts = rows.groupBy(group, F.col("week").cast("int").alias("week")).agg(F.count("*").alias("count"))
    calm = detect_spikes(counts, F.lit(n_weeks), [group], window, **rule_options)
    quiet = calm.agg(F.count_if("flag_z").cast("double").alias("false_alarms")).select(
        F.lit("quiet").alias("rule"), none.alias("precision"), none.alias("recall"), none.alias("precision_at_k"), "false_alarms",
    )
    return measured.unionByName(quiet)
