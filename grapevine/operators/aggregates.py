"""Counts, summaries and quality measures.

Reports over several groupings first count the finest combination once, with map-side combine, and build
every coarser level from that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import DIMENSIONS, FLAGS, NO_CATEGORY, SENTIMENTS
from ..functions.labels import acceptable
from ..functions.numbers import round_even
from ..functions.text import normalise_yes_no

ALL = "ALL"


def share(condition: Column, of: Column | None = None) -> Column:
    """Share of rows where ``condition`` holds; null when there is nothing to count."""
    total = F.count("*") if of is None else F.count_if(of)
    hit = condition if of is None else condition & of
    return F.try_divide(F.count_if(F.coalesce(hit, F.lit(False))), total)


def value_counts(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)


def crosstab(rows: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts with one column per value of ``column``. The values are fixed, so no extra pass finds them."""
    return rows.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def mean_text_length(rows: DataFrame, by: str, text: str) -> DataFrame:
    return rows.groupBy(by).agg(round_even(F.avg(F.length(text)), 1).alias("mean_chars"))


def counts_by_levels(rows: DataFrame, by: Sequence[str], **extra: Column) -> DataFrame:
    """(section, value, n, ..): the total and one block per column of ``by``."""
    finest = rows.groupBy(*by).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in extra.items()])
    levels = finest.groupingSets([[], *[[c] for c in by]], *by)
    sums = [F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in extra]]
    flat = levels.agg(*sums, *[F.grouping(c).alias(f"_g_{c}") for c in by])
    section, value = F.lit("total"), F.lit(None).cast("string")
    for c in by:
        here = F.col(f"_g_{c}") == 0
        section = F.when(here, c).otherwise(section)
        value = F.when(here, F.col(c).cast("string")).otherwise(value)
    return flat.select(section.alias("section"), value.alias("value"), "n", *extra)


def ingestion_summary(reviews: DataFrame) -> DataFrame:
    """Total, rows with a category, and counts by language and by rating."""
    with_category = F.count_if(F.col("product_category").isNotNull())
    return counts_by_levels(reviews, ["detected_language", "rating"], with_category=with_category)


def translation_summary(reviews: DataFrame) -> DataFrame:
    """Counts by status and language, and languages that the model saw differently among the ``ok`` rows."""
    differs = ~F.col("translation_language").eqNullSafe(F.col("detected_language"))
    mismatches = F.count_if((F.col("translation_status") == "ok") & differs)
    return counts_by_levels(
        reviews, ["translation_status", "detected_language"], language_mismatches=mismatches
    )


def usage_summary(ledger: DataFrame) -> DataFrame:
    """Token sums and cost, to four decimals, per purpose."""
    return ledger.groupBy("purpose").agg(
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
        F.round(F.sum("cost_usd"), 4).cast("double").alias("cost_usd"),
    )


def cluster_summary(rows: DataFrame, cluster: str, topic: str, language: str) -> DataFrame:
    """Per cluster: size, dominant topic and its share, and counts per language; largest first.

    Topic ties go to the smallest name.
    """
    finest = rows.groupBy(cluster, topic, language).agg(F.count("*").alias("n"))
    pairs = finest.groupingSets([[cluster, topic], [cluster, language]], cluster, topic, language).agg(
        F.sum("n").alias("n"), F.grouping(topic).alias("_no_topic")
    )
    of_topic = F.col("_no_topic") == 0
    top = F.min(F.when(of_topic, F.struct((-F.col("n")).alias("minus"), F.col(topic).alias("topic"))))
    spoken = F.collect_list(F.when(~of_topic, F.struct(F.col(language).alias("language"), F.col("n").alias("n"))))
    grouped = pairs.groupBy(F.col(cluster).alias("cluster")).agg(
        F.sum(F.when(of_topic, F.col("n"))).alias("size"),
        top.alias("_top"),
        F.map_from_entries(F.sort_array(spoken)).alias("languages"),
    )
    purity = round_even(-F.col("_top.minus") / F.col("size"), 2)
    return grouped.select(
        "cluster", "size", F.col("_top.topic").alias("dominant_topic"), purity.alias("topic_purity"), "languages"
    ).orderBy(F.desc("size"), F.asc("cluster"))


def _confusion(rows: DataFrame, truth: str, pred: str, *by: str) -> DataFrame:
    return rows.groupBy(*by, truth, pred).agg(F.count("*").alias("n"))


def _label_cells(finest: DataFrame, truth: str, pred: str, by: str | None = None) -> DataFrame:
    """(group, label, truth, pred, hits): marginals of the confusion counts per group and for all rows."""
    if by:
        finest = finest.groupingSets([[by, truth, pred], [truth, pred]], by, truth, pred).agg(
            F.sum("n").alias("n"), F.grouping(by).alias("_all")
        )
        group = F.when(F.col("_all") == 1, ALL).otherwise(F.col(by))
    else:
        group = F.lit(ALL)
    none = F.lit(0).cast("bigint")
    as_truth = F.struct(
        F.col(truth).alias("label"), F.col("n").alias("truth"), none.alias("pred"),
        F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(none).alias("hits"),
    )
    as_pred = F.struct(
        F.col(pred).alias("label"), none.alias("truth"), F.col("n").alias("pred"), none.alias("hits")
    )
    return (
        finest.select(group.alias("group"), F.inline(F.array(as_truth, as_pred)))
        .groupBy("group", "label")
        .agg(F.sum("truth").alias("truth"), F.sum("pred").alias("pred"), F.sum("hits").alias("hits"))
    )


def _scores(cells: DataFrame, digits: int) -> DataFrame:
    def over(condition: Column, column: str) -> Column:
        return F.sum(F.when(condition, F.col(column)))

    decided = F.col("label") != "neutral"
    neutral = F.col("label") == "neutral"
    f1 = 2 * F.col("hits") / (F.col("truth") + F.col("pred"))
    return cells.groupBy("group").agg(
        F.sum("truth").alias("n"),
        round_even(F.sum("hits") / F.sum("truth"), digits).alias("accuracy"),
        round_even(F.avg(f1), digits).alias("macro_f1"),
        round_even(F.try_divide(over(neutral, "hits"), over(neutral, "truth")), digits).alias("neutral_recall"),
        round_even(F.try_divide(over(decided, "hits"), over(decided, "truth")), digits).alias("binary_accuracy"),
    )


def classification_report(
    rows: DataFrame,
    truth: str = "label",
    pred: str = "pred",
    language: str = "detected_language",
    languages: Sequence[str] | None = None,
    digits: int = 3,
) -> DataFrame:
    """Per language and for all rows: n, 3-way accuracy, macro-F1 and binary accuracy.

    Macro-F1 averages the labels seen as truth or prediction. Binary accuracy looks at rows whose truth is
    not neutral; a neutral prediction counts as wrong there. Languages without rows are absent.
    """
    report = _scores(_label_cells(_confusion(rows, truth, pred, language), truth, pred, language), digits).drop("neutral_recall")
    if languages is not None:
        report = report.where(F.col("group").isin([*languages, ALL]))
    return report.withColumnRenamed("group", "lang")


def model_scores(rows: DataFrame, truth: str = "label", pred: str = "pred", digits: int = 3) -> DataFrame:
    """Accuracy, macro-F1, neutral recall and binary accuracy over all rows."""
    return scores_from_counts(_confusion(rows, truth, pred), truth, pred, "n", digits)


def scores_from_counts(confusion: DataFrame, truth: str, pred: str, n: str, digits: int = 3) -> DataFrame:
    """``model_scores`` of a confusion table that may hold a cell more than once."""
    cells = confusion.groupBy(truth, pred).agg(F.sum(n).alias("n"))
    return _scores(_label_cells(cells, truth, pred), digits).select(
        "accuracy", "macro_f1", "neutral_recall", "binary_accuracy"
    )


def star_error(rows: DataFrame, rating: str, estimate: str, language: str) -> DataFrame:
    """Mean absolute error, exact share and within-one share of estimated stars, per language."""
    off = F.abs(F.col(estimate) - F.col(rating))
    return rows.groupBy(language).agg(
        F.count("*").alias("n"),
        F.avg(off).alias("mae"),
        share(off == 0).alias("exact_share"),
        share(off <= 1).alias("within_one_share"),
    )


def judge_means(
    rows: DataFrame, sentiment: str = "sentiment", language: str = "detected_language", digits: int = 2
) -> DataFrame:
    """Mean scores and acceptance rate overall, by sentiment and by language."""
    sums = {f"_{d}": F.sum(d) for d in DIMENSIONS}
    levels = counts_by_levels(rows, [sentiment, language], _ok=F.count_if(acceptable()), **sums)
    means = [round_even(F.col(f"_{d}") / F.col("n"), digits).alias(d) for d in DIMENSIONS]
    rate = round_even(F.col("_ok") / F.col("n"), digits).alias("acceptable")
    return levels.select("section", "value", "n", *means, rate)


def flag_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(flag).alias(flag) for flag in FLAGS])


def human_acceptance(
    sheet: DataFrame, sentiment: str = "sentiment", language: str = "detected_language", digits: int = 3
) -> DataFrame:
    """Reviewed drafts and acceptance overall, by sentiment and language, and agreement with the judge.

    An error when nobody has reviewed a draft yet.
    """
    answer = normalise_yes_no(F.col("human_accept"))
    done = sheet.withColumn("_answer", answer).where(F.col("_answer").isNotNull())
    yes = F.col("_answer") == "Y"
    levels = counts_by_levels(
        done, [sentiment, language], _yes=F.count_if(yes), _same=F.count_if(yes == F.col("acceptable"))
    )
    report = levels.select(
        "section", "value", F.col("n").alias("reviewed"),
        round_even(F.col("_yes") / F.col("n"), digits).alias("acceptance"),
        round_even(F.col("_same") / F.col("n"), digits).alias("agreement"),
    )
    # one row whose filter fails the job on an empty sheet, and which is never kept
    nobody = F.raise_error(F.lit("no rows have human_accept = Y or N yet")).cast("boolean")
    guard = done.agg(F.count("*").alias("reviewed")).where(F.when(F.col("reviewed") == 0, nobody).otherwise(False))
    return report.unionByName(guard, allowMissingColumns=True)


def human_confusion(sheet: DataFrame) -> DataFrame:
    """Human verdict against the judge's."""
    answer = normalise_yes_no(F.col("human_accept"))
    done = sheet.select((answer == "Y").alias("accepted"), "acceptable").where(F.col("accepted").isNotNull())
    return crosstab(done, "accepted", "acceptable", [False, True])


def assignment_agreement(rows: DataFrame, cluster: str, assigned: str) -> DataFrame:
    """Among assigned rows: how many, share equal to the cluster, share that fits none."""
    done = rows.where(F.col(assigned).isNotNull())
    return done.agg(
        F.count("*").alias("assigned"),
        share(F.col(cluster) == F.col(assigned)).alias("agreement"),
        share(F.col(assigned) == NO_CATEGORY).alias("none_share"),
    )


def spend_total(ledger: DataFrame, *by: str) -> DataFrame:
    """Sum of cost; missing cost counts 0 and an empty ledger gives 0."""
    cost = F.coalesce(F.col("cost_usd"), F.lit(0))
    return ledger.groupBy(*by).agg(F.coalesce(F.sum(cost), F.lit(0)).cast("double").alias("spent_usd"))


def distinct_count(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.agg(*[F.countDistinct(c).alias(f"n_{c}") for c in columns])


def noise_share(rows: DataFrame, cluster: str) -> DataFrame:
    """Number of clusters without noise, and the share of noise rows.

    Counted per cluster first, so the distinct count works on a small table.
    """
    sizes = rows.groupBy(cluster).agg(F.count("*").alias("n"))
    noise = F.col(cluster) == NO_CATEGORY
    return sizes.agg(
        F.count_if(F.col(cluster).isNotNull() & ~noise).alias("n_clusters"),
        (F.sum(F.when(noise, F.col("n")).otherwise(0)) / F.sum("n")).alias("noise_share"),
    )


def detector_scores(flags: DataFrame, planted: Sequence[tuple], rule: str, keys: Sequence[str] = ("group", "week")) -> DataFrame:
    """One row: tp, fp, fn, flagged, precision (null if nothing is flagged), recall and precision at k.

    k is the number of planted pairs; the top k are taken by the rounded z of the detector.
    """
    from .joins import literal_table, match_planted
    from .trends import top_k_by_z

    pairs = sorted(set(planted))
    kinds = {name: kind for name, kind in flags.dtypes}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    table = literal_table(flags.sparkSession, pairs, schema)
    outcome = match_planted(flags.where(F.col(rule)), table, keys)
    tops = top_k_by_z(flags, len(pairs)).join(table, list(keys), "left_semi").agg(F.count("*")).scalar()

    def of(kind: str) -> Column:
        return F.count_if(F.col("outcome") == kind)

    counted = outcome.agg(of("tp").alias("tp"), of("fp").alias("fp"), of("fn").alias("fn"))
    flagged = F.col("tp") + F.col("fp")
    return counted.select(
        F.lit(rule).alias("rule"), "tp", "fp", "fn", flagged.alias("n_flagged"),
        F.try_divide(F.col("tp"), flagged).alias("precision"),
        (F.col("tp") / F.lit(len(pairs))).alias("recall"),
        (tops / F.lit(len(pairs))).alias("precision_at_k"),
    )


def stage_summary(reviews: DataFrame, stages: Sequence[str]) -> DataFrame:
    """(stage, status, n) for the status column of every stage, from one pass over the rows."""
    finest = reviews.groupBy(*stages).agg(F.count("*").alias("n"))
    cells = F.array(
        *[F.struct(F.lit(s).alias("stage"), F.coalesce(F.col(s), F.lit("none")).alias("status")) for s in stages]
    )
    return finest.select(F.inline(cells), "n").groupBy("stage", "status").agg(F.sum("n").alias("n"))
