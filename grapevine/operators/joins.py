"""Lookups, joins to cached answers and join-backs.

No strategy is forced unless a side is a literal table whose size is known when the plan is built; for
everything else adaptive execution decides from the sizes it measures and splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import NO_CATEGORY, NO_CATEGORY_LABEL, VERIFIED_SOURCE
from ..functions.text import canonical_topic, strip_text, title_body_text, without_prefix
from .positions import first_n

LITERAL_ROWS = 10_000


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table given in code. Marked for broadcast, which its checked length allows."""
    if len(rows) > LITERAL_ROWS:
        raise ValueError(f"a literal table holds at most {LITERAL_ROWS} rows; write a table instead")
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def keep_first(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row per key: the first in file order. Copies are dropped before the shuffle."""
    return first_n(df, [key], [F.col(ordinal)], 1)


def keep_last(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row per key: the last in file order."""
    return first_n(df, [key], [F.col(ordinal).desc()], 1, [F.col(ordinal)])


def category_lookup(
    reviews: DataFrame, lookup: DataFrame, raw_id: str, key: str = "id", value: str = "product_category"
) -> DataFrame:
    """Left lookup; a missing or empty category becomes null and the row stays.

    When ``lookup`` has an ``ordinal`` column the last entry per key wins; else keys must be unique.
    """
    table = keep_last(lookup, key, "ordinal") if "ordinal" in lookup.columns else lookup
    table = table.select(F.col(key).alias("_id"), F.nullif(strip_text(F.col(value)), F.lit("")).alias(value))
    return reviews.drop(value).join(table, F.col(raw_id) == F.col("_id"), "left").drop("_id")


def missing_ids(reviews: DataFrame, source: DataFrame, id_column: str, key: str) -> DataFrame:
    """Ids that the source does not know. Copies are dropped on both sides before ids meet."""
    return (
        reviews.select(F.col(id_column).alias("missing_id"))
        .distinct()
        .join(source.select(F.col(key).alias("missing_id")).distinct(), "missing_id", "left_anti")
    )


def _paired(reviews: DataFrame, source: DataFrame, prefix: str) -> DataFrame:
    """Each review with the first source row of its id, and what differs."""
    rows = reviews.withColumn("_raw_id", without_prefix(F.col("review_id"), prefix))
    ids = rows.select(F.col("_raw_id").alias("review_id")).distinct()
    needed = source.join(ids, "review_id", "left_semi")
    first = keep_first(needed, "review_id", "ordinal").select(
        F.col("review_id").alias("_raw_id"),
        F.col("product_id").alias("_product_id"),
        F.col("product_category").alias("_category"),
        F.col("stars").alias("_stars"),
        title_body_text(F.col("review_title"), F.col("review_body")).alias("_text"),
        F.lit(True).alias("_found"),
    )
    same_stars = F.col("_stars").eqNullSafe(F.col("rating"))
    same_text = F.col("_text").eqNullSafe(strip_text(F.col("review_text")))
    problem = (
        F.when(F.col("_found").isNull(), "id not found in the source")
        .when(~same_stars, "star rating differs from the source")
        .when(~same_text, "review text differs from the source")
    )
    return rows.join(first, "_raw_id", "left").withColumn("_problem", problem)


def verification_counts(reviews: DataFrame, source: DataFrame, prefix: str) -> DataFrame:
    """One row: reviews, and how many are missing or differ in stars or text."""
    paired = _paired(reviews, source, prefix)

    def having(text: str) -> Column:
        return F.count_if(F.coalesce(F.col("_problem").startswith(text), F.lit(False)))

    return paired.agg(
        F.count("*").alias("reviews"),
        having("id not found").alias("missing"),
        having("star").alias("different_stars"),
        having("review text").alias("different_text"),
    )


def verified_enrich(reviews: DataFrame, source: DataFrame, prefix: str) -> DataFrame:
    """Take product id and category from ``source`` after checking every row against it.

    ``source`` has (ordinal, review_id, product_id, product_category, stars, review_title, review_body).
    A row that is missing there, or differs, fails the job, so a sink commits nothing. The check sits in
    a filter: no later column pruning can drop it, and the data is read once.
    """
    text = F.concat(F.col("review_id"), F.lit(": "), F.col("_problem"))
    checked = F.when(F.col("_problem").isNull(), True).otherwise(F.raise_error(text).cast("boolean"))
    return (
        _paired(reviews, source, prefix)
        .where(checked)
        .withColumn("product_id", F.col("_product_id"))
        .withColumn("product_category", F.col("_category"))
        .withColumn("source", F.lit(VERIFIED_SOURCE))
        .drop("_raw_id", "_product_id", "_category", "_stars", "_text", "_found", "_problem")
    )


def pending_rows(rows: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Rows whose key is not cached yet. The cache may hold a key many times; each meets the rows once."""
    return rows.join(cache.select(key).distinct(), key, "left_anti")


def latest_per_key(cache: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The last record per key."""
    return keep_last(cache, key, seq)


def _last_records(cache: DataFrame, key: str) -> DataFrame:
    """One record per key: the last of those with a ``seq``; without one, the records are taken as they are."""
    return latest_per_key(cache, key) if "seq" in cache.columns else cache


def with_predictions(rows: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Rows that have a cached classification, with its label, confidence and stars as numbers; of a key's records the last."""
    answers = _last_records(cache, key).select(
        key,
        F.col("sentiment").alias("pred"),
        F.col("topic").alias("pred_topic"),
        F.col("confidence").cast("double").alias("conf"),
        F.col("stars").cast("double").alias("stars_pred"),
    )
    return rows.join(answers, key)


def attach_cached(
    rows: DataFrame, cache: DataFrame, fields: Mapping[str, str], key: str = "key"
) -> DataFrame:
    """Left join of cached fields, renamed as ``fields`` says; rows without an answer keep nulls. The last record of a key counts."""
    answers = _last_records(cache, key).select(key, *[F.col(old).alias(new) for old, new in fields.items()])
    return rows.join(answers, key, "left")


def join_back(
    rows: DataFrame, answers: DataFrame, keys: Sequence[str], missing: str = "missing from response"
) -> DataFrame:
    """Answers matched to the rows that asked; rows without one get an error, extra answers are ignored."""
    marked = answers.withColumn("_answered", F.lit(True))
    joined = rows.join(marked, list(keys), "left")
    error = F.when(F.col("_answered").isNull(), F.lit(missing))
    return joined.withColumn("error", error).drop("_answered")


def label_lookup(rows: DataFrame, labels: Mapping[int, str], cluster: str, name: str = "label") -> DataFrame:
    """Label of a cluster id from a literal table; the id for "none fits" has its own label."""
    table = literal_table(rows.sparkSession, list(labels.items()), f"_cluster int, {name} string")
    joined = rows.join(table, F.col(cluster).cast("int") == F.col("_cluster"), "left").drop("_cluster")
    label = F.when(F.col(cluster) == NO_CATEGORY, NO_CATEGORY_LABEL).otherwise(F.col(name))
    return joined.withColumn(name, label)


def match_planted(flagged: DataFrame, planted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each (keys) pair once, marked ``tp``, ``fp`` or ``fn``."""
    left = flagged.select(*keys).distinct().withColumn("_flagged", F.lit(True))
    right = planted.select(*keys).distinct().withColumn("_planted", F.lit(True))
    outcome = (
        F.when(F.col("_planted").isNull(), "fp").when(F.col("_flagged").isNull(), "fn").otherwise("tp")
    )
    joined = left.join(right, list(keys), "full_outer")
    return joined.select(*keys, outcome.alias("outcome"))


def pick_playbook(reviews: DataFrame, playbooks: DataFrame) -> DataFrame:
    """Guidance for (sentiment, topic); unknown topics use ``other``, an unknown sentiment is an error.

    ``playbooks`` has (sentiment, topic, playbook): sentiments x topics rows, so Catalyst or the caller's
    literal table broadcasts it.
    """
    rows = reviews.withColumn("topic", canonical_topic(F.col("topic")))
    joined = rows.join(playbooks, ["sentiment", "topic"], "left")
    problem = F.concat(F.lit("no playbook for "), F.coalesce("sentiment", F.lit("null")), F.lit("/"), F.col("topic"))
    guidance = F.when(F.col("playbook").isNotNull(), F.col("playbook")).otherwise(F.raise_error(problem).cast("string"))
    return joined.withColumn("playbook", guidance).select(*rows.columns, "playbook")


def pick_by_keyword(
    labels: DataFrame, keywords: Sequence[str], largest: DataFrame, wanted: int = 3
) -> DataFrame:
    """Per keyword the first cluster whose label contains it; fewer than ``wanted`` hits: the largest.

    ``labels`` has (ordinal, cluster, label); ``largest`` has (cluster, size). The keyword list is expanded on
    each label, so no pair of tables is multiplied out.
    """
    words = F.array(*[F.lit(word) for word in keywords])
    hits = F.filter(words, lambda word: F.contains(F.lower("label"), F.lower(word)))
    found = (
        labels.select("ordinal", "cluster", F.explode(hits).alias("keyword"))
        .groupBy("keyword")
        .agg(F.min_by("cluster", "ordinal").alias("cluster"))
        .select(F.col("cluster").cast("bigint").alias("cluster"))
    )
    n_found = found.agg(F.count("*")).scalar()
    fallback = (
        largest.orderBy(F.desc("size"), F.asc("cluster"))
        .limit(wanted)
        .select(F.col("cluster").cast("bigint").alias("cluster"))
    )
    return found.where(n_found >= wanted).unionByName(fallback.where(n_found < wanted))
