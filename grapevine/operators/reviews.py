"""Projections and filters on reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..fixed import ID_PREFIX, SENTIMENTS, SOURCE
from ..functions.labels import estimated_stars_to_label, is_negative_with_issue
from ..functions.text import canonical_topic, empty_to_null, strip_text, without_prefix
from ..schemas import ALERT_COLUMNS, OUTPUT_COLUMNS, QUEUE_COLUMNS
from .joins import with_predictions


def to_unified(raw: DataFrame, language: Column | str, prefix: str = ID_PREFIX, source: str = SOURCE) -> DataFrame:
    """Raw (id, text, label 0-4) as unified reviews. Other columns of ``raw`` are kept behind them."""
    lang = F.lit(language) if isinstance(language, str) else language
    unified = {
        "review_id": F.concat(F.lit(prefix), F.col("id").cast("string")),
        "source": F.lit(source),
        "product_category": F.lit(None).cast("string"),
        "rating": (F.col("label") + 1).cast("int"),
        "review_text": strip_text(F.col("text")),
        "detected_language": lang,
        "translated_text": F.lit(None).cast("string"),
        "review_date": F.lit(None).cast("date"),
    }
    kept = [c for c in raw.columns if c not in {"id", "text", "label", *unified}]
    return raw.select(*[value.alias(name) for name, value in unified.items()], *kept)


def drop_empty_text(reviews: DataFrame, text: str = "review_text") -> DataFrame:
    """Reviews with text left after stripping. Applied after sampling, so a stratum can end short."""
    return reviews.where(F.length(strip_text(F.col(text))) > 0)


def blank_category_to_null(reviews: DataFrame, column: str = "product_category") -> DataFrame:
    return reviews.withColumn(column, empty_to_null(F.col(column)))


def negatives(reviews: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Reviews predicted negative, with their canonical topic."""
    predicted = with_predictions(reviews, cache, key)
    return predicted.withColumn("topic", canonical_topic(F.col("pred_topic"))).where(F.col("pred") == "negative")


def negative_with_issue(reviews: DataFrame, sentiment: str = "sentiment", issue: str = "issue_category") -> DataFrame:
    return reviews.where(is_negative_with_issue(F.col(sentiment), F.col(issue)))


def split_by_language(
    reviews: DataFrame, language: str = "en", column: str = "detected_language"
) -> tuple[DataFrame, DataFrame]:
    """(same language, all others). The comparison is case-sensitive; a null language is "other"."""
    same = F.col(column).eqNullSafe(F.lit(language))
    return reviews.where(same), reviews.where(~same)


def english_passthrough(reviews: DataFrame) -> DataFrame:
    """English reviews keep their text as translation."""
    none = F.lit(None).cast("string")
    return reviews.withColumns(
        {
            "translated_text": F.col("review_text"),
            "translation_language": F.lit("en"),
            "translation_status": F.lit("not_needed"),
            "translation_error": none,
            "translation_prompt": none,
            "translation_model": none,
        }
    )


def validate_requests(
    requests: DataFrame, text: str = "text", sentiment: str = "sentiment", max_chars: int = 4000
) -> DataFrame:
    """Add ``reject_reason``: null for a valid request row."""
    size = F.length(text)
    reason = (
        F.when(F.col(text).isNull() | (size == 0), "text is empty")
        .when(size > max_chars, f"text is longer than {max_chars} characters")
        .when(F.col(sentiment).isNotNull() & ~F.col(sentiment).isin(SENTIMENTS), "unknown sentiment")
    )
    return requests.withColumn("reject_reason", reason)


def validate_request_sizes(requests: DataFrame, request: str, max_reviews: int = 20) -> DataFrame:
    """Reviews per request, and why a request as a whole is refused (null when it is fine)."""
    sizes = requests.groupBy(request).agg(F.count("*").alias("reviews"))
    reason = F.when(F.col("reviews") > max_reviews, f"more than {max_reviews} reviews in one request")
    return sizes.withColumn("reject_reason", reason)


def split_rejected(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their reason)."""
    valid = F.col("reject_reason").isNull()
    return requests.where(valid).drop("reject_reason"), requests.where(~valid)


def drop_missing_predictions(rows: DataFrame, column: str, watch: Observation | None = None) -> DataFrame:
    """Rows that have a value in ``column``. ``watch`` receives the dropped count with the first action."""
    missing = F.count_if(F.col(column).isNull())
    seen = rows.observe(watch, missing.alias("missing")) if watch is not None else rows
    return seen.where(F.col(column).isNotNull())


def issue_gate(reviews: DataFrame, issue: str = "issue") -> tuple[DataFrame, DataFrame]:
    """(negative reviews that still lack an issue phrase, all others)."""
    lacking = F.col(issue).isNull() | (F.col(issue) == "")
    needed = F.coalesce((F.col("sentiment") == "negative") & lacking, F.lit(False))
    return reviews.where(needed), reviews.where(~needed)


def fill_missing_labels(requests: DataFrame) -> DataFrame:
    """Keep the sentiment and topic that came with a request, else take the classified ones."""
    return requests.withColumns(
        {
            "sentiment": F.coalesce("sentiment", "pred_sentiment"),
            "topic": F.coalesce("topic", "pred_topic"),
        }
    )


def label_from_stars(rows: DataFrame, stars: str = "stars_pred") -> DataFrame:
    return rows.withColumn("pred_from_stars", estimated_stars_to_label(F.col(stars)))


def raw_id(column: str = "review_id", prefix: str = ID_PREFIX) -> Column:
    return without_prefix(F.col(column), prefix)


def alert_table(flags: DataFrame) -> DataFrame:
    """Detector rows with week start in the column order of an alert."""
    renamed = flags.withColumnRenamed("group", "issue_category")
    return renamed.select(*ALERT_COLUMNS)


def queue_table(rows: DataFrame) -> DataFrame:
    """Judged replies in the column order of the human review sheet, with the two columns to fill."""
    return rows.withColumns({"human_accept": F.lit(""), "human_comment": F.lit("")}).select(*QUEUE_COLUMNS)


def output_table(rows: DataFrame, columns: Sequence[str] = tuple(OUTPUT_COLUMNS)) -> DataFrame:
    """The 17 columns of the appended result, in their fixed order."""
    return rows.select(*columns)

