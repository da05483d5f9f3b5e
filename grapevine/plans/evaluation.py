"""Evaluation jobs: sentiment against star ratings, issue assignment against clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..fixed import ISSUE_CHARS, LANGUAGES, SENTIMENTS
from ..functions.labels import stars_to_label
from ..functions.text import cache_key, one_line
from ..operators import aggregates as a
from ..operators.infer import Caller, answers_by_id, batch_payload, infer_batches
from ..operators.joins import attach_cached, latest_per_key, pending_rows
from ..operators.reviews import drop_missing_predictions, label_from_stars
from ..operators.sampling import dev_test_split, first_examples, sample_n
from ..operators.spend import estimate_cost
from ..sources.readers import read_cache
from ..sources.writers import append_cache
from ..storage import materialise
from .replies import read_or_empty
from .stages import assign_issues


class ConfirmationNeeded(RuntimeError):
    """The estimated cost of a run is above what may be spent unasked."""


def evaluation_split(rows: DataFrame, split: str, ordinal: str = "ordinal") -> DataFrame:
    """Reviews of one split with their label from the star rating."""
    labelled = rows.withColumn("label", stars_to_label(F.col("rating")))
    return dev_test_split(labelled, ["detected_language", "rating"], ordinal).where(F.col("split") == split)


def sentiment_eval(
    rows: DataFrame,
    caller: Caller,
    cache_path: str,
    prompt: str,
    seq: int,
    confirmed: bool = False,
    languages=tuple(LANGUAGES),
) -> dict[str, DataFrame]:
    """Classify what is not cached, then score the label and the star-derived label.

    ``rows`` have a ``label``. A failed batch is left out of the measures and retried by the next run; ``missing``
    counts such rows. Texts go to the model and nowhere else: responses keep the keys, and the measures are taken without them;
    ``rows`` has all columns and is joined when it is read.
    """
    spark = rows.sparkSession
    key = cache_key(F.lit(prompt), F.lit(caller.model), F.col("review_id"))
    keyed = rows.withColumn("key", key)
    asked = keyed.select("key", "review_id", "review_text")
    todo = materialise(pending_rows(asked, read_or_empty(spark, cache_path, schemas.PREDICTION_CACHE)), name="pending")
    plan = estimate_cost(todo)
    if not confirmed and plan.first()["needs_confirmation"]:
        raise ConfirmationNeeded("the estimated cost is above the limit; confirm the run first")
    responses = infer_batches(
        todo, caller, "review_id", batch_payload("review_id", "review_text"), 10, "classify", keep=["key", "review_id"])
    answered = answers_by_id(responses, schemas.CLASSIFICATIONS, "classifications", "review_id")
    fresh = answered.where(F.col("answer").isNotNull()).select("key", "answer.*")
    append_cache(fresh, cache_path, seq)
    cache = latest_per_key(read_cache(spark, cache_path, schemas.PREDICTION_CACHE))
    fields = {"sentiment": "pred", "topic": "topic", "confidence": "conf", "stars": "stars_pred"}
    attached = materialise(attach_cached(keyed.drop("review_text"), cache, fields), name="sentiment-eval")
    scored = label_from_stars(drop_missing_predictions(attached, "pred"))
    with_stars = scored.where(F.col("pred_from_stars").isNotNull())
    return {
        "plan": plan,
        "missing": attached.agg(F.count_if(F.col("pred").isNull()).alias("missing")),
        "report": a.classification_report(scored, languages=languages),
        "report_from_stars": a.classification_report(with_stars, pred="pred_from_stars", languages=languages),
        "topics": a.value_counts(scored, "topic"),
        "confusion": a.crosstab(scored, "label", "pred", SENTIMENTS),
        "rows": label_from_stars(drop_missing_predictions(attach_cached(keyed, cache, fields), "pred")),
    }


def issue_assignment_eval(clusters: DataFrame, caller: Caller, n: int | None = 100, seed: int = 1) -> dict[str, DataFrame]:
    """How far the model's category agrees with the cluster of a review, on ``n`` seeded rows, all for None."""
    sample = sample_n(clusters, "review_id", n, seed)
    assigned, responses = assign_issues(sample, caller, length=ISSUE_CHARS)
    differ = F.col("category").isNotNull() & (F.col("cluster") != F.col("category"))
    shown = assigned.withColumn("text_start", one_line(F.col("review_text"), 110))
    return {
        "agreement": a.assignment_agreement(assigned, "cluster", "category"),
        "categories": a.value_counts(assigned.where(F.col("category").isNotNull()), "category"),
        "examples": first_examples(shown, differ, "review_id"),
        "calls": responses,
    }
