"""Ingest jobs: raw reviews to verified unified reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import ID_PREFIX, SOURCE
from ..operators.aggregates import distinct_count, ingestion_summary
from ..operators.infer import Caller
from ..operators.joins import category_lookup, missing_ids, verification_counts, verified_enrich
from ..operators.reviews import drop_empty_text, raw_id, to_unified
from ..operators.sampling import stratified_sample, top_groups
from .stages import translate_all


def ingest(
    raw: DataFrame,
    lookup: DataFrame | None = None,
    per_star: int | None = 40,
    seed: int = 42,
    prefix: str = ID_PREFIX,
    source: str = SOURCE,
) -> DataFrame:
    """Stratified sample of raw (id, text, label, language) as unified reviews with category and time stamp.

    ``per_star`` rows per language and label, all for None.

    Reviews without text leave after sampling. Without a lookup the category stays null.
    """
    sample = stratified_sample(raw, ["language", "label"], "id", per_star, seed)
    reviews = drop_empty_text(to_unified(sample, F.col("language"), prefix, source).drop("language"))
    if lookup is not None:
        keyed = reviews.withColumn("_raw", raw_id(prefix=prefix))
        order = [c for c in reviews.columns]
        reviews = category_lookup(keyed, lookup, "_raw").select(*order)
    return reviews.withColumn("ingested_at", F.current_timestamp())


def ingest_translate(raw: DataFrame, caller: Caller, lookup: DataFrame | None = None, **options):
    """(translated reviews, translation responses) of a fresh sample."""
    return translate_all(ingest(raw, lookup, **options), caller)


def enrich_samples(sample: DataFrame, source: DataFrame, prefix: str = ID_PREFIX) -> dict[str, DataFrame]:
    """Verified and enriched sample, what the check found, ids the source lacks, and the top categories."""
    enriched = verified_enrich(sample, source, prefix)
    ids = sample.withColumn("_raw", raw_id(prefix=prefix))
    return {
        "reviews": enriched,
        "check": verification_counts(sample, source, prefix),
        "missing": missing_ids(ids, source, "_raw", "review_id"),
        "categories": distinct_count(enriched, "product_category"),
        "top": top_groups(enriched, "product_category", 4),
    }


__all__ = ["enrich_samples", "ingest", "ingest_translate", "ingestion_summary"]
