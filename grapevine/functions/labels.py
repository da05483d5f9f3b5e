"""Labels, flags and states derived row by row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import AUTO_APPROVED, DIMENSIONS, DRAFT_READY, FLAG_NAMES, PENDING


def stars_to_label(stars: Column) -> Column:
    """1-2 negative, 3 neutral, 4-5 positive."""
    return (
        F.when(stars <= 2, "negative").when(stars == 3, "neutral").when(stars.isNotNull(), "positive")
    )


def whole_stars(estimate: Column) -> Column:
    """Estimate clamped to 1..5 and rounded half to even."""
    clamped = F.least(F.greatest(estimate, F.lit(1.0)), F.lit(5.0))
    return F.when(estimate.isNotNull(), F.rint(clamped).cast("int"))


def estimated_stars_to_label(estimate: Column) -> Column:
    return stars_to_label(whole_stars(estimate))


def is_negative_with_issue(sentiment: Column, issue: Column) -> Column:
    """Never null, so it can be counted as well as filtered on."""
    return F.coalesce((sentiment == "negative") & (issue != ""), F.lit(False))


def acceptable(score: Column | None = None) -> Column:
    """All four scores at least 4 and no promise, invention or wrong language.

    The human-attention flag does not count here. ``score`` is a struct; by default the fields
    are columns of the frame.
    """
    def field(name: str) -> Column:
        return F.col(name) if score is None else score[name]

    verdict = F.lit(True)
    for name in DIMENSIONS:
        verdict = verdict & (field(name) >= 4)
    for name in ("promises_outcome", "invents_facts", "wrong_language"):
        verdict = verdict & ~field(name)
    return verdict


def queue_status(sentiment: Column, accepted: Column, needs_human: Column) -> Column:
    """Only an accepted, non-negative draft that needs no human is approved; no judge means pending."""
    approved = (sentiment != "negative") & accepted & ~needs_human
    return F.when(approved, AUTO_APPROVED).otherwise(PENDING)


def queue_status_nojudge(sentiment: Column) -> Column:
    return F.when(sentiment == "negative", PENDING).otherwise(DRAFT_READY)


def raised_flags(names: Mapping[str, str] = FLAG_NAMES, score: Column | None = None) -> Column:
    """Display names of the flags that are set, in rubric order."""
    def field(name: str) -> Column:
        return F.col(name) if score is None else score[name]

    return F.array_compact(F.array(*[F.when(field(flag), F.lit(text)) for flag, text in names.items()]))
