"""The stacker from labelled reviews to its report: baseline, cached answers, variants, reference rows, confusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import SENTIMENTS
from ..functions.labels import estimated_stars_to_label
from ..operators.aggregates import model_scores
from ..operators.joins import with_predictions
from ..operators.models import predict_by_language, stack_variants, train_by_language
from ..storage import materialise


def stacker_evaluation(
    learn: DataFrame, train: DataFrame, test: DataFrame, cache: DataFrame, languages: Sequence[str],
    id_column: str = "review_id", language: str = "detected_language", text: str = "review_text", label: str = "label", folds: int = 5, seed: int = 0,
) -> dict[str, DataFrame]:
    """``scores`` of three reference rows and the four variants, and the ``confusion`` of the selected one on the test rows.

    The baseline learns from ``learn`` and gives its probabilities for ``train`` and ``test``; both are joined with the cached answers by
    their ``key``, and rows without an answer take no part. A class that the baseline of a language has not seen has probability 0.
    The references are the baseline's label, the answer's label and the label of its estimated stars, on the test rows.
    """
    models, terms = train_by_language(learn, language, text, label, languages)

    def answered(rows: DataFrame, name: str) -> DataFrame:
        known = with_predictions(rows.select("key", id_column, language, text, F.col(label).alias("label")), cache)
        scored = predict_by_language(models, terms, known, language, text)
        chances = {f"p_{k}": F.coalesce(F.col(f"p_{k}"), F.lit(0.0)) for k in SENTIMENTS}
        return materialise(scored.withColumns(chances).drop(text), name=name)

    train_rows, test_rows = answered(train, "stacker-train"), answered(test, "stacker-test")
    scores, confusion = stack_variants(train_rows, test_rows, id_column, folds, seed)
    references = {
        "baseline": F.col("predicted"), "label of the answer": F.col("pred"), "label of the estimated stars": estimated_stars_to_label(F.col("stars_pred")),
    }
    report = scores
    for name, guess in references.items():
        own = model_scores(test_rows.withColumn("_guess", F.coalesce(guess, F.lit("none"))), "label", "_guess")
        report = report.unionByName(own.select(F.lit(name).alias("model"), F.lit("test").alias("split"), "*", F.lit(False).alias("selected")))
    return {"scores": report, "confusion": confusion}
