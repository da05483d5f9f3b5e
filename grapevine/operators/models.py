"""Sentiment models on Spark ML: one text model per language, and the stacker on top."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import SENTIMENTS
from ..storage import materialise, new_folder
from .aggregates import scores_from_counts
from .sampling import stratified_folds
from .text_features import char_gram_counts, numbered_terms, tfidf_weights, vocabulary, with_vectors

TOLERANCE = 1e-4
INTERCEPT = 100.0  # the constant feature of a language's intercept; its penalty falls with the square


@dataclass
class LanguageModel:
    """A model of several languages that have seen the same classes: each language's terms are a block of its features.

    ``offsets`` gives the first feature of each language; its last is the language's own intercept.
    """

    model: LogisticRegressionModel
    classes: list[str]
    offsets: dict[str, int]
    size: int


def _stored(model: LogisticRegressionModel, spark: SparkSession) -> LogisticRegressionModel:
    """The model read back from the shared folder: coefficients only, without the training data's plan in its summary."""
    path = new_folder(spark, "model")
    model.write().save(path)
    return LogisticRegressionModel.load(path)


def _class_index(label: Column, classes: Sequence[str]) -> Column:
    index = F.lit(None).cast("double")
    for i, name in enumerate(classes):
        index = F.when(label == name, float(i)).otherwise(index)
    return index


def _by_language(language: str, values: Mapping[str, int] | Mapping[str, float]) -> Column:
    pairs = [part for name, value in values.items() for part in (F.lit(name), F.lit(value))]
    return F.try_element_at(F.create_map(*pairs), F.col(language))


def _in_blocks(weighed: DataFrame, language: str, offsets: Mapping[str, int], ends: Mapping[str, int], size: int) -> DataFrame:
    """Add ``features``: a row's terms in the block of its language, and ``INTERCEPT`` in the block's last place."""
    start, end = _by_language(language, offsets), _by_language(language, ends)
    places = F.concat(F.transform("tfidf.indices", lambda i: i + start), F.array(end))
    return with_vectors(weighed, places, F.concat("tfidf.weights", F.array(F.lit(INTERCEPT))), size)


def train_by_language(
    rows: DataFrame,
    language: str,
    text: str,
    label: str,
    languages: Sequence[str],
    c: float = 3.0,
    iterations: int = 1000,
    classes: Sequence[str] = tuple(SENTIMENTS),
) -> tuple[dict[str, LanguageModel], DataFrame]:
    """One multinomial model per language on character TF-IDF. Returns the models and their term table, with grams as numbers.

    Languages that have seen the same classes are fitted together: with a block of features each, the sum of their losses and penalties falls
    apart into theirs, so one pass over the rows per iteration sums the gradients of them all. A language's intercept is the
    weight of a large constant feature, which the penalty hardly touches.
    """
    counted = char_gram_counts(rows.where(F.col(language).isin(list(languages))).select(language, text, label), text, spelled=False).drop(text)
    counted = materialise(counted, name="grams")
    terms = materialise(vocabulary(counted, language), name="vocabulary")
    weighed = tfidf_weights(counted, terms, language).drop("grams")
    sizes = {r[0]: r[1] for r in terms.groupBy(language).count().collect()}
    present: dict[str, dict[str, int]] = {}
    for lang, name, n in counted.groupBy(language, label).count().collect():
        present.setdefault(lang, {})[name] = n
    alike: dict[tuple[str, ...], list[str]] = {}
    for lang in languages:
        seen = tuple(k for k in classes if present.get(lang, {}).get(k))
        if len(seen) >= 2 and lang in sizes:
            alike.setdefault(seen, []).append(lang)
    models: dict[str, LanguageModel] = {}
    for seen, members in alike.items():
        n = sum(present[lang][k] for lang in members for k in seen)
        offsets, ends, size = {}, {}, 0
        for lang in members:
            offsets[lang], ends[lang] = size, size + sizes[lang]
            size += sizes[lang] + 1
        mine = weighed.where(F.col(language).isin(members)).withColumn("label", _class_index(F.col(label), seen))
        data = _in_blocks(mine.where(F.col("label").isNotNull()), language, offsets, ends, size).select("features", "label")
        estimator = LogisticRegression(
            regParam=1 / (c * n), standardization=False, maxIter=iterations, tol=TOLERANCE, family="multinomial"
        )
        fitted = _stored(estimator.fit(data), rows.sparkSession)
        models |= dict.fromkeys(members, LanguageModel(fitted, list(seen), offsets, size))
    return models, terms


def predict_by_language(
    models: Mapping[str, LanguageModel],
    terms: DataFrame,
    rows: DataFrame,
    language: str,
    text: str,
    classes: Sequence[str] = tuple(SENTIMENTS),
) -> DataFrame:
    """Label and one probability column per class, by the model of the row's language.

    A class the model never saw stays null. Rows of a language without a model keep null predictions. Rows are read once per model, of which
    there is one for all languages that have seen the same classes.
    """
    none = F.lit(None)
    other = ~F.coalesce(F.col(language).isin(list(models)), F.lit(False))
    parts = [
        rows.where(other).select(
            "*", none.cast("string").alias("predicted"), *[none.cast("double").alias(f"p_{k}") for k in classes]
        )
    ]
    if not models:
        return parts[0]
    known = char_gram_counts(rows.where(~other), text, name="_grams", spelled=False)
    known = materialise(known.withColumn("_row", F.monotonically_increasing_id()), name="counted")
    numbered = numbered_terms(terms, language)
    pieces = known.select("_row", F.col(language).alias("_lang"), F.inline(F.arrays_zip("_grams.gram", "_grams.tf")).alias("gram", "tf"))
    for fitted in {id(m): m for m in models.values()}.values():
        members = list(fitted.offsets)
        mine = pieces.where(F.col("_lang").isin(members))
        sums = _weighed_sums(mine, _coefficients(fitted, numbered, language), len(fitted.classes)).withColumnRenamed("_row", "_at")
        scored = known.where(F.col(language).isin(members)).drop("_grams").join(sums, F.col("_row") == F.col("_at"), "left")
        base = _intercepts(fitted)
        margins = F.array(*[F.coalesce(f"_s{k}", F.lit(0.0)) + _by_language(language, base[k]) for k in range(len(fitted.classes))])
        scored = scored.withColumn("_margins", margins).withColumn("_top", F.array_max("_margins"))
        scored = scored.withColumn("_shares", F.transform("_margins", lambda m: F.exp(m - F.col("_top"))))
        scored = scored.withColumn("_whole", F.aggregate("_shares", F.lit(0.0), lambda total, x: total + x))
        name = F.element_at(F.array(*[F.lit(k) for k in fitted.classes]), F.array_position("_margins", F.col("_top")).cast("int"))
        chances = [
            (F.get("_shares", F.lit(fitted.classes.index(k))) / F.col("_whole") if k in fitted.classes else none.cast("double")).alias(f"p_{k}")
            for k in classes
        ]
        parts.append(scored.select(*rows.columns, name.alias("predicted"), *chances))
    return reduce(DataFrame.unionByName, parts)


def _coefficients(fitted: LanguageModel, numbered: DataFrame, language: str) -> DataFrame:
    """(_language, gram, idf, _w0, ..): the terms of the model's languages with their coefficient per class."""
    matrix = fitted.model.coefficientMatrix.toArray()
    table = {"_place": np.arange(fitted.size, dtype=np.int32)} | {f"_w{k}": row for k, row in enumerate(matrix)}
    own = numbered.where(F.col(language).isin(list(fitted.offsets))).withColumn("_place", _by_language(language, fitted.offsets) + F.col("index"))
    known = own.join(numbered.sparkSession.createDataFrame(pa.table(table)), "_place")
    return materialise(known.select(F.col(language).alias("_language"), "gram", "idf", *[f"_w{k}" for k in range(len(matrix))]), name="coefficients")


def _intercepts(fitted: LanguageModel) -> list[dict[str, float]]:
    """Per class each language's intercept: the model's, and the weight of the constant in the last place of the language's block."""
    matrix, common = fitted.model.coefficientMatrix.toArray(), fitted.model.interceptVector.toArray()
    return [
        {lang: float(INTERCEPT * row[end] + more) for lang, end in _ends(fitted).items()} for row, more in zip(matrix, common, strict=True)
    ]


def _ends(fitted: LanguageModel) -> dict[str, int]:
    """The last place of each language's block."""
    return {lang: end - 1 for lang, end in zip(fitted.offsets, [*list(fitted.offsets.values())[1:], fitted.size], strict=True)}


def _weighed_sums(pieces: DataFrame, coefficients: DataFrame, classes: int) -> DataFrame:
    """(_row, _s0, ..): the TF-IDF weights of a row, scaled to length 1, times the coefficients of each class.

    Sums are taken where pieces meet their terms, so what moves is one row per text and task, not its terms.
    """
    found = pieces.join(coefficients, (pieces["gram"] == coefficients["gram"]) & (pieces["_lang"] == coefficients["_language"]))
    found = found.withColumn("_v", (1 + F.log("tf")) * F.col("idf"))
    sums = found.groupBy("_row").agg(
        F.sum(F.col("_v") * F.col("_v")).alias("_square"), *[F.sum(F.col("_v") * F.col(f"_w{k}")).alias(f"_s{k}") for k in range(classes)])
    return sums.select("_row", *[(F.col(f"_s{k}") / F.sqrt("_square")).alias(f"_s{k}") for k in range(classes)])


def stack_features(
    rows: DataFrame, use_baseline: bool, pred: str = "pred", conf: str = "conf", stars: str = "stars_pred"
) -> DataFrame:
    """Add ``features``: three one-hot columns, confidence, stars and optionally three baseline probabilities."""
    hot = {f"_is_{k}": (F.col(pred) == k).cast("double") for k in SENTIMENTS}
    inputs = [*hot, conf, stars, *([f"p_{k}" for k in SENTIMENTS] if use_baseline else [])]
    assembled = VectorAssembler(inputCols=inputs, outputCol="features").transform(rows.withColumns(hot))
    return assembled.drop(*hot)


VARIANTS = [(False, False), (False, True), (True, False), (True, True)]


def variant_name(use_baseline: bool, balanced: bool) -> str:
    return "stacker" + (" + baseline" if use_baseline else "") + (", balanced" if balanced else "")


def _fit(train: DataFrame, counts: Mapping[str, int], classes: Sequence[str], balanced: bool):
    n = sum(counts.values())
    weight = F.lit(1.0)
    if balanced:
        weight = F.lit(None).cast("double")
        for k in classes:
            weight = F.when(F.col("label") == k, n / (len(classes) * counts[k])).otherwise(weight)
    data = train.select("features", _class_index(F.col("label"), classes).alias("y"), weight.alias("w"))
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    regression = LogisticRegression(
        featuresCol="scaled", labelCol="y", weightCol="w", regParam=1 / n, standardization=False,
        maxIter=2000, tol=TOLERANCE, family="multinomial",
    )
    return Pipeline(stages=[scaler, regression]).fit(data)


def _predict(model, rows: DataFrame, classes: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(k) for k in classes])
    label = F.element_at(names, F.col("prediction").cast("int") + 1)
    return model.transform(rows).select("label", label.alias("stacked"))


def stack_select(
    train: DataFrame, test: DataFrame, id_column: str, folds: int = 5, seed: int = 0, parallelism: int = 8
) -> DataFrame:
    """Scores of the four stacker variants by cross-validation and on the test rows; one is ``selected``.

    The selected variant has the highest cross-validated macro-F1; the first one wins ties. ``train`` and ``test`` have
    label, pred, conf, stars_pred and the three baseline probabilities.
    """
    return stack_variants(train, test, id_column, folds, seed, parallelism)[0]


def stack_variants(
    train: DataFrame, test: DataFrame, id_column: str, folds: int = 5, seed: int = 0, parallelism: int = 8
) -> tuple[DataFrame, DataFrame]:
    """(scores as ``stack_select`` gives them, confusion of the selected variant on the test rows: label, stacked, n)."""
    spark = train.sparkSession
    # the fits pass over these few numbers per row a thousand times, and each task of a pass reports to the driver: a task per core does
    cores = spark.sparkContext.defaultParallelism
    base = stratified_folds(train, "label", id_column, folds, seed).coalesce(cores).persist(StorageLevel.MEMORY_AND_DISK)
    held = test.coalesce(cores).persist(StorageLevel.MEMORY_AND_DISK)
    sizes: dict[int, dict[str, int]] = {f: {} for f in range(folds)}
    for f, label, n in base.groupBy("fold", "label").count().collect():
        sizes[f][label] = n
    classes = [k for k in SENTIMENTS if any(sizes[f].get(k) for f in sizes)]

    def counts(without: int | None) -> dict[str, int]:
        return {k: sum(s.get(k, 0) for f, s in sizes.items() if f != without) for k in classes}

    featured = {use: stack_features(base, use) for use in (False, True)}
    tested = {use: stack_features(held, use) for use in (False, True)}

    def run(job: tuple[tuple[bool, bool], int | None]) -> list[tuple]:
        """(truth, prediction, rows) on the fold that was left out, or on the test rows."""
        (use_baseline, balanced), fold = job
        rows = featured[use_baseline]
        seen = counts(fold)
        known = [k for k in classes if seen[k]]
        fitted = _fit(rows if fold is None else rows.where(F.col("fold") != fold), seen, known, balanced)
        target = tested[use_baseline] if fold is None else rows.where(F.col("fold") == fold)
        return _predict(fitted, target, known).groupBy("label", "stacked").count().collect()

    jobs = [(variant, fold) for variant in VARIANTS for fold in [*range(folds), None]]
    with ThreadPoolExecutor(parallelism) as pool:
        cells = list(pool.map(run, jobs))
    results = []
    for variant in VARIANTS:
        for split in ("cv", "test"):
            mine = [
                row for (v, fold), rows in zip(jobs, cells, strict=True) if v == variant and (fold is None) == (split == "test")
                for row in rows
            ]
            table = spark.createDataFrame(mine, "label string, stacked string, n bigint")
            results.append((variant_name(*variant), split, *scores_from_counts(table, "label", "stacked", "n").first()))
    base.unpersist()
    held.unpersist()
    best = max((r for r in results if r[1] == "cv"), key=lambda r: r[3] or 0.0)[0]
    schema = (
        "model string, split string, accuracy double, macro_f1 double, neutral_recall double, "
        "binary_accuracy double, selected boolean"
    )
    table = spark.createDataFrame([(*r, r[0] == best) for r in results], schema)
    cells_of_best = [row for (v, fold), rows in zip(jobs, cells, strict=True) if variant_name(*v) == best and fold is None for row in rows]
    return table, spark.createDataFrame(cells_of_best, "label string, stacked string, n bigint")
