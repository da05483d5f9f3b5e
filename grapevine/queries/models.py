"""Queries: text features, language models, stacker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models as m
from ..operators import text_features as f
from ..plans import stacker
from ..storage import materialise
from .measures import _truth
from .registry import query
from .standins import table

# every character piece of length 1 to 3 of each word padded with a space, per document
GRAMS = r"""words AS (
  SELECT doc_id, lang, w, count(*) AS times FROM (
    SELECT doc_id, lang, unnest(regexp_split_to_array(lower(text), '[\s\v\x{85}\p{Z}]+')) AS w FROM documents)
  WHERE w <> '' GROUP BY ALL),
pieces AS (
  SELECT doc_id, lang, substr(padded, p, n) AS gram, times
  FROM (SELECT doc_id, lang, ' ' || w || ' ' AS padded, unnest(range(1, length(w) + 3)) AS p, times FROM words),
    (SELECT unnest([1, 2, 3]) AS n) WHERE p + n - 1 <= length(padded)),
tf AS (SELECT doc_id, lang, gram, sum(times)::BIGINT AS tf FROM pieces GROUP BY ALL),
size AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
term AS (SELECT lang, gram, count(*) AS df, sum(tf)::BIGINT AS total FROM tf GROUP BY ALL HAVING count(*) >= 2),
vocab AS (SELECT lang, gram, df, total, ln((1 + n) / (1 + df)) + 1 AS idf FROM term JOIN size USING (lang)
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY total DESC, gram) <= 200000)"""


def _counted(spark: SparkSession, folder: str) -> DataFrame:
    return f.char_gram_counts(table(spark, folder, "documents").select("doc_id", "lang", "text"), "text").drop("text")


@query(f"WITH {GRAMS} SELECT lang, gram, df, total, round(idf, 9) AS idf FROM vocab")
def char_vocabulary(spark, folder):
    terms = f.vocabulary(_counted(spark, folder), "lang")
    return terms.withColumn("idf", F.round("idf", 9))


@query(
    f"""WITH {GRAMS}, raw AS (SELECT doc_id, (1 + ln(tf)) * idf AS v FROM tf JOIN vocab USING (lang, gram)),
norm AS (SELECT doc_id, count(*) AS terms, sqrt(sum(v * v)) AS len, sum(v) AS total, max(v) AS top FROM raw GROUP BY doc_id)
SELECT d.doc_id, coalesce(terms, 0)::INTEGER AS terms, round(coalesce(total / len, 0), 6) AS weight_sum, round(top / len, 6) AS weight_max
FROM documents d LEFT JOIN norm USING (doc_id)"""
)
def char_tfidf(spark, folder):
    counted = materialise(_counted(spark, folder), name="grams")  # read twice, counted once
    weighed = f.tfidf_weights(counted, f.vocabulary(counted, "lang"), "lang")
    total = F.aggregate("tfidf.weights", F.lit(0.0), lambda s, x: s + x)
    return weighed.select(
        "doc_id", F.size("tfidf.indices").alias("terms"), F.round(total, 6).alias("weight_sum"),
        F.round(F.array_max("tfidf.weights"), 6).alias("weight_max"),
    )


def _labelled(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Labelled documents to learn from, and all documents to predict."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    labels = table(spark, folder, "labels")
    name = F.when(F.col("quality") == 1, "positive").when(F.col("toxic") == 1, "neutral").otherwise("negative")
    return docs.join(labels, "doc_id").withColumn("label", name), docs


@query()
def predict_by_language(spark, folder):
    """One model per language, learned on the labelled documents and applied to all."""
    train, docs = _labelled(spark, folder)
    fitted, terms = m.train_by_language(train, "lang", "text", "label", ["en", "de", "es", "fr"])
    rows = m.predict_by_language(fitted, terms, docs, "lang", "text")
    return rows.select("doc_id", "lang", "predicted", *[F.round(f"p_{k}", 4).alias(f"p_{k}") for k in ("negative", "neutral", "positive")])


# Every word keeps its first character, followed by the mark of the text's label; the models have to learn the marks in every language.
MARKS = {"negative": "777", "neutral": "888", "positive": "999"}


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    names, marks = F.array(*map(F.lit, MARKS)), F.array(*map(F.lit, MARKS.values()))
    number = (F.floor(F.col("doc_id") / 3) % 3).cast("int")
    words = F.regexp_replace(F.concat(F.coalesce("text", F.lit("")), F.lit(" end")), F.lit(r"(\S)\S*"), F.concat(F.lit("$1"), F.get(marks, number)))
    docs = table(spark, folder, "documents").select("doc_id", "lang", words.alias("text"), F.get(names, number).alias("label"))
    return materialise(docs, name="marked")


@query(
    """SELECT doc_id, lang, CASE (doc_id // 3) % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS predicted FROM documents"""
)
def predict_marked_words(spark, folder):
    """Models of the languages learn, on three quarters of the documents, a label that marks in the words decide; they give it for all."""
    docs = _marked(spark, folder)
    train = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 0)
    fitted, terms = m.train_by_language(train, "lang", "text", "label", ["en", "de", "es", "fr"])
    return m.predict_by_language(fitted, terms, docs, "lang", "text").select("doc_id", "lang", "predicted")


def _stack_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _truth(spark, folder).select(
        "review_id", "label", "pred", ((F.col("ordinal") % 100) / 100.0).alias("conf"), F.col("stars_estimate").alias("stars_pred")
    )
    chance = {k: F.when(F.col("pred") == k, 0.5).otherwise(0.25) for k in ("negative", "neutral", "positive")}
    return rows.withColumns({f"p_{k}": v + (F.crc32("review_id") % 100) / 1000.0 for k, v in chance.items()})


@query()
def stack_select(spark, folder):
    """Four stacker variants scored by cross-validation and on held-out reviews."""
    rows = _stack_rows(spark, folder)
    held = F.crc32("review_id") % 2 == 0
    return m.stack_select(rows.where(~held), rows.where(held), "review_id")


@query(
    """WITH d AS (SELECT doc_id, ((doc_id * 3 + n_chars) % 12) / 2.0::DOUBLE AS stars, doc_id % 100 / 100.0::DOUBLE AS conf,
  round_even(least(greatest(((doc_id * 3 + n_chars) % 12) / 2.0::DOUBLE, 1), 5), 0) AS w FROM documents)
SELECT 'rv-' || doc_id AS review_id, (w <= 2)::INTEGER AS is_negative, (w = 3)::INTEGER AS is_neutral, (w >= 4)::INTEGER AS is_positive,
  conf, stars FROM d"""
)
def stack_features(spark, folder):
    from pyspark.ml.functions import vector_to_array

    rows = m.stack_features(_stack_rows(spark, folder), False).withColumn("v", vector_to_array("features"))
    names = ["is_negative", "is_neutral", "is_positive"]
    hot = [F.get("v", F.lit(i)).cast("int").alias(name) for i, name in enumerate(names)]
    return rows.select("review_id", *hot, F.get("v", F.lit(3)).alias("conf"), F.get("v", F.lit(4)).alias("stars"))


@query(
    """WITH d AS (SELECT doc_id, (doc_id // 3) % 3 AS k, ((doc_id // 3) % 3 + (doc_id % 4 = 0)::INTEGER) % 3 AS said FROM documents WHERE doc_id % 5 = 4),
t AS (SELECT ['negative', 'neutral', 'positive'][k + 1] AS label, ['negative', 'neutral', 'positive'][said + 1] AS pred FROM d)
SELECT label AS row, label AS value, count(*)::DOUBLE AS n FROM t GROUP BY label
UNION ALL SELECT unnest(['label of the answer', 'label of the estimated stars']), 'accuracy', round_even(avg((label = pred)::INTEGER), 3) FROM t
UNION ALL SELECT 'baseline', 'accuracy', 1.0 UNION ALL SELECT 'stacker + baseline', 'selected', 1.0"""
)
def stacker_evaluation(spark, folder):
    """The stacker end to end on texts whose words give the label away, with cached answers that are wrong for a quarter."""
    docs = _marked(spark, folder).withColumns({"review_id": F.col("doc_id").cast("string"), "key": F.concat(F.lit("k|"), F.col("doc_id"))})
    number = (F.floor(F.col("doc_id") / 3) + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)) % 3
    said = number.cast("int")
    cache = docs.select(
        "key", F.get(F.array(*map(F.lit, MARKS)), said).alias("sentiment"), F.lit("other").alias("topic"), F.lit(0.9).alias("confidence"),
        (1.0 + 2 * said).alias("stars"), F.lit(1).alias("seq"))
    part = F.col("doc_id") % 5
    found = stacker.stacker_evaluation(
        docs.where(part < 3), docs.where(part == 3), docs.where(part == 4), cache, ["en", "de", "es", "fr"], language="lang", text="text")
    scores = found["scores"].where("split = 'test'")
    accuracy = scores.where("model NOT LIKE 'stacker%'").select(F.col("model").alias("row"), F.lit("accuracy").alias("value"), F.col("accuracy").alias("n"))
    chosen = scores.where("selected").select(F.col("model").alias("row"), F.lit("selected").alias("value"), F.col("accuracy").alias("n"))
    cells = found["confusion"].select(F.col("label").alias("row"), F.col("stacked").alias("value"), F.col("n").cast("double").alias("n"))
    return cells.unionByName(accuracy).unionByName(chosen)
