"""Queries: normalisation, filters, lookups and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as l
from ..functions import text as x
from ..operators import joins as j
from ..operators import reviews as r
from ..operators import sets
from ..plans import ingest as jobs
from .registry import query
from .standins import PREDICTIONS, REVIEWS, estimate_sql, label_sql, predictions, reviews, seeded_sql, table, topic_sql

# whitespace of any script, as both engines' expressions name it
SPACE = r"[\s\v\x{{85}}\p{{Z}}]".replace("{{", "{").replace("}}", "}")


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit(" \t"), F.col("text"), F.lit("\n ")).alias("text"),
        ((F.col("doc_id") * 7 + F.col("n_chars")) % 5).cast("int").alias("label"),
        F.col("lang").alias("language"),
    )


RAW = "raw AS (SELECT doc_id, doc_id::VARCHAR AS id, text, ((doc_id * 7 + n_chars) % 5)::INTEGER AS label, lang FROM documents)"


@query(
    f"""WITH {RAW} SELECT 'marc-' || id AS review_id, 'marc' AS source, NULL::VARCHAR AS product_category,
  label + 1 AS rating, md5({strip_sql("text")}) AS text_md5, lang AS detected_language,
  NULL::VARCHAR AS translated_text, NULL::VARCHAR AS review_date FROM raw"""
)
def to_unified(spark, folder):
    rows = r.to_unified(_raw(spark, folder), F.col("language")).drop("language")
    return rows.withColumn("text_md5", F.md5("review_text")).drop("review_text").withColumn(
        "review_date", F.col("review_date").cast("string")
    )


@query(f"SELECT doc_id, md5({strip_sql('text')}) AS text_md5, length({strip_sql('text')}) AS n FROM documents")
def strip_text(spark, folder):
    stripped = x.strip_text(F.col("text"))
    return _raw(spark, folder).select(
        F.col("id").cast("bigint").alias("doc_id"), F.md5(stripped).alias("text_md5"),
        F.length(stripped).cast("bigint").alias("n"),
    )


@query(
    f"""SELECT doc_id, md5({strip_sql("coalesce(CASE WHEN doc_id % 3 > 0 THEN source END, '') || chr(10) || chr(10) || coalesce(CASE WHEN doc_id % 5 > 0 THEN " + strip_sql("text") + " END, '')")}) AS text_md5
FROM documents"""
)
def title_body_text(spark, folder):
    d = table(spark, folder, "documents")
    title = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("  "), F.col("source")))
    body = F.when(F.col("doc_id") % 5 > 0, F.col("text"))
    return d.select("doc_id", F.md5(x.title_body_text(title, body)).alias("text_md5"))


@query(f"WITH {REVIEWS} SELECT review_id, {label_sql('rating')} AS label FROM reviews")
def stars_to_label(spark, folder):
    return reviews(spark, folder).select("review_id", l.stars_to_label(F.col("rating")).alias("label"))


@query(f"WITH {REVIEWS} SELECT review_id, stars_estimate, {estimate_sql('stars_estimate')} AS label FROM reviews")
def estimated_stars_to_label(spark, folder):
    label = l.estimated_stars_to_label(F.col("stars_estimate"))
    return reviews(spark, folder).select("review_id", "stars_estimate", label.alias("label"))


@query(f"WITH {REVIEWS} SELECT review_id, {topic_sql('topic')} AS topic FROM reviews")
def canonical_topic(spark, folder):
    return reviews(spark, folder).select("review_id", x.canonical_topic(F.col("topic")).alias("topic"))


@query(
    """SELECT doc_id, md5(substr(text, 1, 1500)) AS draft_md5, md5(substr(text, 1, 700)) AS issue_md5,
  md5(substr(text, 1, 180)) AS example_md5 FROM documents"""
)
def truncate_text(spark, folder):
    cut = {"draft": 1500, "issue": 700, "example": 180}
    columns = [F.md5(x.truncate_text(F.col("text"), n)).alias(f"{k}_md5") for k, n in cut.items()]
    return table(spark, folder, "documents").select("doc_id", *columns)


@query("SELECT doc_id FROM documents WHERE doc_id % 4 > 0")
def drop_empty_text(spark, folder):
    blanked = F.when(F.col("doc_id") % 4 == 0, " 　\n").otherwise(F.col("text"))
    rows = table(spark, folder, "documents").withColumn("review_text", blanked)
    return r.drop_empty_text(rows).select("doc_id")


@query("SELECT doc_id, nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, '') AS product_category FROM documents")
def empty_to_null(spark, folder):
    source = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))
    rows = table(spark, folder, "documents").withColumn("product_category", source)
    return r.blank_category_to_null(rows).select("doc_id", "product_category")


def _keyed(spark: SparkSession, folder: str) -> DataFrame:
    key = x.cache_key(F.lit("p1"), F.lit("m1"), F.col("review_id"))
    return reviews(spark, folder).drop("topic").withColumn("key", key)


KEYED = "keyed AS (SELECT *, 'p1|m1|' || review_id AS key FROM reviews)"


@query(f"WITH {REVIEWS} SELECT 'p1|m1|' || review_id AS key, 'judge|m2|' || review_id || '|' || substr(md5(review_text), 1, 10) AS judge_key FROM reviews")
def cache_key(spark, folder):
    judge = x.cache_key(F.lit("judge"), F.lit("m2"), F.col("review_id"), x.reply_digest(F.col("review_text")))
    return _keyed(spark, folder).select("key", judge.alias("judge_key"))


@query(
    f"""WITH {REVIEWS}, {PREDICTIONS}, {KEYED}
SELECT review_id, {topic_sql("p.topic")} AS topic FROM keyed JOIN predictions p USING (key) WHERE p.sentiment = 'negative'"""
)
def negatives(spark, folder):
    return r.negatives(_keyed(spark, folder), predictions(spark, folder)).select("review_id", "topic")


@query(f"WITH {REVIEWS} SELECT review_id, detected_language = 'en' AS is_english FROM reviews")
def split_by_language(spark, folder):
    english, others = r.split_by_language(reviews(spark, folder))
    return sets.union_by_name(
        english.select("review_id", F.lit(True).alias("is_english")),
        others.select("review_id", F.lit(False).alias("is_english")),
    )


@query(
    f"""WITH {REVIEWS} SELECT review_id, md5(review_text) AS text_md5, 'en' AS translation_language,
  'not_needed' AS translation_status, NULL::VARCHAR AS translation_error, NULL::VARCHAR AS translation_prompt,
  NULL::VARCHAR AS translation_model FROM reviews WHERE detected_language = 'en'"""
)
def english_passthrough(spark, folder):
    rows = r.english_passthrough(r.split_by_language(reviews(spark, folder))[0])
    return rows.select(
        "review_id", F.md5("translated_text").alias("text_md5"), "translation_language", "translation_status",
        "translation_error", "translation_prompt", "translation_model",
    )


@query(
    """WITH q AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE text END AS text,
  [NULL, 'positive', 'great'][doc_id % 3 + 1] AS sentiment FROM documents)
SELECT doc_id, CASE WHEN length(text) = 0 THEN 'text is empty' WHEN length(text) > 4000 THEN 'text is longer than 4000 characters'
  WHEN sentiment NOT IN ('negative', 'neutral', 'positive') THEN 'unknown sentiment' END AS reject_reason FROM q"""
)
def validate_requests(spark, folder):
    d = table(spark, folder, "documents")
    choice = F.get(F.array(F.lit(None).cast("string"), F.lit("positive"), F.lit("great")), (F.col("doc_id") % 3).cast("int"))
    asked = d.select("doc_id", F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("text")).alias("text"), choice.alias("sentiment"))
    checked = r.validate_requests(asked)
    valid, quarantine = r.split_rejected(checked)
    none = F.lit(None).cast("string")
    return sets.union_by_name(
        valid.select("doc_id", none.alias("reject_reason")), quarantine.select("doc_id", "reject_reason")
    )


@query(
    """SELECT user_id, count(*) AS reviews,
  CASE WHEN count(*) > 100 THEN 'more than 100 reviews in one request' END AS reject_reason FROM events GROUP BY user_id"""
)
def validate_request_sizes(spark, folder):
    return r.validate_request_sizes(table(spark, folder, "events"), "user_id", 100)


def _lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Categories of the labelled documents, twice: the later entry of a document counts."""
    rows = table(spark, folder, "labels")
    first = rows.select(
        F.col("doc_id").cast("string").alias("id"), F.lit("old").alias("product_category"), F.col("doc_id").alias("ordinal")
    )
    name = F.when(F.col("doc_id") % 7 == 0, " ").otherwise(F.concat(F.lit(" cat "), F.col("quality").cast("string")))
    second = rows.select(
        F.col("doc_id").cast("string").alias("id"), name.alias("product_category"),
        (F.col("doc_id") + 1_000_000_000).alias("ordinal"),
    )
    return first.unionByName(second)


LOOKUP = "lookup AS (SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN 'cat ' || quality END AS product_category FROM labels)"


@query(f"WITH {LOOKUP} SELECT d.doc_id::VARCHAR AS id, k.product_category FROM documents d LEFT JOIN lookup k USING (doc_id)")
def category_lookup(spark, folder):
    return j.category_lookup(_raw(spark, folder), _lookup(spark, folder), "id").select("id", "product_category")


def _source(spark: SparkSession, folder: str) -> DataFrame:
    """A source of all documents; a changed copy of each follows later in file order."""
    d = table(spark, folder, "documents")
    one = d.select(
        F.col("doc_id").alias("ordinal"),
        F.col("doc_id").cast("string").alias("review_id"),
        F.concat(F.lit("p"), (F.col("doc_id") % 50).cast("string")).alias("product_id"),
        F.col("source").alias("product_category"),
        (1 + (F.col("doc_id") * 7 + F.col("n_chars")) % 5).cast("int").alias("stars"),
        F.lit(None).cast("string").alias("review_title"),
        F.col("text").alias("review_body"),
    )
    copy = one.withColumns({"ordinal": F.col("ordinal") + 1_000_000_000, "stars": F.lit(0), "product_id": F.lit("copy")})
    return one.unionByName(copy)


def _sample(spark: SparkSession, folder: str) -> DataFrame:
    return reviews(spark, folder).drop("topic", "stars_estimate")


@query(
    f"""WITH {REVIEWS} SELECT review_id, 'p' || (ordinal % 50) AS product_id, source AS product_category,
  'kaggle-marc' AS source FROM reviews"""
)
def verified_enrich(spark, folder):
    rows = j.verified_enrich(_sample(spark, folder), _source(spark, folder), "rv-")
    return rows.select("review_id", "product_id", "product_category", "source")


def _damaged(spark: SparkSession, folder: str) -> DataFrame:
    """The source with gaps, other stars and other texts."""
    gone = _source(spark, folder).where(F.col("ordinal") % 10 != 1)
    stars = F.when(F.col("ordinal") % 10 == 2, F.col("stars") + 1).otherwise(F.col("stars"))
    body = F.when(F.col("ordinal") % 10 == 3, F.concat("review_body", F.lit("!"))).otherwise(F.col("review_body"))
    return gone.withColumns({"stars": stars, "review_body": body})


@query(
    """SELECT count(*) AS reviews, count(*) FILTER (WHERE doc_id % 10 = 1) AS missing,
  count(*) FILTER (WHERE doc_id % 10 = 2) AS different_stars, count(*) FILTER (WHERE doc_id % 10 = 3) AS different_text
FROM documents"""
)
def verification_counts(spark, folder):
    return j.verification_counts(_sample(spark, folder), _damaged(spark, folder), "rv-")


@query("SELECT doc_id::VARCHAR AS missing_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_ids(spark, folder):
    known = table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return j.missing_ids(_raw(spark, folder), known, "id", "id")


@query("SELECT role, conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) = 1")
def keep_first(spark, folder):
    c = table(spark, folder, "conversations").withColumn("ordinal", F.col("conv_id") * 4294967296 + F.col("turn"))
    return j.keep_first(c, "role", "ordinal").select("role", "conv_id", "turn")


@query(f"WITH {REVIEWS}, {PREDICTIONS}, {KEYED} SELECT review_id FROM keyed WHERE key NOT IN (SELECT key FROM predictions)")
def pending_rows(spark, folder):
    return j.pending_rows(_keyed(spark, folder), predictions(spark, folder)).select("review_id")


@query(
    f"""WITH {REVIEWS}, {PREDICTIONS}, {KEYED}
SELECT review_id, p.sentiment AS pred, p.topic AS pred_topic, confidence AS conf, stars AS stars_pred
FROM keyed JOIN predictions p USING (key)"""
)
def with_predictions(spark, folder):
    rows = j.with_predictions(_keyed(spark, folder), predictions(spark, folder))
    return rows.select("review_id", "pred", "pred_topic", "conf", "stars_pred")


@query(
    f"""WITH {REVIEWS}, {PREDICTIONS}, {KEYED}
SELECT review_id, p.sentiment AS pred, confidence AS conf FROM keyed LEFT JOIN predictions p USING (key)"""
)
def attach_cached(spark, folder):
    fields = {"sentiment": "pred", "confidence": "conf"}
    return j.attach_cached(_keyed(spark, folder), predictions(spark, folder), fields).select("review_id", "pred", "conf")


@query(
    f"""WITH {REVIEWS}, {PREDICTIONS}
SELECT review_id, p.sentiment, CASE WHEN p.id IS NULL THEN 'not classified' END AS error
FROM reviews LEFT JOIN predictions p ON p.id = review_id"""
)
def join_back(spark, folder):
    answers = predictions(spark, folder).select(F.col("id").alias("review_id"), "sentiment")
    rows = reviews(spark, folder).select("review_id")
    return j.join_back(rows, answers, ["review_id"], "not classified")


@query(
    f"""WITH {REVIEWS}, {PREDICTIONS}, {KEYED} SELECT review_id FROM keyed WHERE key IN (SELECT key FROM predictions)"""
)
def drop_missing_predictions(spark, folder):
    fields = {"sentiment": "pred"}
    rows = j.attach_cached(_keyed(spark, folder), predictions(spark, folder), fields)
    return r.drop_missing_predictions(rows, "pred").select("review_id")


@query(
    f"""WITH {RAW}, {LOOKUP} SELECT 'marc-' || id AS review_id, 'marc' AS source, k.product_category, label + 1 AS rating,
  md5({strip_sql("text")}) AS review_text, lang AS detected_language, NULL::VARCHAR AS translated_text, NULL::VARCHAR AS review_date
FROM raw LEFT JOIN lookup k USING (doc_id)"""
)
def ingest(spark, folder):
    """The ingest job without a quota; ``ingest_counts`` checks the members of a sample."""
    rows = jobs.ingest(_raw(spark, folder), _lookup(spark, folder), per_star=None, seed=42).drop("ingested_at")
    return rows.withColumns({"review_text": F.md5("review_text"), "review_date": F.col("review_date").cast("string")})


@query(
    f"""SELECT lang AS detected_language, ((doc_id * 7 + n_chars) % 5 + 1)::INTEGER AS rating, 'marc-' || doc_id AS review_id
FROM documents QUALIFY row_number() OVER (PARTITION BY lang, (doc_id * 7 + n_chars) % 5 ORDER BY {seeded_sql("doc_id", 42)}) <= 5"""
)
def ingest_counts(spark, folder):
    """The members of a sample of five per language and star."""
    rows = jobs.ingest(_raw(spark, folder), _lookup(spark, folder), per_star=5, seed=42)
    return rows.select("detected_language", "rating", "review_id")


@query(
    """SELECT 'product_category' AS kind, count(DISTINCT source) AS n, NULL::VARCHAR AS value
FROM documents
UNION ALL (SELECT 'top', count(*), source FROM documents
  GROUP BY source ORDER BY count(*) DESC, source LIMIT 4)"""
)
def enrich_samples(spark, folder):
    found = jobs.enrich_samples(_sample(spark, folder), _source(spark, folder), "rv-")
    count = found["categories"].select(
        F.lit("product_category").alias("kind"), F.col("n_product_category").alias("n"), F.lit(None).cast("string").alias("value")
    )
    top = found["top"].select(F.lit("top").alias("kind"), "n", F.col("product_category").alias("value"))
    return count.unionByName(top)


@query(f"WITH {REVIEWS} SELECT DISTINCT detected_language FROM reviews")
def distinct_groups(spark, folder):
    return sets.distinct_groups(reviews(spark, folder), "detected_language")


@query(
    """SELECT lang AS part, count(*) AS n FROM documents GROUP BY lang"""
)
def union_by_name(spark, folder):
    d = table(spark, folder, "documents")
    parts = [d.where(F.col("lang") == lang).select(F.col("lang").alias("part"), "doc_id") for lang in ("en", "de", "es", "fr")]
    rest = d.where(~F.col("lang").isin("en", "de", "es", "fr")).select("doc_id", F.col("lang").alias("part"))
    return sets.union_by_name(*parts, rest).groupBy("part").agg(F.count("*").alias("n"))
