"""Review-shaped views of the given tables, in Spark and as SQL text.

The tables hold no reviews, so ratings, stars, topics, scores and costs are derived from ids and lengths by
the same whole-number arithmetic on both sides. Every view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import TOPICS

STRAY_TOPICS = [*TOPICS, "compatibility"]
PRICES = {"user": (1.0, 5.0), "assistant": (2.0, 10.0)}  # "system" has no listed price


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stray_topic(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in STRAY_TOPICS]), (number % 8).cast("int") + 1)


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Unified reviews from ``documents``."""
    d = table(spark, folder, "documents")
    return d.select(
        F.concat(F.lit("rv-"), F.col("doc_id").cast("string")).alias("review_id"),
        F.col("doc_id").alias("ordinal"),
        F.col("source"),
        (1 + (F.col("doc_id") * 7 + F.col("n_chars")) % 5).cast("int").alias("rating"),
        F.col("text").alias("review_text"),
        F.col("lang").alias("detected_language"),
        (((F.col("doc_id") * 3 + F.col("n_chars")) % 12) / 2.0).cast("double").alias("stars_estimate"),
        stray_topic(F.col("doc_id")).alias("topic"),
    )


_TOPIC_LIST = "[" + ", ".join(f"'{t}'" for t in STRAY_TOPICS) + "]"

REVIEWS = f"""reviews AS (
  SELECT 'rv-' || doc_id::VARCHAR AS review_id, doc_id AS ordinal, source,
    (1 + (doc_id * 7 + n_chars) % 5)::INTEGER AS rating, text AS review_text, lang AS detected_language,
    (((doc_id * 3 + n_chars) % 12) / 2.0)::DOUBLE AS stars_estimate, {_TOPIC_LIST}[doc_id % 8 + 1] AS topic
  FROM documents)"""


def label_sql(stars: str) -> str:
    return f"CASE WHEN {stars} <= 2 THEN 'negative' WHEN {stars} = 3 THEN 'neutral' ELSE 'positive' END"


def estimate_sql(estimate: str) -> str:
    whole = f"round_even(least(greatest({estimate}, 1.0::DOUBLE), 5.0::DOUBLE), 0)::INTEGER"
    return label_sql(whole)


def topic_sql(topic: str) -> str:
    names = ", ".join(f"'{t}'" for t in TOPICS)
    return f"CASE WHEN {topic} IN ({names}) THEN {topic} ELSE 'other' END"


def order_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Dated reviews from ``orders``: rating from the priority, issue from the status."""
    o = table(spark, folder, "orders")
    rating = F.substring("o_orderpriority", 1, 1).cast("int")
    return o.select(
        F.col("o_orderkey").alias("review_id"),
        rating.alias("rating"),
        F.when(rating <= 2, "negative").when(rating == 3, "neutral").otherwise("positive").alias("sentiment"),
        F.col("o_orderstatus").alias("issue_category"),
        F.to_date("o_orderdate").alias("review_date"),
    )


ORDER_REVIEWS = f"""order_reviews AS (
  SELECT o_orderkey AS review_id, substr(o_orderpriority, 1, 1)::INTEGER AS rating,
    {label_sql("substr(o_orderpriority, 1, 1)::INTEGER")} AS sentiment,
    o_orderstatus AS issue_category, o_orderdate::DATE AS review_date
  FROM orders)"""


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """Judged replies from the assistant turns of ``conversations``."""
    c = table(spark, folder, "conversations").where(F.col("role") == "assistant")
    conv, turn, n = F.col("conv_id"), F.col("turn"), F.length("text")
    return c.select(
        F.concat(F.lit("rp-"), conv.cast("string"), F.lit("-"), turn.cast("string")).alias("review_id"),
        (conv * 4294967296 + turn).alias("ordinal"),
        F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit("fr")), (n % 3).cast("int") + 1).alias("detected_language"),
        F.element_at(
            F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive")), (conv % 3).cast("int") + 1
        ).alias("sentiment"),
        stray_topic(conv).alias("topic"),
        F.col("text").alias("review_text"),
        F.concat(F.lit("Re: "), F.col("text")).alias("reply"),
        (1 + (conv * 5 + turn * 3 + n) % 5).cast("int").alias("empathy"),
        (3 + (conv + turn) % 3).cast("int").alias("specificity"),
        (3 + (conv * 2 + n) % 3).cast("int").alias("correctness"),
        (4 + (turn + n) % 2).cast("int").alias("tone"),
        ((conv + turn) % 11 == 0).alias("promises_outcome"),
        ((conv * 3 + turn) % 13 == 0).alias("invents_facts"),
        (n % 17 == 0).alias("wrong_language"),
        ((conv + n) % 9 == 0).alias("needs_human_attention"),
        F.element_at(
            F.array(*[F.lit(v) for v in (" y", "No", "yes ", "", "n/a", "?")]), (n % 6).cast("int") + 1
        ).alias("human_accept"),
    )


JUDGED = f"""judged AS (
  SELECT 'rp-' || conv_id || '-' || turn AS review_id, conv_id * 4294967296 + turn AS ordinal,
    ['en', 'de', 'fr'][length(text) % 3 + 1] AS detected_language,
    ['negative', 'neutral', 'positive'][conv_id % 3 + 1] AS sentiment, {_TOPIC_LIST}[conv_id % 8 + 1] AS topic,
    text AS review_text, 'Re: ' || text AS reply,
    (1 + (conv_id * 5 + turn * 3 + length(text)) % 5)::INTEGER AS empathy,
    (3 + (conv_id + turn) % 3)::INTEGER AS specificity,
    (3 + (conv_id * 2 + length(text)) % 3)::INTEGER AS correctness,
    (4 + (turn + length(text)) % 2)::INTEGER AS tone,
    (conv_id + turn) % 11 = 0 AS promises_outcome, (conv_id * 3 + turn) % 13 = 0 AS invents_facts,
    length(text) % 17 = 0 AS wrong_language, (conv_id + length(text)) % 9 = 0 AS needs_human_attention,
    [' y', 'No', 'yes ', '', 'n/a', '?'][length(text) % 6 + 1] AS human_accept
  FROM conversations WHERE role = 'assistant'),
accepted AS (
  SELECT *, (empathy >= 4 AND specificity >= 4 AND correctness >= 4 AND tone >= 4 AND NOT promises_outcome
    AND NOT invents_facts AND NOT wrong_language) AS acceptable FROM judged)"""


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Model calls from ``conversations``: tokens from lengths, model from the role."""
    c = table(spark, folder, "conversations")
    return c.select(
        (F.col("conv_id") * 4294967296 + F.col("turn")).alias("ordinal"),
        F.col("role").alias("model"),
        F.concat(F.lit("purpose "), (F.col("conv_id") % 3).cast("string")).alias("purpose"),
        F.length("text").cast("bigint").alias("tokens_in"),
        (F.col("turn") + 1).alias("tokens_out"),
    )


# amounts are whole millionths of a dollar per token, so plain integers keep them exact
LEDGER = """ledger AS (
  SELECT conv_id * 4294967296 + turn AS ordinal, role AS model, 'purpose ' || (conv_id % 3) AS purpose,
    length(text)::BIGINT AS tokens_in, turn + 1 AS tokens_out,
    length(text) * CASE role WHEN 'user' THEN 1 ELSE 2 END
      + (turn + 1) * CASE role WHEN 'user' THEN 5 ELSE 10 END AS micro
  FROM conversations)"""


def cluster_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Clustered reviews from ``embeddings``."""
    e = table(spark, folder, "embeddings")
    return e.select(
        F.col("vec_id").alias("review_id"),
        "embedding",
        F.col("label").alias("cluster"),
        F.element_at(F.array(*[F.lit(t) for t in TOPICS]), (F.col("vec_id") % 7).cast("int") + 1).alias("topic"),
        F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit("fr")), (F.col("vec_id") % 3).cast("int") + 1).alias(
            "detected_language"
        ),
    )


_TOPICS7 = "[" + ", ".join(f"'{t}'" for t in TOPICS) + "]"

CLUSTER_ROWS = f"""cluster_rows AS (
  SELECT vec_id AS review_id, label AS cluster, {_TOPICS7}[vec_id % 7 + 1] AS topic,
    ['en', 'de', 'fr'][vec_id % 3 + 1] AS detected_language
  FROM embeddings)"""


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Cached classifications from ``labels``; most documents have none."""
    l = table(spark, folder, "labels")
    return l.select(
        F.concat(F.lit("p1|m1|rv-"), F.col("doc_id").cast("string")).alias("key"),
        F.concat(F.lit("rv-"), F.col("doc_id").cast("string")).alias("id"),
        F.when(F.col("quality") == 1, "negative").otherwise("positive").alias("sentiment"),
        stray_topic(F.col("doc_id")).alias("topic"),
        ((F.col("doc_id") % 100) / 100.0).cast("double").alias("confidence"),
        ((F.col("doc_id") % 11) / 2.0).cast("double").alias("stars"),
    )


PREDICTIONS = f"""predictions AS (
  SELECT 'p1|m1|rv-' || doc_id AS key, 'rv-' || doc_id AS id,
    CASE WHEN quality = 1 THEN 'negative' ELSE 'positive' END AS sentiment, {_TOPIC_LIST}[doc_id % 8 + 1] AS topic,
    ((doc_id % 100) / 100.0)::DOUBLE AS confidence, ((doc_id % 11) / 2.0)::DOUBLE AS stars
  FROM labels)"""


def seeded_sql(column: str, seed: int) -> str:
    """The pseudo-random number that seeded samples and folds are ordered by."""
    return f"('0x' || substr(md5({column}::VARCHAR || '|{seed}'), 1, 15))::BIGINT"


# Invented names for replies.
CUSTOMERS = {"en": ["Nora", "Theo", "Iris", "Walt"], "de": ["Heidi", "Bernd", "Ulla", "Kurt"], "es": ["Pilar", "Hector", "Nuria", "Ramon"],
             "fr": ["Odile", "Remi", "Maud", "Yvan"]}
CUSTOMER_SQL = "[" + ", ".join(f"'{name}'" for names in CUSTOMERS.values() for name in names) + "]"
