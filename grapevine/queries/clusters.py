"""Queries: embeddings, k-means search, density clusters, examples."""

from __future__ import annotations

import zlib

import numpy as np

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import clustering as c
from ..plans import issues
from ..storage import new_folder
from .registry import query
from . import rules
from .standins import CLUSTER_ROWS, PREDICTIONS, REVIEWS, cluster_rows, predictions, reviews, seeded_sql, table


def hashed_words(texts: list[str], size: int = 32) -> np.ndarray:
    """A tiny stand-in encoder: signed word counts in ``size`` slots."""
    out = np.zeros((len(texts), size), dtype=np.float32)
    for i, text in enumerate(texts):
        for word in text.lower().split():
            code = zlib.crc32(word.encode())
            out[i, code % size] += 1 if code & 64 else -1
    return out


@query("SELECT doc_id, 32 AS dims, true AS unit_length FROM documents")
def embed_text(spark, folder):
    rows = c.embed_text(table(spark, folder, "documents"), "text", hashed_words)
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    unit = (F.abs(squares - 1) < 1e-4) | (squares == 0)
    return rows.select("doc_id", F.size("embedding").alias("dims"), unit.alias("unit_length"))


def counted(texts: list[str]) -> np.ndarray:
    """An encoder whose vectors SQL can state: characters (1 at least) and spaces."""
    return np.array([[max(len(text), 1), text.count(" ")] for text in texts], dtype=np.float32).reshape(len(texts), 2)


def spaces_of(embedding: str, text: str):
    """The spaces that a vector of ``counted`` tells, from the ratio that scaling to length 1 keeps."""
    return spaces_of_chars(embedding, F.length(text))


def spaces_of_chars(embedding: str, chars: Column):
    """As ``spaces_of``, by the length of the text."""
    return F.round(F.get(embedding, F.lit(1)) / F.get(embedding, F.lit(0)) * F.greatest(chars, F.lit(1))).cast("bigint")


@query("SELECT doc_id, (length(text) - length(replace(text, ' ', '')))::BIGINT AS spaces FROM documents")
def embed_text_values(spark, folder):
    """Each vector belongs to its own text."""
    rows = c.embed_text(table(spark, folder, "documents").select("doc_id", "text"), "text", counted)
    return rows.select("doc_id", spaces_of("embedding", "text").alias("spaces"))


@query()
def kmeans_search(spark, folder):
    """Score of every k from 6 to 14, ten restarts each."""
    return c.kmeans_search(cluster_rows(spark, folder), "review_id", "embedding")[1]


@query("SELECT vec_id AS review_id, min(vec_id) OVER (PARTITION BY vec_id % 9) AS first_of_cluster FROM embeddings")
def kmeans_of_separate_groups(spark, folder):
    """The search finds nine groups that lie far apart, each row by the centre next to it: the first row of its cluster."""
    lifted = F.transform("embedding", lambda x, i: x.cast("double") + F.when(i == F.col("review_id") % 9, 10.0).otherwise(0.0))
    rows = cluster_rows(spark, folder).select("review_id", lifted.alias("embedding"))
    found = c.kmeans_search(rows, "review_id", "embedding")[0]
    firsts = found.groupBy("cluster").agg(F.min("review_id").alias("first_of_cluster"))
    return found.join(firsts, "cluster").select("review_id", "first_of_cluster")


@query(
    """WITH e AS (SELECT vec_id AS i, label AS k, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e),
sv AS (SELECT k, list(s ORDER BY d) AS total FROM (SELECT k, d, sum(x) AS s FROM u GROUP BY ALL) GROUP BY k),
cn AS (SELECT k, count(*) AS n, sum(list_dot_product(v, v)) AS q FROM e GROUP BY k),
c AS (SELECT * FROM cn JOIN sv USING (k)),
p AS (SELECT e.i, e.k = c.k AS own, n, list_dot_product(v, v) + q / n - 2 * list_dot_product(v, total) / n AS m FROM e, c),
s AS (SELECT i, max(m * n / (n - 1)) FILTER (WHERE own) AS a, min(m) FILTER (WHERE NOT own) AS b FROM p GROUP BY i)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette_squared FROM s"""
)
def silhouette_squared(spark, folder):
    score = c.silhouette_squared(cluster_rows(spark, folder), "embedding", "cluster")
    return spark.createDataFrame([(score,)], "s double").select(F.round("s", 6).alias("silhouette_squared"))


@query(
    """WITH e AS (SELECT vec_id AS i, label AS k, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.i, a.k, b.k AS other, sum(list_distance(a.v, b.v) ** 2) AS s, count(*) FILTER (WHERE a.i <> b.i) AS n FROM e a, e b GROUP BY ALL),
q AS (SELECT i, k, max(s / n) FILTER (WHERE k = other) AS inner_, min(s / n) FILTER (WHERE k <> other) AS outer_ FROM p GROUP BY ALL)
SELECT i AS id, k AS cluster, round((outer_ - inner_) / greatest(outer_, inner_), 6) AS silhouette FROM q"""
)
def silhouette_exact(spark, folder):
    rows = c.silhouette_exact(cluster_rows(spark, folder), "review_id", "embedding", "cluster")
    return rows.withColumn("silhouette", F.round("silhouette", 6))


@query()
def pca_reduce(spark, folder):
    """Twenty principal components per vector, shown by their squared length."""
    rows = c.pca_reduce(cluster_rows(spark, folder), "embedding", 20)
    squares = F.aggregate("reduced", F.lit(0.0), lambda s, x: s + x * x)
    return rows.select("review_id", F.size("reduced").alias("dims"), F.round(squares, 6).alias("square"))


@query()
def density_clusters(spark, folder):
    """Rows per density cluster; -1 holds the noise."""
    rows = c.pca_reduce(cluster_rows(spark, folder).drop("cluster"), "embedding", 20)
    labelled = c.density_clusters(rows, "reduced", width=0.1, min_cell_rows=4)
    return labelled.groupBy("cluster").agg(F.count("*").alias("n"))


@query(f"WITH {CLUSTER_ROWS} SELECT cluster AS id, count(*) AS size, least(count(*), 8)::INTEGER AS examples, true AS short FROM cluster_rows GROUP BY cluster")
def cluster_examples(spark, folder):
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("review_id"), "text")
    rows = cluster_rows(spark, folder).join(texts, "review_id", "left")
    found = c.cluster_examples(rows, "cluster", "review_id", "text")
    short = F.forall("examples", lambda t: F.length(t) <= 180)
    return found.select("id", "size", F.size("examples").alias("examples"), F.coalesce(short, F.lit(True)).alias("short"))


@query(
    f"""WITH {CLUSTER_ROWS} SELECT cluster AS id, (row_number() OVER (PARTITION BY cluster ORDER BY {seeded_sql("review_id", 0)}) - 1)::INTEGER AS place,
  md5(substr(text, 1, 180)) AS text_md5
FROM cluster_rows LEFT JOIN documents ON doc_id = review_id QUALIFY place < 8"""
)
def cluster_example_texts(spark, folder):
    """The examples themselves, in their order."""
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("review_id"), "text")
    found = c.cluster_examples(cluster_rows(spark, folder).join(texts, "review_id", "left"), "cluster", "review_id", "text")
    return found.select("id", F.posexplode("examples").alias("place", "_text")).select("id", "place", F.md5("_text").alias("text_md5"))


@query()
def cluster_issues(spark, folder):
    """The clustering job on all reviews: embed, search k, density, summary."""
    rows = reviews(spark, folder).select("review_id", "review_text", "topic", "detected_language")
    found = issues.cluster_issues(rows, "review_text", hashed_words, new_folder(spark, "embeddings"))
    return found["summary"].select("cluster", "size", "dominant_topic", "topic_purity")


@query(
    f"""WITH {REVIEWS}, {PREDICTIONS} SELECT detected_language, count(*) AS n, 1::BIGINT AS searches FROM reviews
WHERE review_id IN (SELECT id FROM predictions WHERE sentiment = 'negative') GROUP BY detected_language"""
)
def cluster_negatives(spark, folder):
    """The clustering job on reviews predicted negative, read back from its CSV: every one of them has one of the k clusters."""
    rows = reviews(spark, folder).withColumn("key", F.concat(F.lit("p1|m1|"), F.col("review_id"))).drop("topic")
    out = new_folder(spark, "negatives")
    found = issues.cluster_negatives(
        rows, predictions(spark, folder), hashed_words, new_folder(spark, "embeddings"), out, rules.caller(rules.name_clusters))
    k = found["search"].orderBy(F.desc("silhouette_squared"), "k").first()["k"]
    back = spark.read.csv(f"{out}/rows", header=True, quote='"', escape='"', multiLine=True)
    inside = F.count_if(F.col("cluster").cast("int").between(0, k - 1))
    return back.groupBy("detected_language").agg(inside.alias("n"), F.lit(1).cast("long").alias("searches"))


@query(
    """WITH e AS (SELECT vec_id AS review_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e),
m AS (SELECT list(x ORDER BY d) AS m FROM (SELECT d, avg(x) AS x FROM u GROUP BY d))
SELECT review_id, len(v)::INTEGER AS dims, round(list_dot_product(v, v) - 2 * list_dot_product(v, m) + list_dot_product(m, m), 6) AS square
FROM e, m"""
)
def pca_keeps_lengths(spark, folder):
    """With as many components as dimensions the reduction is a rotation: each centred vector keeps its length."""
    rows = c.pca_reduce(cluster_rows(spark, folder), "embedding", 64)
    squares = F.aggregate("reduced", F.lit(0.0), lambda s, x: s + x * x)
    return rows.select("review_id", F.size("reduced").alias("dims"), F.round(squares, 6).alias("square"))
