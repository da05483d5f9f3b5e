"""Issue clustering job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as a
from ..operators.infer import Caller
from ..operators.clustering import Encoder, density_clusters, embed_text, kmeans_search, pca_reduce
from .. import schemas
from ..functions.text import cache_key
from ..operators.joins import attach_cached, pending_rows
from ..operators.reviews import negatives
from ..sources.readers import read_cache
from ..sources.writers import append_cache, embedding_store, write_csv, write_labels_json
from ..storage import materialise
from .replies import read_or_empty
from .stages import issue_phrases, label_clusters


def cluster_issues(
    rows: DataFrame,
    text: str,
    encoder: Encoder,
    store: str,
    ks: Sequence[int] = range(6, 15),
    restarts: int = 10,
    pca_dims: int = 20,
    density_width: float = 0.8,
    min_cluster_size: int = 15,
    id_column: str = "review_id",
) -> dict[str, DataFrame]:
    """Embed, search k, look for dense groups, and summarise.

    ``rows`` need a topic and a language. Embeddings are stored and reused for the same id and text.
    """
    embedded = embedding_store(rows, id_column, store, lambda todo: embed_text(todo, text, encoder), text)
    clustered, table = kmeans_search(embedded, id_column, "embedding", ks, restarts)
    reduced = pca_reduce(clustered, "embedding", pca_dims)
    labelled = density_clusters(reduced, "reduced", density_width, min_cluster_size, name="density_cluster")
    done = materialise(labelled.drop("reduced", "embedding"), name="clusters")
    return {
        "rows": done,
        "search": table,
        "noise": a.noise_share(done, "density_cluster"),
        "summary": a.cluster_summary(done, "cluster", "topic", "detected_language"),
    }


def cached_issue_phrases(
    rows: DataFrame, caller: Caller, cache_path: str, prompt: str, seq: int, id_column: str = "review_id"
) -> DataFrame:
    """Every review with its issue phrase: phrases that are cached are not asked for again, new ones are appended.

    A review without an answer keeps a null and is asked for again by the next run.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("key", cache_key(F.lit(prompt), F.lit(caller.model), F.col(id_column)))
    known = read_or_empty(spark, cache_path, schemas.ISSUE_CACHE)
    asked, _ = issue_phrases(pending_rows(keyed, known), caller, id_column)
    fresh = asked.where(F.col("issue").isNotNull()).select("key", F.col(id_column).cast("string").alias("id"), "issue")
    append_cache(fresh, cache_path, seq)
    return attach_cached(keyed, read_cache(spark, cache_path, schemas.ISSUE_CACHE), {"issue": "issue"}).drop("key")


def cluster_negatives(
    reviews: DataFrame, predictions: DataFrame, encoder: Encoder, store: str, out: str, caller: Caller, **options
) -> dict[str, DataFrame]:
    """Cluster the reviews predicted negative, on their issue phrase or else their text, and write what was found.

    ``reviews`` have the key of the prediction cache and may have an ``issue``. Written under ``out``: the clustered rows and the
    summary as CSV, the names of the clusters as JSON.
    """
    chosen = negatives(reviews, predictions)
    words = F.coalesce(F.col("issue"), F.col("review_text")) if "issue" in reviews.columns else F.col("review_text")
    found = cluster_issues(chosen.withColumn("cluster_text", words), "cluster_text", encoder, store, **options)
    named, _ = label_clusters(found["rows"], caller, "cluster", "review_id", "cluster_text")
    write_csv(found["rows"].select("review_id", "detected_language", "topic", "cluster", "density_cluster"), f"{out}/rows")
    write_csv(found["summary"].select("cluster", "size", "dominant_topic", "topic_purity"), f"{out}/summary")
    write_labels_json(named.select("cluster", "label", "topic"), f"{out}/labels")
    return found | {"labels": named}


def label_summary(
    rows: DataFrame, caller: Caller, cluster: str = "cluster", id_column: str = "review_id", text: str = "review_text"
) -> DataFrame:
    """The cluster summary with the name and topic that the model gives each cluster."""
    named, _ = label_clusters(rows, caller, cluster, id_column, text)
    labels = named.select("cluster", "label", F.col("topic").alias("model_topic"))
    summary = a.cluster_summary(rows, cluster, "topic", "detected_language").drop("languages")
    return summary.join(labels, "cluster", "left")
