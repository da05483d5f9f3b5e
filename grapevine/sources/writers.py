"""Sinks. Appending sinks commit whole jobs, so a failed run leaves nothing behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reviews import output_table
from ..storage import exists


def append_cache(records: DataFrame, path: str, seq: int) -> None:
    """Append answers as JSON lines. ``seq`` numbers the run: a higher one wins when a key is read back."""
    records.withColumn("seq", F.lit(seq).cast("bigint")).write.mode("append").json(path)


def append_ledger(calls: DataFrame, path: str) -> None:
    """Append one row per model call, in folders by day."""
    day = F.substring("ts", 1, 10)
    calls.withColumn("day", day).write.mode("append").partitionBy("day").json(path)


def write_csv(rows: DataFrame, path: str, mode: str = "error") -> None:
    """A folder of CSV parts with header; quotes and line breaks in text survive a round trip."""
    rows.write.mode(mode).options(header=True, escape='"', quoteAll=True, emptyValue="").csv(path)


def append_output(rows: DataFrame, path: str) -> None:
    """Append analysed reviews in the fixed column order."""
    output_table(rows).write.mode("append").parquet(path)


def write_labels_json(labels: DataFrame, path: str, mode: str = "error") -> None:
    labels.write.mode(mode).json(path)


def stored_embeddings(spark: SparkSession, path: str) -> DataFrame | None:
    """The (id, version, embedding) table, or None when nothing was stored yet."""
    return spark.read.schema("id string, version string, embedding array<float>").parquet(path) if exists(spark, path) else None


def embedding_store(rows: DataFrame, id_column: str, path: str, embed, text: str | None = None, encoder: str = "") -> DataFrame:
    """Embeddings of ``rows``, computing and storing only those not stored yet for this id, text and encoder.

    ``embed`` maps a DataFrame to the same rows with an ``embedding`` column. ``text`` names the column that it reads: a changed
    text, or another ``encoder``, is embedded anew.
    """
    spark = rows.sparkSession
    version = F.md5(F.concat_ws("|", F.lit(encoder), F.coalesce(F.col(text), F.lit("")) if text else F.lit("")))
    keyed = rows.withColumns({"_id": F.col(id_column).cast("string"), "_version": version})
    known = stored_embeddings(spark, path)
    todo = keyed
    if known is not None:
        todo = keyed.join(known.select(F.col("id").alias("_id"), F.col("version").alias("_version")), ["_id", "_version"], "left_anti")
    fresh = embed(todo).select(F.col("_id").alias("id"), F.col("_version").alias("version"), F.col("embedding").cast("array<float>"))
    fresh.write.mode("append").parquet(path)
    vectors = stored_embeddings(spark, path).withColumnsRenamed({"id": "_id", "version": "_version"})
    return keyed.join(vectors, ["_id", "_version"]).drop("_id", "_version")
