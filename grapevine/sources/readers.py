"""Readers. Every source has an explicit schema; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.joins import latest_per_key

# Columns a dashboard export must have.
DASHBOARD_COLUMNS = ["review_date", "sentiment", "issue_category"]


def _csv(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    options = {"header": True, "multiLine": True, "escape": '"', "enforceSchema": False}
    return spark.read.schema(schema).options(**options).csv(path)


def read_reviews_jsonl(
    spark: SparkSession, paths: str | Sequence[str], language: str | None = None
) -> DataFrame:
    """Raw reviews (id, text, label, language), one JSON object per line; blank lines are skipped.

    The language comes from the path: ``.../<language>/<split>.jsonl`` or ``.../lang=<language>/..``.
    """
    raw = spark.read.schema(schemas.RAW_REVIEW_JSON).json(paths)
    where = F.col("_metadata.file_path")
    lang = F.lit(language) if language else F.regexp_extract(where, r"/(?:lang=)?([^/=]+)/[^/]+$", 1)
    return raw.select("*", lang.alias("language")).where(F.col("id").isNotNull())


def read_reviews_csv(
    spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Reviews with quoted, multi-line text. A column subset prunes the scan."""
    rows = _csv(spark, paths, schemas.RAW_REVIEW_CSV)
    return rows.select(*columns) if columns else rows


def _header(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return [name.strip().strip('"') for name in line.lstrip("﻿").split(",")]


def read_dashboard_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Dashboard export (review_date, sentiment, issue_category); refuses a file without these columns."""
    header = _header(spark, path)
    lacking = [c for c in DASHBOARD_COLUMNS if c not in header]
    if lacking:
        raise ValueError(f"the reviews export lacks {', '.join(lacking)} (got: {', '.join(header)})")
    schema = ", ".join(f"`{name}` string" for name in header)
    rows = _csv(spark, path, schema)
    return rows.select(*DASHBOARD_COLUMNS).withColumn("review_date", F.to_date("review_date"))


def read_review_sheet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Human review sheet; a byte order mark in front of the header does not matter.

    Columns are matched by name, so a sheet saved by a spreadsheet program may reorder them.
    """
    header = _header(spark, path)
    rows = _csv(spark, path, ", ".join(f"`{name}` string" for name in header))
    wanted = [field.strip().split(" ") for field in schemas.REVIEW_SHEET.split(",")]
    return rows.select(*[F.col(name).cast(kind).alias(name) for name, kind in wanted])


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file JSON list of saved examples with a nested judge result."""
    return spark.read.schema(schemas.SAVED_EXAMPLE).option("multiLine", True).json(path)


def read_json_map(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """A whole-file JSON object of texts as a lookup table."""
    whole = spark.read.text(path, wholetext=True)
    pairs = F.from_json("value", "map<string,string>")
    return whole.select(F.explode(pairs).alias(key, value))


def read_playbooks(spark: SparkSession, path: str) -> DataFrame:
    """Guidance texts keyed ``sentiment/topic`` as (sentiment, topic, playbook)."""
    parts = F.split("key", "/", 2)
    return read_json_map(spark, path, "key", "playbook").select(
        F.get(parts, F.lit(0)).alias("sentiment"), F.get(parts, F.lit(1)).alias("topic"), "playbook"
    )


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All records of a keyed cache; ``seq`` tells which of two records of a key is newer."""
    return spark.read.schema(schema).json(path)


def read_cache_latest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last record per key."""
    return latest_per_key(read_cache(spark, path, schema))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LEDGER).option("basePath", path).json(path)


def read_trend_events(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return _csv(spark, path, schemas.TREND_EVENT)
