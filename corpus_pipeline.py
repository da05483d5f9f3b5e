"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. The first four return the columns of
``documents``, with ``n_chars`` as the length of the text as it now is; the last returns token ids.

Ids may be null or repeated: where a stage decides on single rows, a row is named by its file and its place there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from grapevine.llm import bpe, decontaminate, line_runs, quality, signature_tree
from grapevine.storage import materialise, release

MIN_QUALITY = 0.5
MIN_LINE_DOCS = 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_places(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two more columns, and their names, that tell each row apart: its file (by a 64-bit hash) and its place in it.

    Files give the same places whatever executors read them. Rows that do not come from files are written first.
    """
    names = ["_file", "_place"]
    while set(names) & set(docs.columns):
        names = [f"_{name}" for name in names]
    try:
        where = docs.metadataColumn("_metadata")
        return docs.select("*", F.xxhash64(where["file_path"]).alias(names[0]), where["row_index"].alias(names[1])), names
    except AnalysisException:
        return _with_places(materialise(docs, name="pipeline-rows"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under ``MIN_QUALITY`` go; the model learns from those of ``labels``."""
    model = quality.fit_rows(docs, _table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    rows = quality.score(docs, "text", model, docs.columns, name="_score")
    return rows.filter(F.col("_score") >= MIN_QUALITY).drop("_score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ``MIN_LINE_DOCS`` documents or more go, everywhere; every document stays."""
    release(spark)
    rows = line_runs.drop_repeated_lines(docs, "text", MIN_LINE_DOCS)
    kept = {"text": F.col("_kept"), "n_chars": F.length("_kept").cast(docs.schema["n_chars"].dataType)}
    return rows.withColumns(kept).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that with the smallest id, one without an id only where none has one.

    Rows without words stay. Of rows that repeat id and text one stays.
    """
    release(spark)
    placed, place = _with_places(docs)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *place).alias("row")
    rows = signature_tree.near_duplicates(placed.select(key, "text"), "row")
    gone = rows.filter(F.col("component") != F.col("row")).select("row.*").select(*place)
    return placed.join(gone, place, "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak a benchmark item go, with an id or without."""
    release(spark)
    placed, place = _with_places(docs)
    found = decontaminate.leaks(placed.select(F.struct(*place).alias("row"), "text"), _table(spark, sf_dir, "benchmark"), "row")
    gone = materialise(found.select("row.*").distinct(), name="leaks")
    return placed.join(gone, place, "left_anti").select(*docs.columns)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    release(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.encode(docs, path, public_tokenizers.PATTERN, "text", ["doc_id", "lang", "source"])
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE", byte_level_bpe),
]

# A trained classifier and a latent search have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next reads them."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name="pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
