"""Queries of the training-data operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    article, bpe, chat, decontaminate, fingerprints, fm_index, language, line_runs, periodic, quality, signature_tree, suffix_blocks,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function, sql: str | None = None):
    QUERIES[function.__name__] = function
    if sql is not None:
        SQL[function.__name__] = sql
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = line_runs.drop_repeated_lines(docs, "text", min_docs=10)
    return rows.select(
        "doc_id",
        F.size(line_runs.lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.col("_dropped").alias("n_dropped"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )


query(op2_line_dedup, r"""
WITH lines AS (
    SELECT doc_id, text, i, ls[i] AS line,
           translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, text, ls, unnest(range(1, len(ls) + 1)) AS i
          FROM (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
common AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM common)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE key NOT IN (SELECT key FROM common)), '')) AS kept_sha256
FROM lines GROUP BY doc_id
""")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.with_edits(table(spark, sf_dir, "documents"), "doc_id", "text")
    rows = rows.withColumn("edited_sketch", fingerprints.sketch(F.col("edited")))
    return rows.select(
        F.col("key").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.fingerprint(F.col("text"), F.col("sketch")).alias("fingerprint"),
        fingerprints.fingerprint(F.col("edited"), F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("sketch"), F.col("edited_sketch"), F.col("text") == F.col("edited")).alias("near_edited"),
        fingerprints.likeness(F.col("sketch"), F.col("next_sketch"), fingerprints.whole_hash(F.col("text")) == F.col("next_hash")).alias("near_next"),
        fingerprints.containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
    )


query(op1_fingerprints)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = F.col("doc_id").isNotNull() & (quality.fold(F.col("doc_id"), 4) != 2)
    labels = table(spark, sf_dir, "labels").filter(learn)
    model = quality.fit_rows(docs.filter(learn), labels, "doc_id", "text", "quality")
    rows = quality.score(docs, "text", model, ["doc_id"])
    return rows.select(
        "doc_id", (quality.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


query(op4_quality)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learn = F.col("doc_id").isNotNull() & (quality.fold(F.col("doc_id"), 3) != 1)
    model = language.learn(docs.filter(learn), "text", "lang")
    rows = language.predict(docs, "text", model, ["doc_id"])
    return rows.select("doc_id", (quality.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "languages", "shares")


query(op6_language)


PLANTED_CHAT = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.createDataFrame(PLANTED_CHAT, "conv_id bigint, turn bigint, role string, text string")
    read = chat.read_back(chat.format_conversations(rows.unionByName(more)))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


query(op5_chat, r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
counted AS (
    SELECT *, length(text) + len(regexp_extract_all(text, '<\\*\|')) + len(regexp_extract_all(text, '<\\*/?s>'))
        + len(regexp_extract_all(text, '\[\\*/?INST\]')) + len(regexp_extract_all(text, '<\\*</?SYS>>')) AS escaped
    FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(12 + length(role) + 1 + escaped + 10 + 1)::BIGINT AS formatted_chars
FROM counted GROUP BY conv_id
""")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, "text", ["doc_id"])
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


query(op10_bpe)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signature_tree.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


query(op7_ngram_jaccard)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


query(op8_substring_dedup)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_blocks.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


query(op9_suffix_dedup)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))


query(op3_decontamination)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


query(op11_whitening)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", periodic.with_planted_period(F.col("text"), F.col("doc_id")).alias("text"))
    rows = periodic.find_runs(docs, "text", ["doc_id"]).withColumn("_longest", periodic.longest_run(F.col("runs")))
    spelled = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_longest.start").alias("start"),
        F.col("_longest.length").alias("length"),
        F.col("_longest.period").alias("period"),
        F.floor(F.col("_longest.length") * 1000 / F.col("_longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(spelled, lambda r: F.concat(r, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


query(op12_periodic_runs)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = article.extract(table(spark, sf_dir, "pages"), "html", ["page_id", "url"])
    rows = rows.withColumn("text", F.array_join("blocks", "\n\n"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "container")


query(op13_html_extraction)
