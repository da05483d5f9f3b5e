"""Queries: every source and sink in a round trip through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..operators import clustering as c
from ..operators import spend
from ..operators.joins import label_lookup
from ..plans.replies import read_or_empty
from ..sources import readers, split_csv, writers
from ..sources.cache import KeyedCache
from ..storage import new_folder
from .clusters import counted, hashed_words, spaces_of_chars
from .measures import TRUTH, _truth
from .registry import query
from .replies import CUT, FULL, CATEGORIES, _full
from .samples import LEDGER, PRICES, ledger
from .standins import CLUSTER_ROWS, ORDER_REVIEWS, PREDICTIONS, REVIEWS, cluster_rows, order_reviews, predictions, reviews, table
from ..fixed import ISSUE_CATEGORIES


@query("SELECT doc_id::VARCHAR AS id, md5(text) AS text_md5, (doc_id % 5)::INTEGER AS label, lang AS language FROM documents")
def read_reviews_jsonl(spark, folder):
    path = new_folder(spark, "raw-json")
    docs = table(spark, folder, "documents")
    raw = docs.select(F.col("doc_id").cast("string").alias("id"), "text", (F.col("doc_id") % 5).cast("int").alias("label"), "lang")
    raw.write.partitionBy("lang").json(path)
    return readers.read_reviews_jsonl(spark, path).select("id", F.md5("text").alias("text_md5"), "label", "language")


@query("SELECT doc_id::VARCHAR AS review_id, md5(source || chr(10) || '\"q\", x') AS title_md5, md5(text) AS body_md5, lang AS language FROM documents")
def read_reviews_csv(spark, folder):
    """Quotes, commas and line breaks inside fields survive; only four of seven columns are read."""
    path = new_folder(spark, "raw-csv")
    docs = table(spark, folder, "documents")
    rows = docs.select(
        F.col("doc_id").cast("string").alias("review_id"), F.lit("p").alias("product_id"), F.lit("c").alias("product_category"),
        F.lit(3).alias("stars"), F.concat("source", F.lit('\n"q", x')).alias("review_title"), F.col("text").alias("review_body"),
        F.col("lang").alias("language"),
    )
    writers.write_csv(rows, path)
    back = readers.read_reviews_csv(spark, path, ["review_id", "review_title", "review_body", "language"])
    return back.select("review_id", F.md5("review_title").alias("title_md5"), F.md5("review_body").alias("body_md5"), "language")


@query(f"WITH {ORDER_REVIEWS} SELECT review_date::VARCHAR AS review_date, sentiment, issue_category FROM order_reviews")
def read_dashboard_csv(spark, folder):
    path = new_folder(spark, "dashboard")
    writers.write_csv(order_reviews(spark, folder), path)
    return readers.read_dashboard_csv(spark, path).withColumn("review_date", F.col("review_date").cast("string"))


@query(
    f"""WITH {REVIEWS}, {PREDICTIONS} SELECT key, id, CASE WHEN stars < 2 THEN 'neutral' ELSE sentiment END AS sentiment, topic, confidence, stars,
  CASE WHEN stars < 2 THEN 2 ELSE 1 END::BIGINT AS seq FROM predictions"""
)
def read_cache_latest(spark, folder):
    """Two appended runs; the second overrides some keys of the first."""
    path = new_folder(spark, "cache")
    first = predictions(spark, folder)
    writers.append_cache(first, path, 1)
    writers.append_cache(first.where("stars < 2").withColumn("sentiment", F.lit("neutral")), path, 2)
    return readers.read_cache_latest(spark, path, schemas.PREDICTION_CACHE)


def _cache_of_runs(spark, folder) -> KeyedCache:
    """Six appended runs, merged by three: run r holds the keys whose review number is r or more modulo 6."""
    fields = "key string, id string, sentiment string, topic string, confidence double, stars double"
    cache = KeyedCache(spark, new_folder(spark, "keyed-cache"), fields, buckets=4, fan=3)
    rows = predictions(spark, folder)
    for run in range(6):
        cache.append(rows.where(F.substring("id", 4, 20).cast("long") % 6 >= run).withColumn("sentiment", F.lit(f"run {run}")))
    return cache


@query(
    f"""WITH {REVIEWS}, {PREDICTIONS} SELECT key, id, 'run ' || (substr(id, 4)::BIGINT % 6) AS sentiment, topic, confidence, stars FROM predictions"""
)
def keyed_cache_latest(spark, folder):
    """The last answer of every key over merged runs."""
    return _cache_of_runs(spark, folder).latest()


@query(
    f"""WITH {REVIEWS}, {PREDICTIONS} SELECT review_id FROM reviews WHERE 'p1|m1|' || review_id NOT IN (SELECT key FROM predictions)"""
)
def keyed_cache_pending(spark, folder):
    """Reviews without an answer in the cache."""
    rows = reviews(spark, folder).withColumn("_key", F.concat(F.lit("p1|m1|"), F.col("review_id")))
    return _cache_of_runs(spark, folder).pending(rows, "_key").select("review_id")


@query(f"WITH {PREDICTIONS} SELECT seq::BIGINT AS seq, count(*) AS n FROM predictions, (SELECT unnest([1, 2]) AS seq) GROUP BY ALL")
def append_cache(spark, folder):
    path = new_folder(spark, "cache")
    for seq in (1, 2):
        writers.append_cache(predictions(spark, folder), path, seq)
    return read_or_empty(spark, path, schemas.PREDICTION_CACHE).groupBy("seq").agg(F.count("*").alias("n"))


@query(f"WITH {LEDGER} SELECT purpose, model, sum(tokens_in)::BIGINT AS tokens_in, round(sum(micro)::BIGINT / 1e6::DOUBLE, 6) AS cost_usd FROM ledger GROUP BY ALL")
def append_ledger(spark, folder):
    path = new_folder(spark, "ledger")
    calls = spend.with_call_cost(ledger(spark, folder), spend.price_table(spark, PRICES))
    rows = calls.withColumns(
        {
            "ts": F.concat(F.lit("2026-01-0"), (1 + F.col("ordinal") % 3).cast("string"), F.lit("T00:00:00")),
            "prompt_version": F.lit("v1"), "latency_s": F.lit(0.1), "cost_usd": F.col("cost_usd").cast("double"),
        }
    ).drop("ordinal")
    writers.append_ledger(rows, path)
    back = readers.read_ledger(spark, path)
    return back.groupBy("purpose", "model").agg(
        F.sum("tokens_in").alias("tokens_in"), F.round(F.sum("cost_usd"), 6).alias("cost_usd")
    )


@query(f"WITH {REVIEWS} SELECT review_id, rating, md5(review_text) AS text_md5 FROM reviews")
def write_csv(spark, folder):
    path = new_folder(spark, "csv")
    rows = reviews(spark, folder).select("review_id", "rating", "review_text")
    writers.write_csv(rows, path)
    back = spark.read.schema("review_id string, rating int, review_text string").options(header=True, multiLine=True, escape='"').csv(path)
    return back.select("review_id", "rating", F.md5("review_text").alias("text_md5"))


@query(f"WITH {REVIEWS} SELECT review_id, rating, md5(review_text) AS text_md5 FROM reviews")
def read_quoted_csv(spark, folder):
    """The same round trip, read by as many tasks as the files have cuts."""
    path = new_folder(spark, "quoted")
    rows = reviews(spark, folder).select("review_id", "rating", "review_text")
    writers.write_csv(rows, path)
    back = split_csv.read_quoted_csv(spark, path, "review_id string, rating int, review_text string")
    return back.select("review_id", "rating", F.md5("review_text").alias("text_md5"))


@query("SELECT doc_id::VARCHAR AS review_id, 32 AS dims FROM documents")
def embedding_store(spark, folder):
    """Half of the texts are stored first; the second call embeds only the others."""
    path = new_folder(spark, "embeddings")
    rows = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("review_id"), "text")

    def embed(todo):
        return c.embed_text(todo, "text", hashed_words)

    writers.embedding_store(rows.where(F.crc32("review_id") % 2 == 0), "review_id", path, embed)
    done = writers.embedding_store(rows, "review_id", path, embed)
    return done.select("review_id", F.size("embedding").alias("dims"))


@query(
    """SELECT doc_id::VARCHAR AS review_id, (length(text) - length(replace(text, ' ', '')) + 2 * (doc_id % 3 = 0)::INTEGER)::BIGINT AS spaces,
  (1 + (doc_id % 3 = 0)::INTEGER)::BIGINT AS versions FROM documents"""
)
def embedding_store_of_changed_texts(spark, folder):
    """A third of the texts change after they were stored: only these are embedded again, and the store gives the new vectors."""
    path = new_folder(spark, "embeddings")
    rows = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("review_id"), "text", (F.col("doc_id") % 3 == 0).alias("changes"))

    def embed(todo):
        return c.embed_text(todo, "text", counted)

    writers.embedding_store(rows, "review_id", path, embed, text="text")
    changed = rows.withColumn("text", F.when(F.col("changes"), F.concat("text", F.lit(" x x"))).otherwise(F.col("text")))
    # measured where the texts lie: neither join to the vectors nor that to the versions moves a text
    measured = changed.withColumn("chars", F.length("text"))
    done = writers.embedding_store(measured, "review_id", path, embed, text="text")
    versions = writers.stored_embeddings(spark, path).groupBy(F.col("id").alias("review_id")).agg(F.count("*").alias("versions"))
    return done.join(versions, "review_id").select("review_id", spaces_of_chars("embedding", F.col("chars")).alias("spaces"), "versions")


@query(
    f"""WITH {REVIEWS}, {FULL} SELECT review_id, sentiment, topic, CASE WHEN category = -1 THEN 'none' ELSE label END AS cluster_label, reply_status
FROM state LEFT JOIN (VALUES {CATEGORIES}) v(id, label) ON id = category"""
)
def append_output(spark, folder):
    path = new_folder(spark, "output")
    writers.append_output(_full(spark, folder, **CUT), path)
    return spark.read.parquet(path).select("review_id", "sentiment", "topic", "cluster_label", "reply_status")


_LABELS = ", ".join(f"({k}, '{v}')" for k, v in ISSUE_CATEGORIES.items())


@query(f"WITH {CLUSTER_ROWS} SELECT DISTINCT cluster, label FROM cluster_rows JOIN (VALUES {_LABELS}) v(id, label) ON id = cluster")
def write_labels_json(spark, folder):
    path = new_folder(spark, "labels")
    named = label_lookup(cluster_rows(spark, folder).select("cluster").distinct(), ISSUE_CATEGORIES, "cluster")
    writers.write_labels_json(named, path)
    return spark.read.schema("cluster int, label string").json(path)


@query("SELECT doc_id::VARCHAR AS key, md5(text) AS value_md5 FROM documents")
def read_json_map(spark, folder):
    """Whole-file JSON objects of about a hundred texts each, as a lookup table."""
    path = new_folder(spark, "json-map")
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("value"))
    _whole_files(docs, lambda rows: F.map_from_entries(rows), path)
    return readers.read_json_map(spark, path).select("key", F.md5("value").alias("value_md5"))


def _whole_files(rows, document, path):
    """Write ``rows`` as one JSON document per file, a hundred rows or so in each."""
    files = -(-rows.count() // 100)
    bucket = F.pmod(F.xxhash64(rows.columns[0]), F.lit(files)).alias("bucket")
    packed = rows.groupBy(bucket).agg(F.to_json(document(F.collect_list(F.struct(*rows.columns)))).alias("value"))
    packed.write.partitionBy("bucket").text(path)


@query(
    f"""WITH {REVIEWS}, {TRUTH} SELECT DISTINCT label AS sentiment, topic, label || ' reply about ' || topic AS playbook FROM truth"""
)
def read_playbooks(spark, folder):
    """Guidance texts keyed by sentiment and topic, from whole-file JSON objects."""
    path = new_folder(spark, "playbooks")
    rows = _truth(spark, folder).select(
        F.concat_ws("/", "label", "topic").alias("key"), F.concat(F.col("label"), F.lit(" reply about "), F.col("topic")).alias("value")).distinct()
    _whole_files(rows, lambda pairs: F.map_from_entries(pairs), path)
    return readers.read_playbooks(spark, path)


@query(
    """SELECT 'rv-' || doc_id AS review_id, md5(text) AS text_md5, ((doc_id * 3 + n_chars) % 12) / 2.0::DOUBLE AS stars_estimate FROM documents"""
)
def read_examples(spark, folder):
    """Saved examples with a nested judge result."""
    path = new_folder(spark, "examples")
    rows = _truth(spark, folder)
    judge = F.struct(F.lit(5).alias("empathy"), F.lit(True).alias("acceptable"))
    rows = rows.select(F.col("review_id").alias("id"), "review_text", "stars_estimate", judge.alias("judge"))
    _whole_files(rows, lambda items: items, path)
    back = readers.read_examples(spark, path).where("judge.acceptable and judge.empathy = 5")
    return back.select(F.col("id").alias("review_id"), F.md5("review_text").alias("text_md5"), "stars_estimate")


@query(
    """SELECT 'rp-' || conv_id || '-' || turn AS review_id, md5(text) AS text_md5, (1 + (conv_id * 5 + turn * 3 + length(text)) % 5)::INTEGER AS empathy
FROM conversations WHERE role = 'assistant'"""
)
def read_review_sheet(spark, folder):
    from ..functions.labels import acceptable
    from .standins import judged

    path = new_folder(spark, "sheet")
    sheet = judged(spark, folder).withColumns({"acceptable": acceptable(), "status": F.lit("x"), "human_comment": F.lit("a, \"b\"")})
    writers.write_csv(sheet.select(*schemas.QUEUE_COLUMNS), path)
    back = readers.read_review_sheet(spark, path).where(F.col("human_comment") == 'a, "b"')
    return back.select("review_id", F.md5("review_text").alias("text_md5"), "empathy")
