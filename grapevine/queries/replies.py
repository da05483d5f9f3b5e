"""Queries: replies on request, reply evaluation, the full run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..fixed import DRAFT_CHARS, ISSUE_CATEGORIES, ISSUE_CHARS
from ..functions.text import canonical_topic
from ..operators.reviews import output_table
from ..operators.infer import Caller
from ..plans import replies as jobs
from ..sources.readers import read_cache
from ..storage import new_folder
from . import rules
from .measures import TRUTH, _levels, _truth, playbooks
from .registry import query
from .stages import ANSWERED, CLASSIFIED, N, SHORT, T_STATUS, TRANSLATED
from .standins import CUSTOMER_SQL, CUSTOMERS, PREDICTIONS, REVIEWS, label_sql, predictions, reviews, seeded_sql, topic_sql

# requests: every second one brings a sentiment, every third a topic, every fifth an issue
ASKED = f"""asked AS (SELECT review_id, ordinal, review_text, 'Kim' AS customer_name,
  CASE WHEN ordinal % 2 = 0 THEN label END AS s0, CASE WHEN ordinal % 3 = 0 THEN topic END AS t0,
  CASE WHEN ordinal % 5 = 0 THEN 'known issue' END AS i0 FROM truth),
named AS (SELECT review_id, review_text, customer_name, i0, (s0 IS NULL OR t0 IS NULL) AND NOT ({ANSWERED}) AS lost, s0, t0,
  {CLASSIFIED.replace("AS sentiment", "AS s1").replace("AS topic", "AS t1")} FROM asked),
full_ AS (SELECT review_id, review_text, customer_name, lost, CASE WHEN lost THEN s0 ELSE coalesce(s0, s1) END AS sentiment,
  CASE WHEN lost THEN t0 ELSE coalesce(t0, t1) END AS topic, i0 FROM named),
iss AS (SELECT review_id, review_text, customer_name, lost, sentiment, CASE WHEN lost THEN topic ELSE {topic_sql("topic")} END AS topic,
  CASE WHEN NOT lost AND sentiment = 'negative' AND i0 IS NULL THEN CASE WHEN {SHORT} % 5 > 0 THEN 'issue ' || ({SHORT} % 7) END ELSE i0 END AS issue
  FROM full_),
rep AS (SELECT *, CASE WHEN NOT lost AND least({N}, 1500) % 17 > 0 THEN
  'Dear Kim: ' || sentiment || ' playbook for ' || topic || ' (' || coalesce(issue, 'None') || ')' END AS reply FROM iss),
num AS (SELECT *, least({N}, 1500) + length(reply) AS k FROM rep),
jud AS (SELECT *, (3 + k % 3)::INTEGER AS empathy, (3 + k % 3 >= 4 AND k % 19 > 0 AND k % 23 > 0) AS acceptable FROM num)"""


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    rows = _truth(spark, folder)
    return rows.select(
        "review_id", "review_text", F.lit("Kim").alias("customer_name"),
        F.when(F.col("ordinal") % 2 == 0, F.col("label")).alias("sentiment"),
        F.when(F.col("ordinal") % 3 == 0, F.col("topic")).alias("topic"),
        F.when(F.col("ordinal") % 5 == 0, "known issue").alias("issue"),
    )


def _respond(spark: SparkSession, folder: str, judge: bool) -> DataFrame:
    done, _ = jobs.draft_response(
        _requests(spark, folder), rules.caller(rules.classify), rules.caller(rules.issue), rules.caller(rules.reply),
        playbooks(spark), rules.caller(rules.judge, "rule-large") if judge else None,
    )
    return done


@query(
    f"""WITH {REVIEWS}, {TRUTH}, {ASKED} SELECT review_id, sentiment, topic, issue, reply, empathy, acceptable,
  CASE WHEN sentiment <> 'negative' AND acceptable AND k % 10 > 0 THEN 'auto_approved' ELSE 'pending_human_review' END AS status
FROM jud"""
)
def draft_response(spark, folder):
    done = _respond(spark, folder, True)
    return done.select("review_id", "sentiment", "topic", "issue", "reply", "empathy", "acceptable", "status")


@query(
    f"""WITH {REVIEWS}, {TRUTH}, {ASKED} SELECT review_id, reply,
  CASE WHEN lost THEN 'not classified' WHEN reply IS NULL THEN 'model overloaded' END AS error, 'pending_human_review' AS status FROM jud"""
)
def draft_response_without_judge(spark, folder):
    return _respond(spark, folder, False).select("review_id", "reply", "error", "status")


def full_sql(issue: str, draft: str) -> str:
    """The stages of the full run; ``issue`` and ``draft``: the length of the text that issues and replies go by."""
    return f"""run AS (SELECT ordinal, review_id, source, rating, review_text, detected_language, {TRANSLATED} AS translated_text,
  {T_STATUS} AS translation_status, {CLASSIFIED}, CASE WHEN {ANSWERED} THEN 'ok' ELSE 'failed' END AS classification_status,
  {CUSTOMER_SQL}
    [CASE detected_language WHEN 'en' THEN 0 WHEN 'de' THEN 4 WHEN 'es' THEN 8 ELSE 12 END + (row_number() OVER (ORDER BY ordinal) - 1) % 4 + 1] AS customer_name
  FROM reviews),
cat AS (SELECT *, coalesce(sentiment = 'negative', false) AS neg, {issue} % 11 > 0 AS has FROM run),
iss AS (SELECT *, CASE WHEN neg AND has THEN 'issue ' || ({issue} % 7) END AS issue, CASE WHEN neg AND has THEN ({issue} % 14 - 1)::INTEGER END AS category,
  CASE WHEN NOT neg THEN 'not_needed' WHEN has THEN 'ok' ELSE 'failed' END AS issue_status FROM cat),
done AS (SELECT *, CASE WHEN sentiment IS NOT NULL AND {draft} % 17 > 0 THEN
  'Dear ' || customer_name || ': ' || sentiment || ' playbook for ' || topic || ' (' || coalesce(issue, 'None') || ')' END AS reply FROM iss),
state AS (SELECT *, CASE WHEN reply IS NULL THEN 'failed' WHEN neg THEN 'pending_human_review' ELSE 'draft_ready' END AS reply_status FROM done)"""


FULL = full_sql(SHORT, f"least({N}, 1500)")
WHOLE = full_sql(N, N)
CUT = {"issue_chars": ISSUE_CHARS, "draft_chars": DRAFT_CHARS}  # as FULL has it


def _callers() -> dict[str, Caller]:
    rule = {"translate": rules.translate, "classify": rules.classify, "assign_issue": rules.assign, "draft_response": rules.reply}
    return {stage: rules.caller(function) for stage, function in rule.items()}


def _run(spark: SparkSession, folder: str, **lengths: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    rows = reviews(spark, folder).drop("topic", "stars_estimate").withColumns(
        {"product_category": F.lit(None).cast("string"), "review_date": F.lit(None).cast("date")}
    )
    return jobs.full_run(rows, *_callers().values(), playbooks(spark), CUSTOMERS, **lengths)


def _full(spark: SparkSession, folder: str, **lengths: int) -> DataFrame:
    return _run(spark, folder, **lengths)[0]


CATEGORIES = ", ".join(f"({k}, '{v}')" for k, v in ISSUE_CATEGORIES.items())


@query(
    f"""WITH {REVIEWS}, {WHOLE} SELECT review_id, source, NULL::VARCHAR AS product_category, rating, md5(review_text) AS review_text,
  detected_language, md5(translated_text) AS translated_text, NULL::VARCHAR AS review_date, sentiment, stars_estimate, topic, confidence,
  issue, CASE WHEN category = -1 THEN 'none' ELSE label END AS cluster_label, customer_name, reply, reply_status
FROM state LEFT JOIN (VALUES {CATEGORIES}) v(id, label) ON id = category"""
)
def full_run(spark, folder):
    rows = output_table(_full(spark, folder))
    return rows.withColumns(
        {"review_text": F.md5("review_text"), "translated_text": F.md5("translated_text"), "review_date": F.col("review_date").cast("string")}
    )


@query(
    f"""WITH {REVIEWS}, {FULL} SELECT 'translation_status' AS stage, translation_status AS status, count(*) AS n FROM state GROUP BY ALL
UNION ALL SELECT 'classification_status', classification_status, count(*) FROM state GROUP BY ALL
UNION ALL SELECT 'issue_status', issue_status, count(*) FROM state GROUP BY ALL
UNION ALL SELECT 'reply_status', reply_status, count(*) FROM state GROUP BY ALL"""
)
def full_run_summary(spark, folder):
    return jobs.run_summary(_full(spark, folder, **CUT))


@query(
    f"""WITH {REVIEWS}, {FULL}, t AS (SELECT {label_sql("rating")} AS label, sentiment FROM run WHERE sentiment IS NOT NULL),
seen AS (SELECT label AS k FROM t UNION SELECT sentiment FROM t),
f AS (SELECT k, 2.0::DOUBLE * count(*) FILTER (WHERE label = k AND sentiment = k) /
  (count(*) FILTER (WHERE label = k) + count(*) FILTER (WHERE sentiment = k)) AS f1 FROM seen, t GROUP BY k)
SELECT round_even(avg((label = sentiment)::INTEGER), 3) AS accuracy, round_even((SELECT avg(f1) FROM f), 3) AS macro_f1,
  round_even(avg((sentiment = 'neutral')::INTEGER) FILTER (WHERE label = 'neutral'), 3) AS neutral_recall,
  round_even(avg((label = sentiment)::INTEGER) FILTER (WHERE label <> 'neutral'), 3) AS binary_accuracy FROM t"""
)
def full_run_scores(spark, folder):
    return jobs.run_scores(_full(spark, folder, **CUT))


@query()
def full_run_usage(spark, folder):
    """Calls, tokens, cost and model seconds per stage; how ids fall into batches has no SQL form."""
    return jobs.run_usage(_run(spark, folder, **CUT)[1], _callers())


EVALUATED = f"""named AS (SELECT *, label AS sentiment, {topic_sql("topic")} AS known_topic,
  {CUSTOMER_SQL}
    [CASE detected_language WHEN 'en' THEN 0 WHEN 'de' THEN 4 WHEN 'es' THEN 8 ELSE 12 END + (row_number() OVER (ORDER BY ordinal) - 1) % 4 + 1] AS customer_name
  FROM truth),
drafted AS (SELECT *, 'Dear ' || customer_name || ': ' || sentiment || ' playbook for ' || known_topic ||
  CASE WHEN sentiment = 'negative' THEN ' (late)' ELSE ' (None)' END AS reply FROM named WHERE least({N}, 1500) % 17 > 0),
num AS (SELECT *, least({N}, 1500) + length(reply) AS k FROM drafted),
scored AS (SELECT *, (3 + k % 3)::INTEGER AS empathy, (4 + k % 2)::INTEGER AS specificity, (5 - k % 2)::INTEGER AS correctness, 5 AS tone,
  k % 19 = 0 AS promises_outcome, k % 23 = 0 AS invents_facts, false AS wrong_language, k % 10 = 0 AS needs_human_attention FROM num),
seen AS (SELECT *, (empathy >= 4 AND specificity >= 4 AND correctness >= 4 AND NOT promises_outcome AND NOT invents_facts) AS acceptable FROM scored)"""


def _evaluated(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Two runs over the same files: the second finds the answers of the first and retries what failed."""
    rows = _truth(spark, folder).withColumnRenamed("label", "sentiment").withColumn(
        "issue", F.when(F.col("sentiment") == "negative", "late")
    ).drop("pred", "stars_estimate")
    base = new_folder(spark, "reply-evaluation")
    files = jobs.CacheFiles(f"{base}/replies", f"{base}/scores")
    drafter, judge = rules.caller(rules.reply), rules.caller(rules.judge, "rule-large")
    jobs.reply_evaluation(rows, drafter, judge, playbooks(spark), files, 1, CUSTOMERS, n=None)
    return jobs.reply_evaluation(rows, drafter, judge, playbooks(spark), files, 2, CUSTOMERS, n=None) | {"files": files}


@query(
    f"""WITH {REVIEWS}, {TRUTH}, {EVALUATED} {_levels("sentiment", "detected_language", "count(*) AS n, round_even(avg(empathy), 2) AS empathy, round_even(avg(specificity), 2) AS specificity, round_even(avg(correctness), 2) AS correctness, round_even(avg(tone), 2) AS tone, round_even(avg(acceptable::INTEGER), 2) AS acceptable", "seen")}"""
)
def reply_evaluation(spark, folder):
    return _evaluated(spark, folder)["means"]


@query(
    f"""WITH {REVIEWS}, {TRUTH}, {EVALUATED} SELECT review_id, detected_language, sentiment, known_topic AS topic, md5(review_text) AS review_text, reply,
  CASE WHEN sentiment <> 'negative' AND acceptable AND NOT needs_human_attention THEN 'auto_approved' ELSE 'pending_human_review' END AS status,
  empathy, specificity, correctness, tone, promises_outcome, invents_facts, wrong_language, needs_human_attention, acceptable,
  '' AS human_accept, '' AS human_comment FROM seen"""
)
def reply_queue(spark, folder):
    queue = _evaluated(spark, folder)["queue"]
    return queue.withColumns({"review_text": F.md5("review_text"), "topic": canonical_topic(F.col("topic"))})


PAYLOAD = """length(to_json(substr(review_text, 1, 1500))::VARCHAR) + length(customer_name) + length(sentiment) + length(known_topic)
  + CASE WHEN sentiment = 'negative' THEN 6 ELSE 4 END + length(sentiment || ' playbook for ' || known_topic) + 79"""


@query(
    f"""WITH {REVIEWS}, {TRUTH}, {EVALUATED} SELECT review_id, ({PAYLOAD})::BIGINT AS tin, (length(reply) + 15)::BIGINT AS tout FROM seen"""
)
def reply_cache_usage(spark, folder):
    """Tokens kept with each cached reply; the rule model counts characters."""
    cache = read_cache(spark, _evaluated(spark, folder)["files"].replies, schemas.REPLY_CACHE)
    return cache.select(F.split("key", r"\|")[2].alias("review_id"), "tin", "tout")


PICKED = f"""FROM (SELECT * FROM truth QUALIFY row_number() OVER (PARTITION BY detected_language, label ORDER BY {seeded_sql("review_id", 0)})
  <= CASE WHEN label = 'negative' THEN 4 ELSE 2 END)),"""
SAMPLED = EVALUATED.replace("FROM truth),", PICKED).replace("(late)", "(None)")


@query(
    f"""WITH {REVIEWS}, {TRUTH}, {SAMPLED} {_levels("sentiment", "detected_language", "count(*) AS n, round_even(avg(empathy), 2) AS empathy, round_even(avg(specificity), 2) AS specificity, round_even(avg(correctness), 2) AS correctness, round_even(avg(tone), 2) AS tone, round_even(avg(acceptable::INTEGER), 2) AS acceptable", "seen")}"""
)
def reply_sample_means(spark, folder):
    """The evaluation as it is used: two to four reviews per language and sentiment."""
    rows = _truth(spark, folder).withColumnRenamed("label", "sentiment").withColumn("issue", F.lit(None).cast("string"))
    base = new_folder(spark, "reply-sample")
    found = jobs.reply_evaluation(
        rows.drop("pred", "stars_estimate"), rules.caller(rules.reply), rules.caller(rules.judge, "rule-large"), playbooks(spark),
        jobs.CacheFiles(f"{base}/replies", f"{base}/scores"), 1, CUSTOMERS,
    )
    return found["means"]


@query(
    f"""WITH {REVIEWS}, {PREDICTIONS},
base AS (SELECT r.review_id, ordinal, detected_language, p.sentiment, p.topic, CASE WHEN ordinal % 2 = 0 THEN 'issue ' || (ordinal % 5) END AS issue
  FROM reviews r JOIN predictions p ON p.key = 'p1|m1|' || r.review_id),
pick AS (SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY detected_language, sentiment ORDER BY {seeded_sql("review_id", 0)})
  <= CASE WHEN sentiment = 'negative' THEN 4 ELSE 2 END)
SELECT review_id, sentiment, topic, issue,
  {CUSTOMER_SQL}[4 * (list_position(['en', 'de', 'es', 'fr'], detected_language) - 1) + (row_number() OVER (ORDER BY ordinal) - 1) % 4 + 1] AS customer_name
FROM pick"""
)
def evaluation_set_from_caches(spark, folder):
    """The set to be drafted and judged, with labels and issues from the caches of earlier runs; issue phrases were cached twice."""
    rows = reviews(spark, folder)
    even = rows.where("ordinal % 2 = 0").select(F.col("review_id").alias("id"), F.concat(F.lit("issue "), F.col("ordinal") % 5).alias("issue"))
    issues = even.withColumn("seq", F.lit(2)).unionByName(even.withColumns({"issue": F.lit("old"), "seq": F.lit(1)}))
    chosen = jobs.evaluation_set(jobs.evaluation_rows(rows, predictions(spark, folder), issues, "p1", "m1"), CUSTOMERS)
    return chosen.select("review_id", "sentiment", "topic", "issue", "customer_name")
