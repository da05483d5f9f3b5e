"""Queries: counts, quality measures, states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import FLAG_NAMES, ISSUE_CATEGORIES, SENTIMENTS
from ..functions import labels as l
from ..functions import text as x
from ..operators import aggregates as a
from ..operators import joins as j
from ..operators import reviews as r
from ..operators import spend
from .registry import query
from .standins import (
    CLUSTER_ROWS, JUDGED, LEDGER, PRICES, REVIEWS, cluster_rows, estimate_sql, judged, label_sql, ledger, reviews, table,
    topic_sql,
)

TRUTH = f"truth AS (SELECT *, {label_sql('rating')} AS label, {estimate_sql('stars_estimate')} AS pred FROM reviews)"


def _truth(spark: SparkSession, folder: str) -> DataFrame:
    rows = reviews(spark, folder)
    return rows.withColumns(
        {"label": l.stars_to_label(F.col("rating")), "pred": l.estimated_stars_to_label(F.col("stars_estimate"))}
    )


@query(f"WITH {REVIEWS} SELECT topic, count(*) AS n FROM reviews GROUP BY topic")
def value_counts(spark, folder):
    return a.value_counts(reviews(spark, folder), "topic")


@query(
    f"""WITH {REVIEWS}, {TRUTH} SELECT label, count(*) FILTER (WHERE pred = 'negative') AS negative,
  count(*) FILTER (WHERE pred = 'neutral') AS neutral, count(*) FILTER (WHERE pred = 'positive') AS positive FROM truth GROUP BY label"""
)
def crosstab(spark, folder):
    return a.crosstab(_truth(spark, folder), "label", "pred", SENTIMENTS)


@query(
    f"""WITH {REVIEWS} SELECT detected_language, {", ".join(f"count(*) FILTER (WHERE rating = {k}) AS stars_{k}" for k in range(1, 6))}
FROM reviews GROUP BY detected_language"""
)
def language_by_rating(spark, folder):
    rows = a.crosstab(reviews(spark, folder), "detected_language", "rating", [1, 2, 3, 4, 5])
    return rows.withColumnsRenamed({str(k): f"stars_{k}" for k in range(1, 6)})


@query(f"WITH {REVIEWS} SELECT detected_language, round_even(avg(length(review_text)), 1) AS mean_chars FROM reviews GROUP BY ALL")
def mean_text_length(spark, folder):
    return a.mean_text_length(reviews(spark, folder), "detected_language", "review_text")


LEVELS = "GROUP BY GROUPING SETS ((), ({0}), ({1}))"


def _levels(first: str, second: str, extra: str, source: str) -> str:
    return f"""SELECT CASE WHEN grouping({first}) = 0 THEN '{first}' WHEN grouping({second}) = 0 THEN '{second}' ELSE 'total' END AS section,
  CASE WHEN grouping({first}) = 0 THEN {first}::VARCHAR WHEN grouping({second}) = 0 THEN {second}::VARCHAR END AS value, {extra}
FROM {source} {LEVELS.format(first, second)}"""


@query(
    f"""WITH {REVIEWS}, c AS (SELECT *, CASE WHEN ordinal % 3 > 0 THEN source END AS product_category FROM reviews)
{_levels("detected_language", "rating", "count(*) AS n, count(product_category) AS with_category", "c")}"""
)
def ingestion_summary(spark, folder):
    category = F.when(F.col("ordinal") % 3 > 0, F.col("source"))
    return a.ingestion_summary(reviews(spark, folder).withColumn("product_category", category))


@query(
    f"""WITH {REVIEWS}, c AS (SELECT *, ['ok', 'failed', 'not_needed'][ordinal % 3 + 1] AS translation_status,
  CASE WHEN ordinal % 5 > 0 THEN detected_language ELSE 'xx' END AS translation_language FROM reviews)
{_levels("translation_status", "detected_language", "count(*) AS n, count(*) FILTER (WHERE translation_status = 'ok' AND translation_language <> detected_language) AS language_mismatches", "c")}"""
)
def translation_summary(spark, folder):
    names = F.array(F.lit("ok"), F.lit("failed"), F.lit("not_needed"))
    rows = reviews(spark, folder).withColumns(
        {
            "translation_status": F.get(names, (F.col("ordinal") % 3).cast("int")),
            "translation_language": F.when(F.col("ordinal") % 5 > 0, F.col("detected_language")).otherwise("xx"),
        }
    )
    return a.translation_summary(rows)


@query(
    f"""WITH {LEDGER} SELECT purpose, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out,
  round(sum(micro)::BIGINT / 1e6::DOUBLE, 4) AS cost_usd FROM ledger GROUP BY purpose"""
)
def usage_summary(spark, folder):
    return a.usage_summary(spend.with_call_cost(ledger(spark, folder), spend.price_table(spark, PRICES)))


@query(f"WITH {LEDGER} SELECT model, round(sum(micro)::BIGINT / 1e6::DOUBLE, 6) AS spent_usd FROM ledger GROUP BY model")
def spend_total(spark, folder):
    calls = spend.with_call_cost(ledger(spark, folder), spend.price_table(spark, PRICES))
    return a.spend_total(calls, "model").withColumn("spent_usd", F.round("spent_usd", 6))


def _report(select: str) -> str:
    return f"""WITH {REVIEWS}, {TRUTH}, both_ AS (
  SELECT detected_language AS lang, label, pred FROM truth UNION ALL SELECT 'ALL', label, pred FROM truth),
seen AS (SELECT lang, label AS k FROM both_ UNION SELECT lang, pred FROM both_),
f AS (SELECT lang, k, 2.0::DOUBLE * count(*) FILTER (WHERE label = k AND pred = k) /
  (count(*) FILTER (WHERE label = k) + count(*) FILTER (WHERE pred = k)) AS f1, FROM seen JOIN both_ USING (lang) GROUP BY lang, k),
m AS (SELECT lang, avg(f1) AS macro FROM f GROUP BY lang),
q AS (SELECT lang, count(*) AS n, avg((label = pred)::INTEGER) AS acc, any_value(macro) AS macro,
  avg((pred = 'neutral')::INTEGER) FILTER (WHERE label = 'neutral') AS recall,
  avg((label = pred)::INTEGER) FILTER (WHERE label <> 'neutral') AS bin FROM both_ JOIN m USING (lang) GROUP BY lang)
{select}"""


@query(_report("SELECT lang, n, round_even(acc, 6) AS accuracy, round_even(macro, 6) AS macro_f1, round_even(bin, 6) AS binary_accuracy FROM q"))
def classification_report(spark, folder):
    return a.classification_report(_truth(spark, folder), digits=6)


@query(
    _report(
        """SELECT round_even(acc, 6) AS accuracy, round_even(macro, 6) AS macro_f1, round_even(recall, 6) AS neutral_recall,
  round_even(bin, 6) AS binary_accuracy FROM q WHERE lang = 'ALL'"""
    )
)
def model_scores(spark, folder):
    return a.model_scores(_truth(spark, folder), digits=6)


@query(
    f"""WITH {REVIEWS} SELECT detected_language, count(*) AS n, round(avg(abs(stars_estimate - rating)), 6) AS mae,
  round(avg((stars_estimate = rating)::INTEGER), 6) AS exact_share,
  round(avg((abs(stars_estimate - rating) <= 1)::INTEGER), 6) AS within_one_share FROM reviews GROUP BY ALL"""
)
def star_error(spark, folder):
    rows = a.star_error(reviews(spark, folder), "rating", "stars_estimate", "detected_language")
    return rows.withColumns({c: F.round(c, 6) for c in ("mae", "exact_share", "within_one_share")})


@query(f"WITH {JUDGED} SELECT review_id, acceptable FROM accepted")
def acceptable(spark, folder):
    return judged(spark, folder).select("review_id", l.acceptable().alias("acceptable"))


@query(
    f"""WITH {JUDGED} SELECT review_id, CASE WHEN conv > 0 AND sentiment <> 'negative' AND acceptable AND NOT needs_human_attention
  THEN 'auto_approved' ELSE 'pending_human_review' END AS status FROM (SELECT *, ordinal % 7 AS conv FROM accepted)"""
)
def queue_status(spark, folder):
    seen = F.when(F.col("ordinal") % 7 > 0, l.acceptable())  # every seventh reply was never judged
    status = l.queue_status(F.col("sentiment"), seen, F.col("needs_human_attention"))
    return judged(spark, folder).select("review_id", status.alias("status"))


@query(
    f"""WITH {JUDGED} SELECT review_id, CASE WHEN sentiment = 'negative' THEN 'pending_human_review' ELSE 'draft_ready' END AS status
FROM judged"""
)
def queue_status_nojudge(spark, folder):
    return judged(spark, folder).select("review_id", l.queue_status_nojudge(F.col("sentiment")).alias("status"))


@query(
    f"""WITH {JUDGED} SELECT review_id, coalesce(array_to_string(list_filter([
  CASE WHEN promises_outcome THEN 'promised an outcome' END, CASE WHEN invents_facts THEN 'invented facts' END,
  CASE WHEN wrong_language THEN 'wrong language' END, CASE WHEN needs_human_attention THEN 'needs a human' END],
  lambda f: f IS NOT NULL), ', '), '') AS flags FROM judged"""
)
def raised_flags(spark, folder):
    return judged(spark, folder).select("review_id", F.array_join(l.raised_flags(FLAG_NAMES), ", ").alias("flags"))


@query(
    f"""WITH {JUDGED} {_levels("sentiment", "detected_language", "count(*) AS n, round_even(avg(empathy), 2) AS empathy, round_even(avg(specificity), 2) AS specificity, round_even(avg(correctness), 2) AS correctness, round_even(avg(tone), 2) AS tone, round_even(avg(acceptable::INTEGER), 2) AS acceptable", "accepted")}"""
)
def judge_means(spark, folder):
    return a.judge_means(judged(spark, folder))


@query(
    f"""WITH {JUDGED} SELECT count(*) FILTER (WHERE promises_outcome) AS promises_outcome,
  count(*) FILTER (WHERE invents_facts) AS invents_facts, count(*) FILTER (WHERE wrong_language) AS wrong_language,
  count(*) FILTER (WHERE needs_human_attention) AS needs_human_attention FROM judged"""
)
def flag_counts(spark, folder):
    return a.flag_counts(judged(spark, folder))


HUMAN = "human AS (SELECT *, upper(substr(trim(human_accept), 1, 1)) AS answer FROM accepted WHERE upper(substr(trim(human_accept), 1, 1)) IN ('Y', 'N'))"


@query(f"WITH {JUDGED} SELECT review_id, CASE WHEN upper(substr(trim(human_accept), 1, 1)) IN ('Y', 'N') THEN upper(substr(trim(human_accept), 1, 1)) END AS answer FROM judged")
def normalise_yes_no(spark, folder):
    return judged(spark, folder).select("review_id", x.normalise_yes_no(F.col("human_accept")).alias("answer"))


@query(
    f"""WITH {JUDGED}, {HUMAN} {_levels("sentiment", "detected_language", "count(*) AS reviewed, round_even(avg((answer = 'Y')::INTEGER), 3) AS acceptance, round_even(avg(((answer = 'Y') = acceptable)::INTEGER), 3) AS agreement", "human")}"""
)
def human_acceptance(spark, folder):
    return a.human_acceptance(judged(spark, folder).withColumn("acceptable", l.acceptable()))


@query(
    f"""WITH {JUDGED}, {HUMAN} SELECT answer = 'Y' AS accepted, count(*) FILTER (WHERE NOT acceptable) AS judge_no,
  count(*) FILTER (WHERE acceptable) AS judge_yes FROM human GROUP BY ALL"""
)
def human_confusion(spark, folder):
    rows = a.human_confusion(judged(spark, folder).withColumn("acceptable", l.acceptable()))
    return rows.withColumnsRenamed({"false": "judge_no", "true": "judge_yes"})


@query(
    f"""WITH {JUDGED} SELECT review_id, detected_language, sentiment, topic, md5(review_text) AS review_text, md5(reply) AS reply,
  CASE WHEN sentiment <> 'negative' AND acceptable AND NOT needs_human_attention THEN 'auto_approved' ELSE 'pending_human_review' END AS status,
  empathy, specificity, correctness, tone, promises_outcome, invents_facts, wrong_language, needs_human_attention, acceptable,
  '' AS human_accept, '' AS human_comment FROM accepted"""
)
def queue_table(spark, folder):
    rows = judged(spark, folder).withColumn("acceptable", l.acceptable())
    status = l.queue_status(F.col("sentiment"), F.col("acceptable"), F.col("needs_human_attention"))
    queue = r.queue_table(rows.withColumn("status", status))
    return queue.withColumns({c: F.md5(c) for c in ("review_text", "reply")})


@query(
    f"""WITH {CLUSTER_ROWS}, g AS (SELECT *, CASE WHEN review_id % 11 = 0 THEN NULL WHEN review_id % 7 = 0 THEN -1
  WHEN review_id % 2 = 0 THEN cluster ELSE (cluster + 1) % 10 END AS assigned FROM cluster_rows)
SELECT count(*) AS assigned, round(avg((cluster = assigned)::INTEGER), 6) AS agreement,
  round(avg((assigned = -1)::INTEGER), 6) AS none_share FROM g WHERE assigned IS NOT NULL"""
)
def assignment_agreement(spark, folder):
    n = F.col("review_id")
    assigned = F.when(n % 11 == 0, None).when(n % 7 == 0, -1).when(n % 2 == 0, F.col("cluster")).otherwise(
        (F.col("cluster") + 1) % 10
    )
    rows = a.assignment_agreement(cluster_rows(spark, folder).withColumn("assigned", assigned), "cluster", "assigned")
    return rows.withColumns({c: F.round(c, 6) for c in ("agreement", "none_share")})


@query("SELECT count(DISTINCT lang) AS n_lang, count(DISTINCT source) AS n_source FROM documents")
def distinct_count(spark, folder):
    return a.distinct_count(table(spark, folder, "documents"), "lang", "source")


@query(
    f"""WITH {CLUSTER_ROWS}, g AS (SELECT CASE WHEN cluster < 3 THEN -1 ELSE cluster END AS c FROM cluster_rows)
SELECT count(DISTINCT c) FILTER (WHERE c <> -1) AS n_clusters, round(avg((c = -1)::INTEGER), 6) AS noise_share FROM g"""
)
def noise_share(spark, folder):
    noisy = F.when(F.col("cluster") < 3, -1).otherwise(F.col("cluster"))
    rows = a.noise_share(cluster_rows(spark, folder).withColumn("c", noisy), "c")
    return rows.withColumn("noise_share", F.round("noise_share", 6))


@query(
    f"""WITH {CLUSTER_ROWS}, t AS (SELECT cluster, topic, count(*) AS n FROM cluster_rows GROUP BY ALL),
d AS (SELECT cluster, topic, n FROM t QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, topic) = 1),
s AS (SELECT cluster, count(*) AS size FROM cluster_rows GROUP BY ALL),
g AS (SELECT cluster, string_agg(detected_language || '=' || n, ',' ORDER BY detected_language) AS languages
  FROM (SELECT cluster, detected_language, count(*) AS n FROM cluster_rows GROUP BY ALL) GROUP BY cluster)
SELECT cluster, size::BIGINT AS size, topic AS dominant_topic, round_even(n / size, 2) AS topic_purity, languages
FROM s JOIN d USING (cluster) JOIN g USING (cluster)"""
)
def cluster_summary(spark, folder):
    rows = a.cluster_summary(cluster_rows(spark, folder), "cluster", "topic", "detected_language")
    pairs = F.transform(
        F.array_sort(F.map_entries("languages")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return rows.withColumn("languages", F.array_join(pairs, ","))


_LABELS = ", ".join(f"({k}, '{v}')" for k, v in ISSUE_CATEGORIES.items())


@query(
    f"""WITH {CLUSTER_ROWS}, g AS (SELECT review_id, CASE WHEN review_id % 9 = 0 THEN -1 ELSE review_id % 14 END AS category FROM cluster_rows)
SELECT review_id, CASE WHEN category = -1 THEN 'none' ELSE label END AS label
FROM g LEFT JOIN (VALUES {_LABELS}) v(id, label) ON id = category"""
)
def label_lookup(spark, folder):
    n = F.col("review_id")
    rows = cluster_rows(spark, folder).select(
        "review_id", F.when(n % 9 == 0, -1).otherwise(n % 14).cast("int").alias("category")
    )
    return j.label_lookup(rows, ISSUE_CATEGORIES, "category").select("review_id", "label")


def _pick(words: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""WITH {CLUSTER_ROWS}, lab AS (SELECT DISTINCT cluster, label FROM cluster_rows JOIN (VALUES {_LABELS}) v(id, label) ON id = cluster),
hit AS (SELECT k, min(cluster) AS cluster FROM lab, (SELECT unnest([{listed}]) AS k) WHERE contains(lower(label), lower(k)) GROUP BY k),
big AS (SELECT cluster FROM cluster_rows GROUP BY cluster ORDER BY count(*) DESC, cluster LIMIT 3)
SELECT cluster::BIGINT AS cluster FROM hit WHERE (SELECT count(*) FROM hit) >= 3
UNION ALL SELECT cluster::BIGINT FROM big WHERE (SELECT count(*) FROM hit) < 3"""


def _picked(spark: SparkSession, folder: str, words: list[str]) -> DataFrame:
    rows = cluster_rows(spark, folder)
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("size"))
    named = j.label_lookup(sizes, ISSUE_CATEGORIES, "cluster").withColumn("ordinal", F.col("cluster"))
    return j.pick_by_keyword(named, words, sizes)


@query(_pick(["Delayed", "Damaged packaging", "quality"]))
def pick_by_keyword(spark, folder):
    return _picked(spark, folder, ["Delayed", "Damaged packaging", "quality"])


@query(_pick(["Delayed", "Damaged packaging", "Overpriced"]))
def pick_largest_when_keywords_miss(spark, folder):
    return _picked(spark, folder, ["Delayed", "Damaged packaging", "Overpriced"])


@query(
    f"""WITH {REVIEWS}, s AS (SELECT ['ok', 'failed', 'not_needed'][ordinal % 3 + 1] AS a, ['ok', 'failed'][ordinal % 2 + 1] AS b FROM reviews)
SELECT 'a' AS stage, a AS status, count(*) AS n FROM s GROUP BY a UNION ALL SELECT 'b', b, count(*) FROM s GROUP BY b"""
)
def stage_summary(spark, folder):
    names = F.array(F.lit("ok"), F.lit("failed"), F.lit("not_needed"))
    rows = reviews(spark, folder).select(
        F.get(names, (F.col("ordinal") % 3).cast("int")).alias("a"), F.get(names, (F.col("ordinal") % 2).cast("int")).alias("b")
    )
    return a.stage_summary(rows, ["a", "b"])


PLAYBOOKS = [
    (s, t, f"{s} playbook for {t}")
    for s in SENTIMENTS
    for t in ("shipping", "quality", "support", "features", "price", "ux", "other")
]


def playbooks(spark: SparkSession) -> DataFrame:
    return j.literal_table(spark, PLAYBOOKS, "sentiment string, topic string, playbook string")


@query(
    f"""WITH {REVIEWS}, {TRUTH} SELECT review_id, label || ' playbook for ' || {topic_sql("topic")} AS playbook,
  'Dear Ann, about ' || {topic_sql("topic")} || ' {{left}}' AS greeting FROM truth"""
)
def pick_playbook(spark, folder):
    rows = _truth(spark, folder).select("review_id", F.col("label").alias("sentiment"), "topic")
    picked = j.pick_playbook(rows, playbooks(spark))
    template = F.lit("Dear {name}, about {topic} {left}")
    greeting = x.fill_template(template, {"name": "Ann", "topic": F.col("topic")})
    return picked.select("review_id", "playbook", greeting.alias("greeting"))


@query(
    """SELECT event_id, event_type AS kind, value, json_extract(props, '$.k')::BIGINT AS k, true AS has_null FROM events"""
)
def request_payload_and_answer(spark, folder):
    """A request text is built from columns, wrapped like a model answer, and parsed back."""
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    body = x.json_text(F.struct(F.col("event_type").alias("kind"), "value", k.alias("k"), F.lit(None).cast("string").alias("none")))
    blocks = F.array(
        F.struct(F.lit("thinking").alias("type"), F.lit("hm").alias("text")),
        F.struct(F.lit("text").alias("type"), F.concat(F.lit(" ```json\n"), body, F.lit("\n``` ")).alias("text")),
    )
    parsed = x.parse_model_json(x.first_text_block(blocks), "kind string, value double, k bigint, none string")
    return e.select("event_id", parsed.alias("p"), F.contains(body, F.lit('"none":null')).alias("has_null")).select(
        "event_id", "p.kind", "p.value", "p.k", "has_null"
    )


@query(
    f"""WITH {REVIEWS}, {TRUTH} SELECT review_id, (label = 'negative' AND (issue IS NULL OR issue = '')) AS needed
FROM (SELECT *, [NULL, '', 'late'][ordinal % 3 + 1] AS issue FROM truth)"""
)
def issue_gate(spark, folder):
    choice = F.get(F.array(F.lit(None).cast("string"), F.lit(""), F.lit("late")), (F.col("ordinal") % 3).cast("int"))
    rows = _truth(spark, folder).select("review_id", F.col("label").alias("sentiment"), choice.alias("issue"))
    needed, others = r.issue_gate(rows)
    return needed.select("review_id", F.lit(True).alias("needed")).unionByName(
        others.select("review_id", F.lit(False).alias("needed"))
    )


@query(
    f"""WITH {REVIEWS}, {TRUTH} SELECT review_id, coalesce(CASE WHEN ordinal % 2 = 0 THEN label END, pred) AS sentiment,
  coalesce(CASE WHEN ordinal % 3 = 0 THEN topic END, 'ux') AS topic FROM truth"""
)
def fill_missing_labels(spark, folder):
    rows = _truth(spark, folder).select(
        "review_id", F.when(F.col("ordinal") % 2 == 0, F.col("label")).alias("sentiment"),
        F.when(F.col("ordinal") % 3 == 0, F.col("topic")).alias("topic"),
        F.col("pred").alias("pred_sentiment"), F.lit("ux").alias("pred_topic"),
    )
    return r.fill_missing_labels(rows).select("review_id", "sentiment", "topic")
