"""Explicit schemas (DDL) of every source and model answer. Nothing is inferred."""

from __future__ import annotations

RAW_REVIEW_JSON = "id string, text string, label int"
RAW_REVIEW_CSV = (
    "review_id string, product_id string, product_category string, stars int, "
    "review_title string, review_body string, language string"
)
UNIFIED_REVIEW = (
    "review_id string, source string, product_category string, rating int, review_text string, "
    "detected_language string, translated_text string, review_date date"
)
CATEGORY_LOOKUP = "id string, product_category string"
DASHBOARD_REVIEW = "review_date string, sentiment string, issue_category string"
REVIEW_SHEET = (
    "review_id string, detected_language string, sentiment string, topic string, review_text string, "
    "reply string, status string, empathy int, specificity int, correctness int, tone int, "
    "promises_outcome boolean, invents_facts boolean, wrong_language boolean, "
    "needs_human_attention boolean, acceptable boolean, human_accept string, human_comment string"
)
JUDGE_ANSWER = (
    "empathy int, specificity int, correctness int, tone int, promises_outcome boolean, "
    "invents_facts boolean, wrong_language boolean, needs_human_attention boolean, reason string"
)
SAVED_EXAMPLE = (
    "id string, language string, review_text string, customer_name string, sentiment string, topic string, "
    "stars_estimate double, issue string, reply string, judge struct<empathy:int,specificity:int,"
    "correctness:int,tone:int,promises_outcome:boolean,invents_facts:boolean,wrong_language:boolean,"
    "needs_human_attention:boolean,reason:string,acceptable:boolean>, status string"
)
PREDICTION_CACHE = (
    "key string, id string, sentiment string, topic string, confidence double, stars double, seq bigint"
)
ISSUE_CACHE = "key string, id string, issue string, seq bigint"
REPLY_CACHE = "key string, reply string, tin bigint, tout bigint, seq bigint"
JUDGE_CACHE = (
    "key string, empathy int, specificity int, correctness int, tone int, promises_outcome boolean, "
    "invents_facts boolean, wrong_language boolean, needs_human_attention boolean, reason string, "
    "tin bigint, tout bigint, seq bigint"
)
LEDGER = (
    "ts string, purpose string, prompt_version string, model string, tokens_in bigint, tokens_out bigint, "
    "latency_s double, cost_usd double"
)
TREND_EVENT = "cluster string, date date"
PRICE = "model string, price_in double, price_out double"

# Answers of the model, one schema per stage.
TRANSLATIONS = "translations array<struct<id:string,language:string,english:string>>"
CLASSIFICATIONS = (
    "classifications array<struct<id:string,sentiment:string,topic:string,confidence:double,stars:double>>"
)
ISSUES = "issues array<struct<id:string,issue:string>>"
ASSIGNMENTS = "assignments array<struct<id:string,issue:string,category:int>>"
CLUSTER_LABELS = "clusters array<struct<id:int,label:string,topic:string>>"
REPLY = "reply string"

# Column order of the appended result of a full run.
OUTPUT_COLUMNS = [
    "review_id", "source", "product_category", "rating", "review_text", "detected_language",
    "translated_text", "review_date", "sentiment", "stars_estimate", "topic", "confidence", "issue",
    "cluster_label", "customer_name", "reply", "reply_status",
]
# Column order of the human review queue.
QUEUE_COLUMNS = [
    "review_id", "detected_language", "sentiment", "topic", "review_text", "reply", "status",
    "empathy", "specificity", "correctness", "tone",
    "promises_outcome", "invents_facts", "wrong_language", "needs_human_attention",
    "acceptable", "human_accept", "human_comment",
]
# Column order of an alert.
ALERT_COLUMNS = ["week_start", "issue_category", "count", "prev_week", "wow_delta", "baseline_mean", "z"]
