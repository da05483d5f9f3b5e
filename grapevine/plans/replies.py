"""Reply jobs: draft and judge on request, the evaluation run, and the full run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..fixed import DIMENSIONS, DRAFT_CHARS, FLAG_NAMES, FLAGS, PENDING, SENTIMENTS
from ..functions.labels import acceptable, queue_status, queue_status_nojudge, raised_flags, stars_to_label
from ..functions.text import cache_key, one_line, reply_digest, truncate_text
from ..operators import aggregates as a
from ..operators.infer import Caller, call_ledger
from ..operators.joins import attach_cached, latest_per_key, pending_rows, with_predictions
from ..operators.reviews import drop_missing_predictions, fill_missing_labels, issue_gate, queue_table
from ..operators.sampling import assign_round_robin, first_examples, sample_per_group
from ..operators.sets import union_by_name
from ..sources.readers import read_cache
from ..sources.writers import append_cache
from ..storage import exists, materialise
from .stages import assign_issues, classify, draft_replies, issue_phrases, judge_replies, translate_all


USED = ["tin", "tout"]
TRANSLATION = [
    "translated_text", "translation_language", "translation_status", "translation_error", "translation_prompt", "translation_model",
]


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A cache that may not exist before its first run. A path that is there but cannot be read is an error."""
    return read_cache(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def draft_response(
    requests: DataFrame, classifier: Caller, phraser: Caller, drafter: Caller, playbooks: DataFrame, judge: Caller | None = None
) -> tuple[DataFrame, list[DataFrame]]:
    """Replies for requests (review_id, review_text, customer_name, sentiment?, topic?, issue?).

    Missing labels are classified, negatives without an issue get a phrase, the reply is drafted, and judged when a
    judge is given. Only an accepted non-negative reply is approved. A request that cannot be classified keeps its
    error and gets no reply.
    """
    lacking = F.col("sentiment").isNull() | F.col("topic").isNull()
    given, unlabelled = requests.where(~lacking), requests.where(lacking)
    asked = unlabelled.withColumnsRenamed({"sentiment": "given_sentiment", "topic": "given_topic"})
    classified, first = classify(asked, classifier)
    predicted = classified.withColumnsRenamed({"sentiment": "pred_sentiment", "topic": "pred_topic"}).withColumnsRenamed(
        {"given_sentiment": "sentiment", "given_topic": "topic"}
    )
    filled = fill_missing_labels(predicted).select(*requests.columns, "error")
    labelled = given.withColumn("error", F.lit(None).cast("string")).unionByName(filled)
    failed = labelled.where(F.col("error").isNotNull())
    ready = labelled.where(F.col("error").isNull()).drop("error")
    needed, others = issue_gate(ready)
    phrased, second = issue_phrases(needed.drop("issue"), phraser)
    with_issue = union_by_name(others, phrased.drop("error"))
    drafted, third = draft_replies(with_issue, drafter, playbooks)
    calls = [first, second, third]
    if judge is not None:
        replied = drafted.where(F.col("reply").isNotNull()).drop("error")
        judged, fourth = judge_replies(replied, judge)
        calls.append(fourth)
        silent = drafted.where(F.col("reply").isNull())
        done = judged.unionByName(silent, allowMissingColumns=True)
    else:
        none = {d: F.lit(None).cast("int") for d in DIMENSIONS} | {f: F.lit(None).cast("boolean") for f in FLAGS}
        done = drafted.withColumns(
            none | {"reason": F.lit(None).cast("string"), "acceptable": F.lit(None).cast("boolean")}
        )
    status = queue_status(F.col("sentiment"), F.col("acceptable"), F.col("needs_human_attention"))
    result = done.unionByName(failed, allowMissingColumns=True)
    return result.withColumn("status", F.when(F.col("reply").isNotNull(), status).otherwise(PENDING)), calls


@dataclass(frozen=True)
class CacheFiles:
    """Where the answers of a run are kept."""

    replies: str
    scores: str


def evaluation_set(
    rows: DataFrame, names: Mapping[str, Sequence[str]], n: int | None = 2, ordinal: str = "ordinal"
) -> DataFrame:
    """Per language 2n negative, n neutral and n positive reviews, all for None, with a customer name dealt in turn."""
    return assign_round_robin(evaluation_sample(rows, n), ordinal, "detected_language", names, "customer_name")


def evaluation_sample(rows: DataFrame, n: int | None = 2) -> DataFrame:
    """Per language 2n negative, n neutral and n positive reviews, all for None."""
    known = rows.where(F.col("sentiment").isin(SENTIMENTS))
    quota = None if n is None else F.when(F.col("sentiment") == "negative", 2 * n).otherwise(n)
    return sample_per_group(known, ["detected_language", "sentiment"], "review_id", quota)


def evaluation_rows(rows: DataFrame, predictions: DataFrame, issues: DataFrame, prompt: str, model: str) -> DataFrame:
    """Reviews with the sentiment and topic of their cached classification and the issue of their cached phrase.

    Reviews that were never classified are left out; of several cached records the last counts. ``predictions`` are keyed by prompt,
    model and review, ``issues`` by the review's id.
    """
    keyed = rows.drop("sentiment", "topic", "issue").withColumn("key", cache_key(F.lit(prompt), F.lit(model), F.col("review_id")))
    known = with_predictions(keyed, predictions).withColumnsRenamed({"pred": "sentiment", "pred_topic": "topic"}).drop("key", "conf", "stars_pred")
    phrases = latest_per_key(issues.where(F.col("id").isNotNull()), "id").select(F.col("id").alias("_issue_of"), "issue")
    return known.join(phrases, F.col("review_id") == F.col("_issue_of"), "left").drop("_issue_of")


def with_texts(part: DataFrame, numbered: DataFrame, length: int | None = None) -> DataFrame:
    """``part`` with the ``review_text`` that its ``_row`` has in ``numbered``, or the first ``length`` code points of it."""
    text = F.col("review_text") if length is None else truncate_text(F.col("review_text"), length)
    read = numbered.select(F.col("_row").alias("_of"), text.alias("review_text"))
    return part.join(read, F.col("_row") == F.col("_of")).drop("_of")


def reply_evaluation(
    rows: DataFrame,
    drafter: Caller,
    judge: Caller,
    playbooks: DataFrame,
    files: CacheFiles,
    seq: int,
    names: Mapping[str, Sequence[str]],
    n: int | None = 2,
    reply_prompt: str = "response_v2",
    judge_prompt: str = "judge_v1n",
    ordinal: str = "ordinal",
) -> dict[str, DataFrame]:
    """Draft and judge an evaluation set, reusing cached answers; failed calls are retried by the next run.

    Returns ``evaluation``, ``means``, ``flags``, ``not_acceptable``, ``queue``, and ``spent``: calls, tokens and cost of
    this run per stage. The set is written once, with a number per row; names, cached answers and measures go without the
    texts, which are joined by that number where a model is asked (as far as it reads them) and to the tables that show them.
    """
    spark = rows.sparkSession
    numbered = evaluation_sample(rows, n).withColumn("_row", F.monotonically_increasing_id())
    chosen = materialise(numbered, name="evaluation-set")

    def with_text(part: DataFrame, length: int | None = None) -> DataFrame:
        return with_texts(part, chosen, length).drop("_row")

    reply_key = cache_key(F.lit(reply_prompt), F.lit(drafter.model), F.col("review_id"), F.col("customer_name"))
    named = assign_round_robin(chosen.drop("review_text"), ordinal, "detected_language", names, "customer_name")
    keyed = materialise(named.withColumn("key", reply_key), name="evaluation-names")
    known = read_or_empty(spark, files.replies, schemas.REPLY_CACHE)
    undrafted = materialise(pending_rows(keyed, known), name="undrafted")
    drafted, calls = draft_replies(with_text(undrafted, DRAFT_CHARS), drafter, playbooks, usage=True, keep=["key"])
    fresh = drafted.where(F.col("reply").isNotNull())
    append_cache(fresh.select("key", "reply", *USED), files.replies, seq)
    replies = latest_per_key(read_cache(spark, files.replies, schemas.REPLY_CACHE))
    with_reply = drop_missing_predictions(attach_cached(keyed, replies, {"reply": "reply"}).drop("key"), "reply")

    score_key = cache_key(F.lit(judge_prompt), F.lit(judge.model), F.col("review_id"), reply_digest(F.col("reply")))
    asked = with_reply.withColumn("key", score_key)
    scored_before = read_or_empty(spark, files.scores, schemas.JUDGE_CACHE)
    unjudged = materialise(pending_rows(asked, scored_before), name="unjudged")
    judged, more = judge_replies(with_text(unjudged, DRAFT_CHARS), judge, usage=True, keep=["key"])
    good = judged.where(F.col("error").isNull())
    fields = [*DIMENSIONS, *FLAGS, "reason"]
    append_cache(good.select("key", *fields, *USED), files.scores, seq)
    scores = latest_per_key(read_cache(spark, files.scores, schemas.JUDGE_CACHE))
    scored = drop_missing_predictions(attach_cached(asked, scores, {f: f for f in fields}).drop("key"), "empathy")

    status = queue_status(F.col("sentiment"), F.col("acceptable"), F.col("needs_human_attention"))
    done = materialise(
        scored.withColumn("acceptable", acceptable()).withColumn("status", status), name="reply-evaluation"
    )
    evaluation = with_text(done).select(*rows.columns, *[c for c in done.columns if c not in [*rows.columns, "_row"]])
    shown = evaluation.withColumns(
        {
            "flags": raised_flags({f: f for f in FLAG_NAMES}),
            "review_start": one_line(F.col("review_text"), 110),
            "reply_start": one_line(F.col("reply"), 160),
        }
    )
    return {
        "evaluation": evaluation,
        "means": a.judge_means(done),
        "flags": a.flag_counts(done),
        "not_acceptable": first_examples(shown, ~F.col("acceptable"), ordinal),
        "queue": queue_table(evaluation),
        "spent": run_usage({"draft_response": calls, "judge": more}, {"draft_response": drafter, "judge": judge}),
        "drafting_calls": calls,
        "judging_calls": more,
    }


def full_run(
    reviews: DataFrame, translator: Caller, classifier: Caller, assigner: Caller, drafter: Caller,
    playbooks: DataFrame, names: Mapping[str, Sequence[str]], ordinal: str = "ordinal",
    issue_chars: int | None = None, draft_chars: int | None = None,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Translate, classify, name the issue of negatives, draft replies and set their state.

    Every stage reads whole texts, unless ``issue_chars`` or ``draft_chars`` name how many code points issues and replies are to go by.
    Every review stays; a failed call shows in the status column of its stage. The reviews are written once, with a number per row;
    answers and labels go from stage to stage without the texts, which are joined by that number where a model is asked (as far as
    it reads them) and to the result. Returns the reviews and the response table per stage.
    """
    numbered = materialise(reviews.withColumn("_row", F.monotonically_increasing_id()), name="reviews")
    facts = [c for c in numbered.columns if c not in ("review_text", *TRANSLATION)]
    asked = numbered.select("_row", "review_id", "review_text", "detected_language")
    translated, t_calls = translate_all(asked, translator, keep=["_row", "review_id"])
    classified, c_calls = classify(numbered.select(*facts, "review_text"), classifier, keep=facts)
    state = F.when(F.col("error").isNull(), "ok").otherwise("failed")
    labelled = classified.withColumn("classification_status", state).drop("error")
    negative = F.coalesce(F.col("sentiment") == "negative", F.lit(False))
    assigned, i_calls = assign_issues(
        with_texts(labelled.where(negative), numbered, issue_chars), assigner, keep=labelled.columns, length=issue_chars)
    with_issue = assigned.withColumn("issue_status", state).drop("error")
    others = labelled.where(~negative).withColumn("issue_status", F.lit("not_needed"))
    joined = with_issue.unionByName(others, allowMissingColumns=True)
    named = materialise(assign_round_robin(joined, ordinal, "detected_language", names, "customer_name"), name="issues")
    ready = with_texts(named.where(F.col("sentiment").isNotNull()), numbered, draft_chars)
    drafted, d_calls = draft_replies(ready, drafter, playbooks, keep=named.columns, length=draft_chars)
    reply_status = F.when(F.col("reply").isNull(), "failed").otherwise(queue_status_nojudge(F.col("sentiment")))
    replied = drafted.withColumn("reply_status", reply_status).drop("error")
    unlabelled = named.where(F.col("sentiment").isNull()).withColumn("reply_status", F.lit("failed"))
    answered = replied.unionByName(unlabelled, allowMissingColumns=True)
    whole = with_texts(answered.join(translated.drop("review_id"), "_row"), numbered)
    first = list(dict.fromkeys([*reviews.columns, *TRANSLATION]))
    result = whole.select(*first, *[c for c in answered.columns if c not in [*first, "_row"]])
    return result, {"translate": t_calls, "classify": c_calls, "assign_issue": i_calls, "draft_response": d_calls}


STAGES = ["translation_status", "classification_status", "issue_status", "reply_status"]


def run_summary(result: DataFrame) -> DataFrame:
    """Counts per status of every stage. A run that finished can still hold failures: look here."""
    return a.stage_summary(result, STAGES)


def run_scores(result: DataFrame) -> DataFrame:
    """Accuracy of the run's sentiment against the star rating, over the classified reviews."""
    classified = result.where(F.col("sentiment").isNotNull())
    return a.model_scores(classified.withColumn("label", stars_to_label(F.col("rating"))), "label", "sentiment")


def run_usage(responses: Mapping[str, DataFrame], callers: Mapping[str, Caller]) -> DataFrame:
    """Calls, failed calls, tokens, cost and seconds of the model per stage."""
    parts = []
    for stage, table in responses.items():
        ledger = call_ledger(table, callers[stage], stage)
        sums = ledger.groupBy(F.col("purpose").alias("stage")).agg(
            F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
            F.round(F.sum("cost_usd"), 4).alias("cost_usd"), F.round(F.sum("latency_s"), 2).alias("seconds"),
        )
        lost = table.agg(F.count_if(F.col("response.call_error").isNotNull())).scalar()
        parts.append(sums.withColumn("failed_calls", lost))
    return union_by_name(*parts)
