"""Model stages: rows in, rows with answers and an error column out.

Each returns ``(rows, responses)``; ``responses`` is the stored call table for the ledger.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..fixed import DRAFT_CHARS, ISSUE_CATEGORIES, ISSUE_CHARS
from ..functions.labels import acceptable, estimated_stars_to_label
from ..functions.text import canonical_topic, json_text, strip_text, truncate_text
from ..operators.clustering import cluster_examples
from ..operators.infer import Caller, answers_by_id, batch_payload, infer_batches, single_answers
from ..operators.joins import label_lookup, pick_playbook
from ..operators.reviews import english_passthrough, split_by_language
from ..operators.sets import union_by_name

Stage = tuple[DataFrame, DataFrame]


def classify(
    rows: DataFrame, caller: Caller, id_column: str = "review_id", text: str = "review_text", size: int = 10,
    keep: Sequence[str] | None = None,
) -> Stage:
    """Sentiment from the estimated stars, canonical topic, confidence and the model's own label.

    ``keep``: the columns of the rows to return, with ``id_column`` among them, else all.
    """
    payload = batch_payload(id_column, text)
    responses = infer_batches(rows, caller, id_column, payload, size, "classify", keep=keep)
    answered = answers_by_id(responses, schemas.CLASSIFICATIONS, "classifications", id_column, "not classified")
    answer = F.col("answer")
    named = answered.withColumns(
        {
            "sentiment": estimated_stars_to_label(answer["stars"]),
            "stars_estimate": answer["stars"],
            "topic": F.when(answer.isNotNull(), canonical_topic(answer["topic"])),
            "confidence": answer["confidence"],
            "model_label": answer["sentiment"],
        }
    )
    return named.drop("answer"), responses


def issue_phrases(
    rows: DataFrame, caller: Caller, id_column: str = "review_id", text: str = "review_text", size: int = 10
) -> Stage:
    """A short phrase per review that names the problem; no answer leaves it null."""
    payload = batch_payload(id_column, text, ISSUE_CHARS)
    responses = infer_batches(rows, caller, id_column, payload, size, "issue_phrase")
    answered = answers_by_id(responses, schemas.ISSUES, "issues", id_column)
    return answered.withColumn("issue", F.col("answer")["issue"]).drop("answer"), responses


def assign_issues(
    rows: DataFrame, caller: Caller, id_column: str = "review_id", text: str = "review_text", size: int = 10,
    keep: Sequence[str] | None = None, length: int | None = None,
) -> Stage:
    """Issue phrase and category id (-1: none fits) with the category's label.

    ``keep``: the columns of the rows to return, with ``id_column`` among them, else all. The model reads whole texts, or their first
    ``length`` code points.
    """
    payload = batch_payload(id_column, text, length)
    responses = infer_batches(rows, caller, id_column, payload, size, "assign_issue", keep=keep)
    answered = answers_by_id(responses, schemas.ASSIGNMENTS, "assignments", id_column)
    named = answered.withColumns({"issue": F.col("answer")["issue"], "category": F.col("answer")["category"]})
    return label_lookup(named.drop("answer"), ISSUE_CATEGORIES, "category", "cluster_label"), responses


def translate(
    rows: DataFrame, caller: Caller, prompt: str = "translate_v1", size: int = 8, id_column: str = "review_id",
    keep: Sequence[str] | None = None,
) -> Stage:
    """English text and detected language; a review without an answer is kept as ``failed`` with its error.

    ``keep``: the columns of the rows to return, with ``id_column`` among them, else all.
    """
    payload = batch_payload(id_column, "review_text")
    responses = infer_batches(rows, caller, id_column, payload, size, "translate", keep=keep)
    answered = answers_by_id(responses, schemas.TRANSLATIONS, "translations", id_column)
    answer = F.col("answer")
    named = answered.withColumns(
        {
            "translated_text": answer["english"],
            "translation_language": answer["language"],
            "translation_status": F.when(answer.isNotNull(), "ok").otherwise("failed"),
            "translation_error": F.col("error"),
            "translation_prompt": F.lit(prompt),
            "translation_model": F.lit(caller.model),
        }
    )
    return named.drop("answer", "error"), responses


def translate_all(rows: DataFrame, caller: Caller, keep: Sequence[str] | None = None, **options) -> Stage:
    """English reviews pass through, all others are translated. ``keep``: as in ``translate``."""
    english, others = split_by_language(rows)
    done, responses = translate(others, caller, keep=keep, **options)
    passed = english_passthrough(english)
    return union_by_name(passed if keep is None else passed.select(*done.columns), done), responses


def label_clusters(
    rows: DataFrame, caller: Caller, cluster: str, id_column: str = "review_id", text: str = "review_text", size: int = 50
) -> Stage:
    """(cluster, size, label, topic): each cluster named from examples of its texts."""
    examples = cluster_examples(rows, cluster, id_column, text)

    def payload(items: Column) -> Column:
        return json_text(
            F.transform(items, lambda r: F.struct(r["id"].alias("id"), r["size"].alias("size"), r["examples"].alias("examples")))
        )

    responses = infer_batches(examples, caller, "id", payload, size, "label_clusters")
    answered = answers_by_id(responses, schemas.CLUSTER_LABELS, "clusters", "id")
    return (
        answered.select(
            F.col("id").alias("cluster"), "size", F.col("answer")["label"].alias("label"),
            F.col("answer")["topic"].alias("topic"), "error",
        ),
        responses,
    )


def draft_payload(rows: Column, length: int | None = DRAFT_CHARS) -> Column:
    """Request text of one reply: the review or its first ``length`` code points, what is known about it, and the playbook."""
    r = F.get(rows, F.lit(0))
    review = r["review_text"] if length is None else truncate_text(r["review_text"], length)
    return json_text(
        F.struct(
            review.alias("review"), r["customer_name"].alias("customer_name"),
            r["sentiment"].alias("sentiment"), r["topic"].alias("topic"), r["issue"].alias("issue"),
            r["playbook"].alias("playbook"),
        )
    )


def judge_payload(rows: Column) -> Column:
    r = F.get(rows, F.lit(0))
    return json_text(
        F.struct(
            truncate_text(r["review_text"], DRAFT_CHARS).alias("review"), r["reply"].alias("reply"),
            r["sentiment"].alias("sentiment"), r["topic"].alias("topic"), r["customer_name"].alias("customer_name"),
        )
    )


def draft_replies(
    rows: DataFrame, caller: Caller, playbooks: DataFrame, id_column: str = "review_id", usage: bool = False,
    keep: Sequence[str] | None = None, length: int | None = DRAFT_CHARS,
) -> Stage:
    """One reply per review from its playbook; with ``usage`` also the tokens of its call. ``keep``: the columns to return, else all.

    The model reads the first ``length`` code points of a text, all for None.
    """
    guided = pick_playbook(rows, playbooks)
    payload = partial(draft_payload, length=length)
    responses = infer_batches(guided, caller, id_column, payload, 1, "draft_response", keep=keep)
    answered = single_answers(responses, schemas.REPLY, "reply", usage)
    return answered.withColumn("reply", strip_text(F.col("answer")["reply"])).drop("answer", "playbook"), responses


def judge_replies(
    rows: DataFrame, caller: Caller, id_column: str = "review_id", usage: bool = False, keep: Sequence[str] | None = None
) -> Stage:
    """Scores, flags, reason and the acceptance that follows from them; with ``usage`` also the tokens of the call.

    ``keep``: the columns of the rows to return, else all.
    """
    responses = infer_batches(rows, caller, id_column, judge_payload, 1, "judge", keep=keep)
    answered = single_answers(responses, schemas.JUDGE_ANSWER, "empathy", usage)
    named = answered.select(*[c for c in answered.columns if c not in ("answer",)], "answer.*")
    return named.withColumn("acceptable", acceptable()), responses
