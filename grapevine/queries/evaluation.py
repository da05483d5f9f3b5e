"""Queries: sentiment evaluation and issue assignment evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import evaluation as jobs
from ..storage import new_folder
from . import rules
from .measures import _report
from .registry import query
from .stages import ANSWERED, N, STARS, _STRAY
from .standins import REVIEWS, cluster_rows, estimate_sql, label_sql, reviews


def _evaluate(spark, folder):
    """Two runs on one cache: the second asks again only for what got no answer."""
    rows = jobs.evaluation_split(reviews(spark, folder).drop("topic", "stars_estimate"), "test")
    cache = new_folder(spark, "predictions")
    who = rules.caller(rules.classify)
    jobs.sentiment_eval(rows, who, cache, "p1", seq=1, confirmed=True)
    return jobs.sentiment_eval(rows, who, cache, "p1", seq=2, confirmed=True)


SPLIT = f"""rv AS (SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY detected_language, rating ORDER BY ordinal) > 8)"""


def _sql(pred: str) -> str:
    truth = f"{SPLIT}, truth AS (SELECT *, {label_sql('rating')} AS label, {pred} AS pred FROM rv WHERE {ANSWERED})"
    report = _report("SELECT lang, n, round_even(acc, 3) AS accuracy, round_even(macro, 3) AS macro_f1, round_even(bin, 3) AS binary_accuracy FROM q")
    start = report.index("truth AS (")
    end = report.index("both_ AS (")
    return report[:start] + truth + ", " + report[end:]


@query(_sql(f"['negative', 'neutral', 'positive'][{N} % 3 + 1]"))
def sentiment_eval(spark, folder):
    return _evaluate(spark, folder)["report"]


@query(_sql(estimate_sql(STARS)))
def sentiment_eval_from_stars(spark, folder):
    return _evaluate(spark, folder)["report_from_stars"]


@query(
    f"""WITH {REVIEWS}, {SPLIT} SELECT {_STRAY}[{N} % 8 + 1] AS topic, count(*) AS n FROM rv WHERE {ANSWERED} GROUP BY ALL"""
)
def sentiment_eval_topics(spark, folder):
    return _evaluate(spark, folder)["topics"]


@query(
    """WITH t AS (SELECT label AS cluster, 5 + vec_id % 40 AS n FROM embeddings),
g AS (SELECT cluster, n % 14 - 1 AS category FROM t WHERE n % 11 > 0)
SELECT count(*) AS assigned, round(avg((cluster = category)::INTEGER), 6) AS agreement,
  round(avg((category = -1)::INTEGER), 6) AS none_share FROM g"""
)
def issue_assignment_eval(spark, folder):
    """The sample is set to the whole table, so that SQL can state the result."""
    rows = cluster_rows(spark, folder).select(
        "review_id", "cluster", F.concat(F.lit("text "), F.repeat(F.lit("x"), (F.col("review_id") % 40).cast("int"))).alias("review_text")
    )
    found = jobs.issue_assignment_eval(rows, rules.caller(rules.assign), n=None)["agreement"]
    return found.withColumns({c: F.round(c, 6) for c in ("agreement", "none_share")})
