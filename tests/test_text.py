import pytest
from pyspark.sql import functions as F

from grapevine.functions import labels as l
from grapevine.functions import numbers as n
from grapevine.functions import text as x


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_strip_knows_unicode_spaces(spark):
    assert one(spark, x.strip_text(F.lit("　  a b \n"))) == "a b"


def test_title_and_body_keep_the_separator_until_the_outer_strip(spark):
    assert one(spark, x.title_body_text(F.lit(" t "), F.lit(" b "))) == "t\n\nb"
    assert one(spark, x.title_body_text(F.lit(None), F.lit("b"))) == "b"
    assert one(spark, x.title_body_text(F.lit("t"), F.lit(None))) == "t"


@pytest.mark.parametrize(
    ("stars", "label"),
    [(0.0, "negative"), (1.4, "negative"), (2.5, "negative"), (2.6, "neutral"), (3.5, "positive"), (4.5, "positive"), (9.0, "positive"), (None, None)],
)
def test_estimated_stars_round_half_to_even(spark, stars, label):
    assert one(spark, l.estimated_stars_to_label(F.lit(stars).cast("double"))) == label


def test_truncate_counts_code_points(spark):
    assert one(spark, x.truncate_text(F.lit("😀é漢x"), 3)) == "😀é漢"


def test_prefix_is_dropped_once(spark):
    assert one(spark, x.without_prefix(F.lit("marc-marc-7"), "marc-")) == "marc-7"
    assert one(spark, x.without_prefix(F.lit("7-marc-"), "marc-")) == "7-marc-"


@pytest.mark.parametrize("text", ['{"a": 1}', '```json\n{"a": 1}\n```', ' ```\n{"a": 1}``` '])
def test_answers_may_be_fenced(spark, text):
    assert one(spark, x.parse_model_json(F.lit(text), "a int")).a == 1


def test_malformed_answers_have_null_fields(spark):
    assert one(spark, x.parse_model_json(F.lit("no json"), "a array<int>")["a"]) is None


def test_payload_keeps_nulls(spark):
    struct = F.struct(F.lit("é").alias("a"), F.lit(None).cast("string").alias("b"))
    assert one(spark, x.json_text(struct)) == '{"a":"é","b":null}'


def test_template_and_topic(spark):
    assert one(spark, x.fill_template(F.lit("{a} {b} {a}"), {"a": "x", "b": F.lit("y")})) == "x y x"
    assert one(spark, x.canonical_topic(F.lit("compatibility"))) == "other"
    assert one(spark, x.canonical_topic(F.lit(None).cast("string"))) == "other"


@pytest.mark.parametrize(("typed", "answer"), [(" yes", "Y"), ("n", "N"), ("", None), ("maybe", None), (None, None)])
def test_yes_no(spark, typed, answer):
    assert one(spark, x.normalise_yes_no(F.lit(typed).cast("string"))) == answer


def test_human_attention_does_not_make_a_reply_unacceptable(spark):
    row = {d: 4 for d in ("empathy", "specificity", "correctness", "tone")}
    flags = {"promises_outcome": False, "invents_facts": False, "wrong_language": False, "needs_human_attention": True}
    df = spark.createDataFrame([(*row.values(), *flags.values())], [*row, *flags])
    got = df.select(l.acceptable().alias("ok"), l.queue_status(F.lit("positive"), l.acceptable(), F.col("needs_human_attention")).alias("s")).first()
    assert got.ok and got.s == "pending_human_review"


def test_no_judge_means_pending(spark):
    none = F.lit(None).cast("boolean")
    assert one(spark, l.queue_status(F.lit("positive"), none, none)) == "pending_human_review"
    assert one(spark, l.queue_status_nojudge(F.lit("positive"))) == "draft_ready"


def test_weeks(spark):
    origin = F.to_date(F.lit("2026-06-01"))
    assert one(spark, n.week_index(F.to_date(F.lit("2026-06-07")), origin)) == 0
    assert one(spark, n.week_index(F.to_date(F.lit("2026-06-08")), origin)) == 1
    assert one(spark, n.week_label(F.lit(0))) == "W01"


def test_cost_is_exact(spark):
    cost = n.call_cost(F.lit(12_436), F.lit(9_426), F.lit(1.0), F.lit(5.0))
    assert str(one(spark, cost)) == "0.059566"


def test_vocabulary_is_cut_by_total_and_then_by_gram(spark):
    from grapevine.operators import text_features as f

    rows = spark.createDataFrame([("en", "a b c d"), ("en", "a b c d"), ("en", "a b e"), ("de", "a")] * 2, "lang string, text string")
    counted = f.char_gram_counts(rows, "text")
    every = f.vocabulary(counted, "lang").collect()
    for n in (1, 3, 7, 1000):
        wanted = set()
        for lang in ("en", "de"):
            own = sorted((r for r in every if r.lang == lang), key=lambda r: (-r.total, r.gram))
            wanted |= {(r.lang, r.gram) for r in own[:n]}
        assert {(r.lang, r.gram) for r in f.vocabulary(counted, "lang", max_terms=n).collect()} == wanted


def test_values_come_in_slices_and_in_order():
    import pandas as pd

    from grapevine.storage import in_slices

    parts = list(in_slices([pd.Series(range(600)), pd.Series([], dtype=int), pd.Series([7])], 256))
    assert [len(p) for p in parts] == [256, 256, 88, 1]
    assert [v for p in parts for v in p] == [*range(600), 7]
