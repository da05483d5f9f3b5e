import json

import pytest
from pyspark.sql import functions as F

from grapevine import schemas
from grapevine.operators import infer
from grapevine.plans import evaluation, replies, stages
from grapevine.queries import rules
from grapevine.queries.measures import playbooks
from grapevine.storage import new_folder


def reviews(spark, n=25):
    return spark.range(n).select(
        F.format_string("r%03d", "id").alias("review_id"), F.col("id").alias("ordinal"),
        F.repeat(F.lit("a"), (F.col("id") + 1).cast("int")).alias("review_text"),
        F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("detected_language"),
    )


def answer(body):
    return {"content": [{"type": "text", "text": json.dumps(body)}], "tokens_in": 10, "tokens_out": 5}


def test_a_batch_holds_ten_rows_and_every_row_comes_back(spark):
    rows, calls = stages.classify(reviews(spark), rules.caller(rules.classify))
    assert sorted(r.n for r in calls.select(F.size("rows").alias("n")).collect()) == [5, 10, 10]
    got = {r.review_id: r for r in rows.collect()}
    assert len(got) == 25
    assert got["r012"].error == "not classified" and got["r012"].sentiment is None  # 13 characters
    assert got["r006"].topic == "other"  # the rule answers "compatibility" there
    assert got["r004"].stars_estimate == 2.5 and got["r004"].sentiment == "negative"  # half to even


def test_a_failing_call_marks_its_rows_and_the_run_goes_on(spark):
    def fail(payload):
        if any(item["id"] == "r003" for item in json.loads(payload)):
            raise RuntimeError("x" * 500)
        return rules.translate(payload)

    rows, calls = stages.translate_all(reviews(spark), rules.caller(fail))
    status = {r.translation_status: r.n for r in rows.groupBy("translation_status").agg(F.count("*").alias("n")).collect()}
    assert status["not_needed"] == 13 and status["failed"] >= 8 and rows.count() == 25
    bad = rows.where("review_id = 'r003'").first()
    assert bad.translation_error == "x" * 200 and bad.translated_text is None
    assert calls.where("response.call_error is not null").count() == 1


def test_a_call_is_tried_three_times(spark, tmp_path):
    log = str(tmp_path / "tries")

    def flaky(payload):
        with open(log, "a") as file:
            file.write("x")
        with open(log) as file:
            if len(file.read()) < 3:
                raise RuntimeError("again")
        return rules.classify(payload)

    rows, _ = stages.classify(reviews(spark, 5), rules.caller(flaky))
    assert rows.where("error is null").count() == 5
    assert open(log).read() == "xxx"


def test_malformed_and_partial_answers(spark):
    def broken(payload):
        return {"content": [{"type": "text", "text": "I am sorry"}], "tokens_in": 1, "tokens_out": 1}

    rows, _ = stages.classify(reviews(spark, 3), rules.caller(broken))
    assert {r.error for r in rows.collect()} == {"malformed response"}

    def twice(payload):
        ids = [i["id"] for i in json.loads(payload)]
        return answer({"issues": [{"id": ids[0], "issue": "first"}, {"id": ids[0], "issue": "last"}, {"id": "zz", "issue": "?"}]})

    rows, _ = stages.issue_phrases(reviews(spark, 2), rules.caller(twice))
    assert {(r.review_id, r.issue, r.error) for r in rows.collect()} == {
        ("r000", "last", None), ("r001", None, "missing from response"),
    }


def test_results_are_paid_for_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def counted(payload):
        with open(log, "a") as file:
            file.write("x")
        return rules.classify(payload)

    rows, calls = stages.classify(reviews(spark), rules.caller(counted))
    rows.count(), rows.collect(), calls.count()
    infer.call_ledger(calls, rules.caller(counted), "p").collect()
    assert open(log).read() == "xxx"


def test_ledger_takes_the_dearer_price_for_an_unknown_model(spark):
    for model, price in (("rule-small", (1, 5)), ("somebody-else", (2, 10))):
        who = infer.Caller(lambda payload: answer({"issues": []}), model, rules.PRICES)
        _, calls = stages.issue_phrases(reviews(spark, 1), who)
        row = infer.call_ledger(calls, who, "issue_v1").first()
        assert row.cost_usd == pytest.approx(10 / 1e6 * price[0] + 5 / 1e6 * price[1], abs=1e-9)
        assert (row.purpose, row.prompt_version, row.model) == ("issue_phrase", "issue_v1", model)


def test_the_spend_cap_defers_requests(spark):
    who = rules.caller(rules.classify, cap_usd=0.02, spent_usd=0.005, est_call_usd=0.01)
    rows, calls = stages.classify(reviews(spark), who)
    assert sorted(r.admission for r in calls.collect()) == ["admit", "admit", "deferred"]
    assert rows.where("error = 'deferred: spend cap reached'").count() in (5, 10)
    assert rows.count() == 25


def test_unknown_sentiment_has_no_playbook(spark):
    rows = reviews(spark, 1).withColumns({"sentiment": F.lit("angry"), "topic": F.lit("price"), "issue": F.lit(None), "customer_name": F.lit("Kim")})
    with pytest.raises(Exception, match="no playbook for angry/price"):
        stages.draft_replies(rows, rules.caller(rules.reply), playbooks(spark))


def test_negatives_always_wait_for_a_human(spark):
    rows = reviews(spark, 40).drop("ordinal", "detected_language").withColumns(
        {
            "customer_name": F.lit("Kim"), "topic": F.lit("price"), "issue": F.lit(None).cast("string"),
            "sentiment": F.when(F.length("review_text") % 2 == 0, "negative").otherwise("positive"),
        }
    )
    callers = [rules.caller(f) for f in (rules.classify, rules.issue, rules.reply)]
    done, _ = replies.draft_response(rows, *callers, playbooks(spark), rules.caller(rules.judge))
    got = done.collect()
    assert len(got) == 40
    assert all(r.status == "pending_human_review" for r in got if r.sentiment == "negative")
    approved = [r for r in got if r.status == "auto_approved"]
    assert approved and all(r.acceptable and not r.needs_human_attention for r in approved)
    assert all(r.status == "pending_human_review" for r in got if r.reply is None)


def test_second_evaluation_asks_only_for_what_failed(spark, tmp_path):
    log = str(tmp_path / "ids")

    def partial(payload):
        with open(log, "a") as file:
            file.write(" ".join(i["id"] for i in json.loads(payload)) + "\n")
        return rules.classify(payload)

    rows = reviews(spark).withColumns({"label": F.lit("negative"), "rating": F.lit(1)})
    cache, who = new_folder(spark, "cache"), rules.caller(partial)
    first = evaluation.sentiment_eval(rows, who, cache, "p", seq=1)
    assert first["missing"].first().missing == 1 and first["rows"].count() == 24
    open(log, "w").close()
    again = evaluation.sentiment_eval(rows, who, cache, "p", seq=2)
    assert open(log).read().split() == ["r012"]
    assert again["plan"].first().pending == 1
    assert spark.read.schema(schemas.PREDICTION_CACHE).json(cache).count() == 24


def test_costly_runs_need_a_confirmation(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("review_id"), F.lit("x").alias("review_text"), F.lit("negative").alias("label"))
    with pytest.raises(evaluation.ConfirmationNeeded):
        evaluation.sentiment_eval(rows, rules.caller(rules.classify), new_folder(spark, "cache"), "p", seq=1)


def meets_three_others(payload):
    """Passes only while four calls are in flight, and counts how many there are."""
    import sys
    import threading

    place = vars(sys).setdefault("_calls", {"gate": threading.Barrier(4), "lock": threading.Lock(), "now": 0, "most": 0})
    with place["lock"]:
        place["now"] += 1
        place["most"] = max(place["most"], place["now"])
    place["gate"].wait(timeout=20)
    with place["lock"]:
        place["now"] -= 1
    return {"content": [{"type": "text", "text": f"{payload}:{place['most']}"}], "tokens_in": 1, "tokens_out": 1}


def test_four_calls_are_in_flight_and_answers_keep_their_rows(spark):
    rows = spark.createDataFrame([(str(i), f"text {i}") for i in range(40)], "id string, text string").coalesce(1)
    caller = infer.Caller(meets_three_others, "m", tries=1)
    responses = rows.withColumn("response", infer.request_column(caller)(F.col("text"))).collect()
    assert len(responses) == 40 and all(r.response.call_error is None for r in responses)
    found = [r.response.content[0].text.split(":") for r in responses]
    assert [text for text, _ in found] == [r.text for r in responses] and {int(most) for _, most in found} == {4}


def test_responses_keep_only_the_named_columns(spark):
    rows = reviews(spark)
    payload = infer.batch_payload("review_id", "review_text")
    responses = infer.infer_batches(rows, rules.caller(rules.classify), "review_id", payload, 10, "classify", keep=["review_id"])
    assert "payload" not in responses.columns
    kept = responses.select(F.explode("rows").alias("row")).select("row.*")
    assert kept.columns == ["review_id"]
    assert sorted(r.review_id for r in kept.collect()) == sorted(r.review_id for r in rows.select("review_id").collect())


def test_reply_evaluation_shows_whole_texts_and_stores_none_with_its_calls(spark):
    texts = {f"r{i}": "x" * (1600 + i) for i in range(12)} | {"r3": "short"}
    rows = spark.createDataFrame(
        [(k, i, "en", ["negative", "neutral", "positive"][i % 3], "shipping", None, t) for i, (k, t) in enumerate(texts.items())],
        "review_id string, ordinal bigint, detected_language string, sentiment string, topic string, issue string, review_text string")
    rows = rows.unionByName(rows.where("ordinal = 3").withColumn("ordinal", F.lit(99)))  # an id twice
    base = new_folder(spark, "evaluation")
    found = replies.reply_evaluation(
        rows, rules.caller(rules.reply), rules.caller(rules.judge), playbooks(spark), replies.CacheFiles(f"{base}/r", f"{base}/s"), 1,
        {"en": ["Nora"]}, n=None)
    got = found["evaluation"].collect()
    assert found["evaluation"].columns[:7] == rows.columns and {r.review_id for r in got} == {k for k, t in texts.items() if min(len(t), 1500) % 17}
    assert all(r.review_text == texts[r.review_id] for r in got) and sum(r.review_id == "r3" for r in got) == 2
    for calls in ("drafting_calls", "judging_calls"):
        assert found[calls].select(F.col("rows")[0].alias("r")).select("r.*").columns == ["key"]


def test_the_full_run_hands_no_texts_from_stage_to_stage_and_keeps_repeated_and_null_ids(spark):
    rows = reviews(spark, 30).withColumns({
        "source": F.lit("s"), "rating": F.lit(1), "product_category": F.lit(None).cast("string"), "review_date": F.lit(None).cast("date"),
        "review_id": F.when(F.col("ordinal") == 3, "r002").when(F.col("ordinal") != 5, F.col("review_id")),
    })
    callers = [rules.caller(f) for f in (rules.translate, rules.classify, rules.assign, rules.reply)]
    whole, calls = replies.full_run(rows, *callers, playbooks(spark), {"en": ["Kim"], "de": ["Ulf"]})
    stored = {stage: set(table.schema["rows"].dataType.elementType.names) for stage, table in calls.items()}
    assert not [stage for stage, names in stored.items() if names & {"review_text", "translated_text"}]
    got = {r.ordinal: r for r in whole.collect()}
    assert len(got) == whole.count() == 30 and got[5].review_id is None and got[3].review_id == "r002"
    for i, row in got.items():
        assert row.review_text == "a" * (i + 1)
        assert row.translation_status == ("not_needed" if i % 2 == 0 else row.translation_status)
        assert i % 2 or row.translated_text == row.review_text
    assert whole.columns[:len(rows.columns)] == rows.columns and "_row" not in whole.columns


def test_the_full_run_reads_texts_to_their_end(spark):
    """Texts of one kind differ only in length, beyond what issues and replies used to go by."""
    lengths = [4 + 12 * k for k in range(57, 64)] + [4 + 12 * k for k in range(124, 134)]  # 2 stars: negative
    lengths = [n for n in lengths if n % 13 and n % 11 and n % 17]
    rows = reviews(spark, len(lengths)).withColumns({
        "review_text": F.repeat(F.lit("a"), F.get(F.array(*map(F.lit, lengths)), F.col("ordinal").cast("int")).cast("int")),
        "source": F.lit("s"), "rating": F.lit(1), "product_category": F.lit(None).cast("string"), "review_date": F.lit(None).cast("date"),
        "detected_language": F.lit("en"),
    })
    seen = []
    for options in ({}, {"issue_chars": 700, "draft_chars": 1500}):
        callers = [rules.caller(f) for f in (rules.translate, rules.classify, rules.assign, rules.reply)]
        whole, _ = replies.full_run(rows, *callers, playbooks(spark), {"en": ["Kim"]}, **options)
        seen.append({r.ordinal: r for r in whole.collect()})
    assert len(seen[0]) == len(lengths) > 8 and max(lengths) > 1500
    for i, n in enumerate(lengths):
        assert (seen[0][i].issue, seen[0][i].category) == (f"issue {n % 7}", n % 14 - 1)
        assert seen[0][i].reply_status == "pending_human_review"
        assert seen[1][i].issue == f"issue {min(n, 700) % 7}"


def test_replies_of_the_full_run_depend_on_the_end_of_long_texts(spark):
    rows = reviews(spark, 1).withColumns({
        "review_text": F.repeat(F.lit("a"), 17 * 96), "source": F.lit("s"), "rating": F.lit(1),  # the rule fails at this length, not at 1,500
        "product_category": F.lit(None).cast("string"), "review_date": F.lit(None).cast("date"),
    })
    callers = [rules.caller(f) for f in (rules.translate, rules.classify, rules.assign, rules.reply)]
    whole, _ = replies.full_run(rows, *callers, playbooks(spark), {"en": ["Kim"]})
    assert [r.reply_status for r in whole.collect()] == ["failed"]
