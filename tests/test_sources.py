import json
import random
import re

import pytest
from pyspark.sql import functions as F

from grapevine.plans import ingest
from grapevine.sources import readers, writers
from grapevine.sources.cache import KeyedCache
from grapevine.sources.split_csv import quoted_records, read_quoted_csv
from grapevine.storage import exists, materialise, new_folder, remove_work, run_folder, shared_folder


def test_language_comes_from_the_path_and_blank_lines_are_skipped(spark, tmp_path):
    for lang in ("en", "ja"):
        (tmp_path / lang).mkdir()
        lines = [json.dumps({"id": f"{lang}1", "text": " hi ", "label": 4}), "", json.dumps({"id": f"{lang}2", "text": "x", "label": 0})]
        (tmp_path / lang / "test.jsonl").write_text("\n".join(lines))
    raw = readers.read_reviews_jsonl(spark, [str(tmp_path / "en" / "test.jsonl"), str(tmp_path / "ja" / "test.jsonl")])
    assert {(r.id, r.language, r.label) for r in raw.collect()} == {("en1", "en", 4), ("en2", "en", 0), ("ja1", "ja", 4), ("ja2", "ja", 0)}
    reviews = ingest.ingest(raw, per_star=1).collect()
    assert {(r.review_id, r.rating, r.review_text) for r in reviews if r.detected_language == "en"} == {("marc-en1", 5, "hi"), ("marc-en2", 1, "x")}


def test_dashboard_export_without_a_column_is_refused(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text("review_date,sentiment\n2026-01-01,negative\n")
    with pytest.raises(ValueError, match="lacks issue_category"):
        readers.read_dashboard_csv(spark, str(path))


def test_dashboard_export_may_have_more_columns_in_any_order(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text('id,issue_category,sentiment,review_date\n1,"Late, torn",negative,2026-01-05\n2,,positive,\n')
    rows = readers.read_dashboard_csv(spark, str(path)).collect()
    assert [(str(r.review_date), r.sentiment, r.issue_category) for r in rows] == [("2026-01-05", "negative", "Late, torn"), ("None", "positive", None)]


def test_sheet_with_a_byte_order_mark(spark, tmp_path):
    from grapevine.schemas import QUEUE_COLUMNS

    values = ["r1", "ja", "negative", "price", "良い,\n悪い", "ok", "x", "5", "4", "4", "5", "False", "False", "False", "True", "True", "y", ""]
    path = tmp_path / "sheet.csv"
    line = ",".join(f'"{v}"' for v in values)
    path.write_text(",".join(QUEUE_COLUMNS) + "\n" + line + "\n", encoding="utf-8-sig")
    row = readers.read_review_sheet(spark, str(path)).first()
    assert row.review_id == "r1" and row.review_text == "良い,\n悪い" and row.empathy == 5
    assert row.needs_human_attention is True and row.human_accept == "y"


def test_whole_file_maps_and_playbooks(spark, tmp_path):
    path = tmp_path / "books.json"
    path.write_text(json.dumps({"negative/price": "be kind", "positive/ux": "thank"}, indent=1))
    assert {(r.sentiment, r.topic, r.playbook) for r in readers.read_playbooks(spark, str(path)).collect()} == {
        ("negative", "price", "be kind"), ("positive", "ux", "thank"),
    }


def test_saved_examples_are_nested(spark, tmp_path):
    path = tmp_path / "examples.json"
    path.write_text(json.dumps([{"id": "1", "language": "en", "judge": {"empathy": 4, "acceptable": False}}], indent=1))
    row = readers.read_examples(spark, str(path)).first()
    assert row.judge.empathy == 4 and row.judge.acceptable is False and row.reply is None


def test_category_lookup_failing_leaves_null(spark):
    raw = spark.createDataFrame([("1", "t", 0, "en")], "id string, text string, label int, language string")
    assert ingest.ingest(raw, None).first().product_category is None


def test_empty_reviews_leave_after_sampling(spark):
    raw = spark.createDataFrame([(str(i), " ", 0, "en") for i in range(4)], "id string, text string, label int, language string")
    assert ingest.ingest(raw, per_star=2).count() == 0


def test_shared_folder_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark)
    assert folder == (named.rstrip("/") if named else folder)
    assert new_folder(spark, "a").startswith(folder)


def test_materialised_rows_do_not_run_again(spark):
    rows = spark.range(3).withColumn("x", F.rand())
    once = materialise(rows)
    assert once.collect() == once.collect()


def test_output_is_appended(spark):
    from grapevine.schemas import OUTPUT_COLUMNS

    rows = spark.range(1).select(*[F.lit("v").alias(c) for c in reversed(OUTPUT_COLUMNS)])
    path = new_folder(spark, "output")
    writers.append_output(rows, path)
    writers.append_output(rows, path)
    back = spark.read.parquet(path)
    assert back.count() == 2 and back.columns == OUTPUT_COLUMNS


def test_keyed_cache_over_many_runs(spark):
    cache = KeyedCache(spark, new_folder(spark, "keyed"), "key string, answer int", buckets=4, fan=4)
    expected = {}
    for run in range(20):
        rows = [(f"k{(run * 7 + i * i) % 40}", run * 100 + i) for i in range(3)] + [(None, -1)]
        rows = list({k: (k, v) for k, v in rows}.values())
        expected |= {k: v for k, v in rows if k is not None}
        cache.append(spark.createDataFrame(rows, "key string, answer int").coalesce(1))
    assert {r.key: r.answer for r in cache.latest().collect()} == expected
    runs = cache.runs()
    assert [(r.level, r.first, r.last) for r in runs] == [(2, 0, 15), (1, 16, 19)]  # of 20 appends
    asked = spark.createDataFrame([("k1",), ("none",), (None,)], "asked string")
    one = cache.latest(asked.where("asked = 'k1'"), "asked")
    assert {r.key: r.answer for r in one.collect()} == {"k1": expected["k1"]}
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", one._jdf.queryExecution().executedPlan().toString())
    assert sorted(str(r.asked) for r in cache.pending(asked, "asked").collect()) == ["None", "none"]


def test_keyed_cache_after_a_merge_that_did_not_end(spark, monkeypatch):
    from grapevine.sources import cache as module

    cache = KeyedCache(spark, new_folder(spark, "keyed"), "key string, answer int", buckets=2, fan=2)
    monkeypatch.setattr(module, "delete", lambda *_: None)  # dies before it removes what it merged
    for run in range(3):
        cache.append(spark.createDataFrame([("a", run), (f"b{run}", run)], "key string, answer int"))
    assert {r.key: r.answer for r in cache.latest().collect()} == {"a": 2, "b0": 0, "b1": 1, "b2": 2}
    assert [(r.level, r.first, r.last) for r in cache.runs()] == [(1, 0, 1), (0, 2, 2)]
    assert KeyedCache(spark, new_folder(spark, "keyed"), "key string, answer int").latest().count() == 0


def test_work_of_a_run_is_removed(spark):
    session = spark.newSession()
    rows = materialise(session.range(5), name="kept")
    session.range(3).write.option("path", new_folder(session, "work")).saveAsTable("work_table_of_run")
    assert exists(session, rows.inputFiles()[0]) and session.catalog.tableExists("work_table_of_run")
    remove_work(session)
    assert not exists(session, run_folder(session)) and not session.catalog.tableExists("work_table_of_run")


def test_quoted_csv_is_read_by_many_tasks_as_by_one(spark, tmp_path):
    dice = random.Random(7)
    parts = ["plain", 'say ""hi""', "two\nlines", "a,b", "\n\n", "é中", '""', " x ", "three\n\"\"quoted\"\"\nlines", "z" * 150]
    for name, end in (("a.csv", "\n"), ("b.csv", "\n"), ("c.csv", "\r\n")):
        rows = []
        for i in range(120):
            fields = [f"{name}{i}", str(i), "".join(dice.choice(parts) for _ in range(dice.randint(0, 4)))]
            rows.append(",".join([fields[0], fields[1], f'"{fields[2]}"']))
        (tmp_path / name).write_bytes((end.join(["id,n,body", *rows]) + (end if name != "b.csv" else "")).encode())
    schema = "id string, n int, body string"
    expected = spark.read.schema(schema).options(header=True, multiLine=True, escape='"').csv(str(tmp_path))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300b", "2k", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = read_quoted_csv(spark, str(tmp_path), schema)
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)
            if size == "300b":
                assert quoted_records(spark, str(tmp_path)).select("file", "cut").distinct().count() > 40
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
