import pytest

from grapevine.operators import aggregates as a
from grapevine.operators import joins as j
from grapevine.operators import reviews as r

SOURCE = "ordinal bigint, review_id string, product_id string, product_category string, stars int, review_title string, review_body string"


def sample(spark, *rows):
    return spark.createDataFrame(list(rows), "review_id string, rating int, review_text string, source string")


def test_enrichment_takes_the_first_copy(spark):
    source = spark.createDataFrame([(2, "1", "late", "late", 5, "t", "b"), (1, "1", "p", "toy", 3, " t", "b ")], SOURCE)
    got = j.verified_enrich(sample(spark, ("marc-1", 3, "t\n\nb", "marc")), source, "marc-").first()
    assert (got.product_id, got.product_category, got.source) == ("p", "toy", "kaggle-marc")


@pytest.mark.parametrize(
    ("row", "message"),
    [(("marc-2", 3, "t\n\nb", "marc"), "not found"), (("marc-1", 4, "t\n\nb", "marc"), "star rating"), (("marc-1", 3, "t", "marc"), "review text")],
)
def test_a_mismatch_stops_the_write(spark, tmp_path, row, message):
    source = spark.createDataFrame([(1, "1", "p", "toy", 3, "t", "b")], SOURCE)
    good = ("marc-1", 3, "t\n\nb", "marc")
    path = str(tmp_path / "out")
    with pytest.raises(Exception, match=message):
        j.verified_enrich(sample(spark, good, row), source, "marc-").select("review_id").write.parquet(path)
    assert not list((tmp_path / "out").glob("*.parquet"))


def test_last_category_of_an_id_counts_and_blank_is_null(spark):
    lookup = spark.createDataFrame([(1, "a", "x"), (2, "a", " y "), (1, "b", " ")], "ordinal bigint, id string, product_category string")
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    got = {row.id: row.product_category for row in j.category_lookup(rows.withColumnRenamed("id", "rid"), lookup, "rid").withColumnRenamed("rid", "id").collect()}
    assert got == {"a": "y", "b": None, "c": None}


def test_a_literal_table_has_a_bound(spark):
    with pytest.raises(ValueError):
        j.literal_table(spark, [(i,) for i in range(j.LITERAL_ROWS + 1)], "i int")


def test_keyword_picks_follow_label_order(spark):
    labels = spark.createDataFrame([(0, 7, "Late, DELAYED"), (1, 3, "delayed again"), (2, 5, "overpriced"), (3, 4, "Torn box")], "ordinal int, cluster int, label string")
    sizes = spark.createDataFrame([(7, 1), (3, 9), (5, 9), (4, 2)], "cluster int, size int")
    assert {row.cluster for row in j.pick_by_keyword(labels, ["Delayed", "torn", "Overpriced"], sizes).collect()} == {7, 4, 5}
    assert {row.cluster for row in j.pick_by_keyword(labels, ["Delayed", "nothing", "Overpriced"], sizes).collect()} == {3, 5, 4}


def test_report_without_neutral_rows_and_with_an_unseen_label(spark):
    rows = spark.createDataFrame(
        [("en", "positive", "positive"), ("en", "negative", "neutral"), ("de", "neutral", "neutral"), ("xx", "neutral", "positive")],
        "detected_language string, label string, pred string",
    )
    got = {row.lang: row for row in a.classification_report(rows, languages=["en", "de", "fr"]).collect()}
    assert set(got) == {"en", "de", "ALL"} and got["ALL"].n == 4
    assert got["en"].accuracy == 0.5 and got["en"].macro_f1 == 0.333 and got["en"].binary_accuracy == 0.5
    assert got["de"].binary_accuracy is None


def test_nothing_reviewed_is_an_error(spark):
    sheet = spark.createDataFrame([("positive", "en", "", True)], "sentiment string, detected_language string, human_accept string, acceptable boolean")
    with pytest.raises(Exception, match="no rows have human_accept"):
        a.human_acceptance(sheet).collect()


def test_empty_ledger_costs_nothing(spark):
    empty = spark.createDataFrame([], "cost_usd double")
    assert a.spend_total(empty).first().spent_usd == 0
    assert a.spend_total(spark.createDataFrame([(None,), (0.5,)], "cost_usd double")).first().spent_usd == 0.5


def test_topic_ties_take_the_smallest_name(spark):
    rows = spark.createDataFrame([(1, "ux", "en"), (1, "price", "de"), (2, "ux", "en")], "c int, topic string, lang string")
    got = a.cluster_summary(rows, "c", "topic", "lang").collect()
    assert [(row.cluster, row.size, row.dominant_topic, row.topic_purity) for row in got] == [(1, 2, "price", 0.5), (2, 1, "ux", 1.0)]
    assert got[0].languages == {"en": 1, "de": 1}


def test_null_language_is_not_english(spark):
    rows = spark.createDataFrame([("en",), ("EN",), (None,)], "detected_language string")
    english, others = r.split_by_language(rows)
    assert english.count() == 1 and others.count() == 2


def test_dropped_predictions_are_counted(spark):
    from pyspark.sql import Observation

    watch = Observation()
    rows = spark.createDataFrame([(1, None), (2, "x")], "id int, pred string")
    assert r.drop_missing_predictions(rows, "pred", watch).count() == 1
    assert watch.get["missing"] == 1


def test_output_has_seventeen_columns():
    from grapevine.schemas import OUTPUT_COLUMNS, QUEUE_COLUMNS

    assert len(OUTPUT_COLUMNS) == 17 and len(QUEUE_COLUMNS) == 18
