import numpy as np
import pytest
from pyspark.sql import functions as F

from grapevine.operators import clustering as c
from grapevine.operators import models as m
from grapevine.operators import text_features as f
from grapevine.plans import issues
from grapevine.queries.clusters import hashed_words
from grapevine.storage import new_folder


def blobs(spark, sizes=(60, 40, 5), copies=0, dims=6, seed=1):
    """Tight groups far apart, plus exact copies of the first point of the first group."""
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for g, size in enumerate(sizes):
        centre = np.zeros(dims)
        centre[g] = 10.0
        for _ in range(size):
            rows.append((n, g, [float(v) for v in centre + rng.normal(0, 0.05, dims)]))
            n += 1
    rows += [(n + i, 0, rows[0][2]) for i in range(copies)]
    return spark.createDataFrame(rows, "id bigint, g int, v array<double>")


def test_density_finds_groups_and_noise(spark):
    rows = blobs(spark, copies=50)
    got = c.density_clusters(rows, "v", width=2.0, min_cluster_size=15, min_cell_rows=5, name="found")
    pairs = {(r.g, r.found): r["count"] for r in got.groupBy("g", "found").count().collect()}
    assert sum(pairs.values()) == 155
    labels = {g: {k for (h, k) in pairs if h == g} for g in range(3)}
    assert labels[2] == {-1}  # too small
    assert len(labels[0]) == 1 and len(labels[1]) == 1 and labels[0] != labels[1]
    assert labels[0] | labels[1] == {0, 1}


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, 500 + i) for i in range(1, 30)]
    edges = spark.createDataFrame(chain + star, "a bigint, b bigint")
    nodes = spark.createDataFrame([(n,) for n in [*range(100, 161), *range(500, 530), 9]], "node bigint")
    sizes = c.connected_components(edges, nodes).groupBy("component").count().collect()
    assert {r.component: r["count"] for r in sizes} == {100: 61, 500: 30, 9: 1}


def brute_silhouette(vectors, labels):
    gaps = np.linalg.norm(vectors[:, None] - vectors[None], axis=2) ** 2
    out = []
    for i, own in enumerate(labels):
        mine = (labels == own) & (np.arange(len(labels)) != i)
        if not mine.any():
            out.append(0.0)
            continue
        a = gaps[i, mine].mean()
        b = min(gaps[i, labels == other].mean() for other in set(labels) - {own})
        out.append((b - a) / max(a, b))
    return out


def test_exact_silhouette_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    vectors, labels = rng.normal(size=(40, 3)), np.array([0] * 20 + [1] * 19 + [2])
    rows = spark.createDataFrame([(i, [float(x) for x in v], int(k)) for i, (v, k) in enumerate(zip(vectors, labels))], "id int, v array<double>, k int")
    got = [r.silhouette for r in c.silhouette_exact(rows, "id", "v", "k").orderBy("id").collect()]
    assert got == pytest.approx(brute_silhouette(vectors, labels), abs=1e-7)


def test_kmeans_search_prefers_the_true_number_of_groups(spark):
    rows = blobs(spark, (30, 30, 30))
    best, table = c.kmeans_search(rows, "id", "v", ks=range(2, 5), restarts=3)
    assert max(table.collect(), key=lambda r: r.silhouette_squared).k == 3
    assert best.select("g", "cluster").distinct().count() == 3


def test_vectors_have_unit_length_and_zero_stays_zero(spark):
    rows = spark.createDataFrame([("a b",), ("",), (None,)], "t string")
    got = [np.linalg.norm(r.embedding) for r in c.embed_text(rows, "t", hashed_words, batch_size=2).collect()]
    assert got == pytest.approx([1, 0, 0], abs=1e-6)


def sentences(spark):
    good, bad = ["great lovely", "lovely great fine", "great fine"], ["awful broken", "broken bad awful", "bad awful"]
    rows = [(i, "en", t, k) for i, (t, k) in enumerate([(t, "positive") for t in good * 4] + [(t, "negative") for t in bad * 4])]
    rows += [(100 + i, "de", t, "neutral") for i, t in enumerate(["naja", "geht so"])]
    return spark.createDataFrame(rows, "id int, lang string, text string, label string")


def test_the_length_of_a_row_is_not_worked_out_per_term(spark):
    rows = spark.createDataFrame([(1, "en", "ab cd"), (2, "en", "ab ef")], "id int, lang string, text string")
    counted = f.char_gram_counts(rows, "text")
    weighed = f.tfidf_weights(counted, f.vocabulary(counted, "lang"), "lang")
    plan = weighed._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "sqrt(aggregate(" in plan and "/ sqrt(aggregate(" not in plan


def test_tfidf_equals_the_formula(spark):
    rows = spark.createDataFrame([(1, "en", "Ab ab"), (2, "en", "b"), (3, "en", " ")], "id int, lang string, text string")
    counted = f.char_gram_counts(rows, "text")
    terms = f.vocabulary(counted, "lang", min_rows=1)
    table = {r.gram: (r.df, r.total, r.idf) for r in terms.collect()}
    assert set(table) == {" ", "a", "b", " a", "ab", "b ", " b", " ab", "ab ", " b "}
    assert table[" "][:2] == (2, 6) and table["b "][:2] == (2, 3)
    assert table["a"][2] == pytest.approx(np.log(4 / 2) + 1)
    got = {r.id: r.tfidf for r in f.tfidf_weights(counted, terms, "lang").collect()}
    names = sorted(table)
    counts = {" ": 4, "a": 2, "b": 2, " a": 2, "ab": 2, "b ": 2, " ab": 2, "ab ": 2}
    raw = np.array([(1 + np.log(counts[g])) * table[g][2] for g in names if g in counts])
    assert [names[i] for i in got[1].indices] == [g for g in names if g in counts]
    assert got[1].weights == pytest.approx(raw / np.linalg.norm(raw))
    assert got[3].indices == []
    assert {r.gram for r in f.vocabulary(counted, "lang", min_rows=2, max_terms=2).collect()} == {" ", "b"}


def test_language_models_route_and_leave_unseen_classes_null(spark):
    rows = sentences(spark)
    fitted, terms = m.train_by_language(rows, "lang", "text", "label", ["en", "de"])
    assert set(fitted) == {"en"}  # one class cannot be learned
    got = {r.id: r for r in m.predict_by_language(fitted, terms, rows, "lang", "text").collect()}
    assert all(got[i].predicted == ("positive" if i < 12 else "negative") for i in range(24))
    assert got[0].p_neutral is None and got[0].p_positive + got[0].p_negative == pytest.approx(1)
    assert got[100].predicted is None and len(got) == 26


def test_languages_fitted_together_equal_each_alone(spark):
    words = {"en": ("good fine nice well", "bad poor awful broken"), "de": ("gut schön prima toll", "schlecht übel kaputt mies")}
    rows = []
    for lang, (good, bad) in words.items():
        for i in range(40):
            mine, label = ((good, "positive"), (bad, "negative"))[(i + (i % 7 == 0)) % 2]
            rows.append((len(rows), lang, " ".join((mine.split() * 2)[i % 4:i % 4 + 3]) + f" {i % 5}", label))
    table = spark.createDataFrame(rows, "id int, lang string, text string, label string")

    def chances(languages):
        fitted, terms = m.train_by_language(table.where(F.col("lang").isin(languages)), "lang", "text", "label", languages)
        assert len({id(model) for model in fitted.values()}) == 1
        return {r.id: r.p_positive for r in m.predict_by_language(fitted, terms, table, "lang", "text").collect() if r.p_positive is not None}

    together, alone = chances(["en", "de"]), chances(["en"]) | chances(["de"])
    assert set(together) == set(alone) == set(range(80))
    assert max(abs(together[i] - alone[i]) for i in alone) < 0.02


def test_stacker_picks_the_first_of_the_best(spark):
    rows = spark.range(90).select(
        F.col("id").alias("review_id"), F.get(F.array(*map(F.lit, ("negative", "neutral", "positive"))), (F.col("id") % 3).cast("int")).alias("label"),
    )
    rows = rows.withColumns({"pred": F.col("label"), "conf": F.lit(0.9) + F.col("review_id") % 2 / 10, "stars_pred": 1.0 + 2 * (F.col("review_id") % 3)})
    rows = rows.withColumns({f"p_{k}": F.rand(1) for k in ("negative", "neutral", "positive")})
    got = m.stack_select(rows.where("review_id < 60"), rows.where("review_id >= 60"), "review_id", folds=3).collect()
    assert len(got) == 8 and {r.model for r in got if r.selected} == {"stacker"}
    assert all(r.accuracy == 1.0 for r in got if r.model == "stacker")


def test_issue_clustering_reuses_stored_vectors(spark):
    rows = sentences(spark).where("lang = 'en'").select(
        F.col("id").cast("string").alias("review_id"), "text", F.lit("quality").alias("topic"), F.col("lang").alias("detected_language")
    )
    store = new_folder(spark, "vectors")
    first = issues.cluster_issues(rows, "text", hashed_words, store, ks=(2, 3), restarts=2, pca_dims=4, min_cluster_size=3)

    def never(texts):
        raise AssertionError("stored vectors must be used")

    again = issues.cluster_issues(rows, "text", never, store, ks=(2, 3), restarts=2, pca_dims=4, min_cluster_size=3)
    assert sorted(r["size"] for r in first["summary"].collect()) == sorted(r["size"] for r in again["summary"].collect())
    assert first["noise"].first().n_clusters >= 1


def test_coreset_costs_stand_for_those_of_all_rows(spark):
    dice = np.random.default_rng(2)
    points = np.vstack([dice.normal(c, 1.0, (1500, 6)) for c in (0.0, 4.0, 9.0, 30.0)])
    rows = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, v array<double>")
    taken = c.coreset(rows, "id", "v", 800, seed=3).toPandas()
    assert 500 < len(taken) < 1100
    sample, weights = np.array(taken["vector"].tolist()), taken["weight"].to_numpy()
    assert weights.sum() == pytest.approx(len(points), rel=0.15)
    for k in (3, 4, 6):
        small, cost = c.weighted_kmeans(sample, weights, k, seed=1)
        full = min(c.weighted_kmeans(points, np.ones(len(points)), k, seed=s)[1] for s in range(5))
        everywhere = c.squared_distances(points, small).min(axis=1).sum()
        assert cost == pytest.approx(everywhere, rel=0.15)
        best = min(c.squared_distances(points, c.weighted_kmeans(sample, weights, k, seed=s)[0]).min(axis=1).sum() for s in range(5))
        assert best <= 1.1 * full
    whole = c.coreset(rows.limit(300), "id", "v", 800).toPandas()
    assert len(whole) == 300 and (whole["weight"] == 1).all()


def test_search_measures_all_rows(spark):
    dice = np.random.default_rng(4)
    points = np.vstack([dice.normal(x, 1.0, (120, 3)) for x in (0.0, 8.0, 20.0)])
    rows = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(-1, None)], "id long, v array<double>")
    found, table = c.kmeans_search(rows, "id", "v", ks=range(2, 5), restarts=4, coreset_rows=150)
    labels = {r.id: r.cluster for r in found.collect()}
    assert labels.pop(-1) is None and len(labels) == 360 and len({labels[i] for i in range(120)}) == 1
    scores = {r.k: r for r in table.collect()}
    best = found.where("id >= 0").withColumn("c", F.col("cluster"))
    assert scores[3].silhouette_squared == round(c.silhouette_squared(best, "v", "c"), 4) == max(r.silhouette_squared for r in scores.values())
    assert c.kmeans_search(rows.limit(0), "id", "v")[1].count() == 0


def test_a_stacker_fit_has_a_task_per_core(spark, monkeypatch):
    rows = spark.range(96).select(
        F.col("id").cast("string").alias("review_id"), F.element_at(F.array(*map(F.lit, ["negative", "positive"])), (F.col("id") % 2 + 1).cast("int")).alias("label"),
        F.lit("negative").alias("pred"), F.lit(0.5).alias("conf"), (F.col("id") % 5).cast("double").alias("stars_pred"),
        *[F.lit(0.3).alias(f"p_{k}") for k in ("negative", "neutral", "positive")]).repartition(40)
    seen, predict = [], m._predict
    monkeypatch.setattr(m, "_predict", lambda model, data, classes: seen.append(data.rdd.getNumPartitions()) or predict(model, data, classes))
    m.stack_select(rows, rows, "review_id", folds=2)
    assert seen and max(seen) <= spark.sparkContext.defaultParallelism


def test_predictions_are_sums_over_terms_and_equal_the_model(spark):
    rows = sentences(spark)
    fitted, terms = m.train_by_language(rows, "lang", "text", "label", ["en", "de"])
    odd = spark.createDataFrame([(900, "en", None, None), (901, "en", "zzz", None), (902, None, "great", None), (902, "en", "Great  AWFUL", None)], rows.schema)
    table = rows.unionByName(odd)
    predicted = m.predict_by_language(fitted, terms, table, "lang", "text")
    plan = predicted._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "sum(" in plan  # terms do not come together by row
    model = fitted["en"]
    english = table.where("lang = 'en'").withColumn("text", F.coalesce("text", F.lit("")))
    weighed = f.tfidf_weights(f.char_gram_counts(english, "text", spelled=False), terms, "lang")
    scored = model.model.transform(m._in_blocks(weighed, "lang", model.offsets, m._ends(model), model.size))
    expected = {r.id: (model.classes[int(r.prediction)], r.probability.toArray()) for r in scored.collect()}
    got = {r.id: r for r in predicted.where("lang = 'en'").collect()}
    assert set(got) == set(expected) and predicted.count() == table.count()
    for i, (name, chances) in expected.items():
        assert got[i].predicted == name and [got[i][f"p_{k}"] for k in model.classes] == pytest.approx(list(chances), abs=1e-12)


def test_pieces_counted_at_once_equal_those_word_by_word():
    texts = [None, "", " ", "a", "a\x00b c", "日本 語　x", "😀 é ß İ ſ", "ab  ab\n\tAB", "\x1cq\x1fr\u0085s\xa0t", "no " * 40, ""]
    for longest in (1, 2, 3):
        once, words = f._counted(texts, longest).to_pylist(), f._counted_words(texts, longest).to_pylist()
        for a, b in zip(once, words, strict=True):
            assert dict(zip(a["gram"], a["tf"], strict=True)) == dict(zip(b["gram"], b["tf"], strict=True)) and len(a["gram"]) == len(b["gram"])
        numbers = f._counted(texts, longest, spelled=False).to_pylist()
        assert all(sorted(a["gram"]) == a["gram"] for a in once)  # code points
        assert all(sorted(a["gram"]) == a["gram"] and a["tf"] == b["tf"] for a, b in zip(numbers, once, strict=True))
