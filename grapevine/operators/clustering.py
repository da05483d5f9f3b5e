"""Embeddings, k-means search, density clusters and cluster examples."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import EXAMPLE_CHARS, NO_CATEGORY
from ..functions.text import truncate_text
from ..storage import cut_lineage, in_slices, spread
from .positions import HASH_SHIFT, first_n, seeded_hash, with_position

Encoder = Callable[[list[str]], np.ndarray]
CORESET_ROWS = 20_000  # rows that stand for all in the runs of a k-means search


def l2_normalised(vector: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays as it is."""
    squares = F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    norm = F.when(squares > 0, F.sqrt(squares)).otherwise(F.lit(1.0))
    return F.transform(vector, lambda x: (x / norm).cast("float"))


def embed_text(
    rows: DataFrame, text: str, encoder: Encoder, batch_size: int = 64, name: str = "embedding"
) -> DataFrame:
    """Add a normalised sentence vector. ``encoder`` maps a list of texts to a matrix, ``batch_size`` texts at a time."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in in_slices(batches, batch_size):
            yield pd.Series(list(np.asarray(encoder([t or "" for t in texts]), dtype=np.float32)))

    return spread(rows).withColumn("_raw", encode(F.col(text))).withColumn(name, l2_normalised(F.col("_raw"))).drop("_raw")


def coreset(rows: DataFrame, id_column: str, embedding: str, size: int, seed: int = 0) -> DataFrame:
    """(vector, weight): about ``size`` rows that stand for all in k-means costs; all of them, with weight 1, for up to half as many.

    A row is taken with a probability that is half its share of the rows and half its share of the squared distances from the mean, and
    weighs the inverse (a lightweight coreset). One pass gives the mean and the distances, a second takes the rows, by a hash of their id.
    """
    points = rows.where(F.col(embedding).isNotNull()).select(F.col(id_column).alias("_id"), F.col(embedding).cast("array<double>").alias("vector"))
    if points.isEmpty():
        return points.select("vector", F.lit(1.0).alias("weight"))
    found = points.select(Summarizer.metrics("count", "mean", "variance").summary(array_to_vector("vector")).alias("s")).select("s.*").first()
    n = found["count"]
    total = float(sum(found["variance"])) * (n - 1)
    squared = F.aggregate(F.zip_with("vector", F.lit([float(x) for x in found["mean"]]), lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda t, x: t + x)
    share = F.lit(0.5 / n) + (0.5 * squared / total if total > 0 else F.lit(0.5 / n))
    chance = F.least(F.lit(1.0), size * share)
    draw = seeded_hash(F.col("_id"), seed) / float(1 << 60)
    return points.withColumn("_chance", chance).where(draw < F.col("_chance")).select("vector", (1 / F.col("_chance")).alias("weight"))


def squared_distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points * points).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * points @ centres.T, 0.0)


def weighted_kmeans(points: np.ndarray, weights: np.ndarray, k: int, seed: int, iterations: int = 20, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """(centres, cost) of one run: spread-out starts, then Lloyd's steps until no centre moves by more than ``tolerance``."""
    dice = np.random.default_rng(seed)
    centres = points[dice.choice(len(points), p=weights / weights.sum())][None]
    near = squared_distances(points, centres)[:, 0]
    while len(centres) < min(k, len(points)):
        pull = weights * near
        total = pull.sum()
        if total <= 0:  # fewer distinct points than centres
            break
        centres = np.vstack([centres, points[dice.choice(len(points), p=pull / total)]])
        near = np.minimum(near, squared_distances(points, centres[-1:])[:, 0])
    for _ in range(iterations):
        label = squared_distances(points, centres).argmin(axis=1)
        mass = np.bincount(label, weights, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, label, points * weights[:, None])
        moved = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], centres)
        shift, centres = np.sqrt(((moved - centres) ** 2).sum(axis=1).max()), moved
        if shift <= tolerance:
            break
    return centres, float((weights * squared_distances(points, centres).min(axis=1)).sum())


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), -1)


def _fits(spark: SparkSession, points: np.ndarray, weights: np.ndarray, ks: Sequence[int], restarts: int, seed: int) -> dict[int, np.ndarray]:
    """Per k the centres of the run of least cost, the earlier run of equal ones. Each run is a task."""
    shared = spark.sparkContext.broadcast((points, weights))  # the coreset

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, turn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                centres, cost = weighted_kmeans(*shared.value, k, seed + turn)
                yield pa.RecordBatch.from_pydict({"k": [k], "turn": [turn], "cost": [cost], "centres": [centres.tolist()]})

    jobs = spark.createDataFrame([(k, r) for k in ks for r in range(restarts)], "k bigint, turn bigint").repartition(len(ks) * restarts, "k", "turn")
    runs = jobs.mapInArrow(run, "k bigint, turn bigint, cost double, centres array<array<double>>")
    best = runs.groupBy("k").agg(F.min_by("centres", F.struct("cost", "turn")).alias("centres")).collect()
    shared.destroy()
    return {r.k: np.array(r.centres) for r in best}


def _scores(rows: DataFrame, embedding: str, centres: dict[int, np.ndarray]) -> dict[int, tuple[float, float]]:
    """(mean silhouette on squared distances, cost) of each clustering over all rows, exact, in two passes for all of them."""
    spark = rows.sparkSession
    points = rows.where(F.col(embedding).isNotNull()).select(F.col(embedding).cast("array<double>").alias("v"))
    shared = spark.sparkContext.broadcast(centres)  # a few vectors per clustering

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros((len(c), c.shape[1] + 3)) for k, c in shared.value.items()}
        for batch in batches:
            if not len(batch):
                continue
            v = _matrix(batch.column(0))
            row = np.column_stack([np.ones(len(v)), (v * v).sum(axis=1), v])
            for k, c in shared.value.items():
                distance = squared_distances(v, c)
                label = distance.argmin(axis=1)
                np.add.at(totals[k], label, np.column_stack([row, distance.min(axis=1)]))
        cells = [(k, i, t.tolist()) for k, own in totals.items() for i, t in enumerate(own)]
        yield pa.RecordBatch.from_pydict({"k": [c[0] for c in cells], "i": [c[1] for c in cells], "t": [c[2] for c in cells]})

    parts = points.mapInArrow(summed, "k bigint, i bigint, t array<double>")
    cells = parts.select("k", "i", F.posexplode("t").alias("at", "x")).groupBy("k", "i", "at").agg(F.sum("x").alias("x")).collect()
    stats = {k: np.zeros((len(c), c.shape[1] + 3)) for k, c in centres.items()}
    for r in cells:
        stats[r.k][r.i, r["at"]] = r.x
    measured = spark.sparkContext.broadcast(stats)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = dict.fromkeys(shared.value, 0.0)
        for batch in batches:
            if not len(batch):
                continue
            v = _matrix(batch.column(0))
            for k, c in shared.value.items():
                n, q, s = measured.value[k][:, 0], measured.value[k][:, 1], measured.value[k][:, 2:-1]
                label, each = squared_distances(v, c).argmin(axis=1), np.arange(len(v))
                mean = (v * v).sum(axis=1)[:, None] + q / np.maximum(n, 1) - 2 * v @ (s / np.maximum(n, 1)[:, None]).T
                own = mean[each, label] * n[label] / np.maximum(n[label] - 1, 1)
                mean[each, label], mean[:, n == 0] = np.inf, np.inf
                other = mean.min(axis=1)
                top = np.maximum(own, other)
                value = np.where((n[label] > 1) & np.isfinite(other) & (top > 0), (other - own) / np.where(top > 0, top, 1), 0.0)
                totals[k] += float(value.sum())
        yield pa.RecordBatch.from_pydict({"k": list(totals), "total": list(totals.values())})

    sums = dict(points.mapInArrow(compared, "k bigint, total double").groupBy("k").agg(F.sum("total")).collect())
    shared.destroy()
    measured.destroy()
    return {k: (float(sums.get(k, 0.0) / max(stats[k][:, 0].sum(), 1)), float(stats[k][:, -1].sum())) for k in centres}


def kmeans_search(
    rows: DataFrame,
    id_column: str,
    embedding: str,
    ks: Sequence[int] = range(6, 15),
    restarts: int = 10,
    seed: int = 0,
    coreset_rows: int = CORESET_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(rows with the best clustering, table of k and score).

    All runs of all k are fitted on one coreset of about ``coreset_rows`` rows, a task each; tables of up to half as many rows are
    their own coreset. Per k the run of least cost counts; its cost and silhouette are then measured on all rows, in two passes for all
    k together. The k with the highest silhouette wins and ties keep the smaller k. The score is the silhouette on squared
    distances, linear in the rows, and is named so. Rows without a vector have no cluster.
    """
    spark = rows.sparkSession
    sample = coreset(rows, id_column, embedding, coreset_rows, seed).toPandas()  # bounded by coreset_rows
    schema = "k int, silhouette_squared double, training_cost double"
    if sample.empty:
        return rows.withColumn("cluster", F.lit(None).cast("int")), spark.createDataFrame([], schema)
    points = np.array(sample["vector"].tolist(), dtype=np.float64)
    centres = _fits(spark, points, sample["weight"].to_numpy(), ks, restarts, seed)
    scores = _scores(rows, embedding, centres)
    chosen = centres[max(ks, key=lambda k: (scores[k][0], -k))]

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        known = vectors.notna()
        out = pd.Series([None] * len(vectors), dtype="Int32")
        if known.any():
            out[known] = squared_distances(np.array(vectors[known].tolist(), dtype=np.float64), chosen).argmin(axis=1)
        return out

    table = spark.createDataFrame([(k, round(scores[k][0], 4), scores[k][1]) for k in ks], schema)
    return rows.withColumn("cluster", nearest(F.col(embedding).cast("array<double>"))), table


def silhouette_squared(rows: DataFrame, embedding: str, cluster: str) -> float:
    """Mean silhouette on squared Euclidean distances: exact for that distance and linear in the rows."""
    data = rows.select(
        array_to_vector(F.col(embedding).cast("array<double>")).alias("features"),
        F.col(cluster).cast("double").alias("prediction"),
    )
    return ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(data)


def silhouette_exact(rows: DataFrame, id_column: str, embedding: str, cluster: str) -> DataFrame:
    """Silhouette per row on squared Euclidean distances: (id, cluster, silhouette); 0 for a cluster of one row.

    The mean squared distance to a cluster follows from its size, its sum and its sum of squares, so one pass counts these per
    cluster and a second compares each row with each cluster. The clusters, a few numbers each, are put in the plan.
    """
    vector = F.col(embedding).cast("array<double>")
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x)
    each = rows.select(F.col(cluster).alias("k"), F.posexplode(vector).alias("at", "x"))
    sums = each.groupBy("k", "at").agg(F.sum("x").alias("x")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("s"))
    sizes = rows.groupBy(F.col(cluster).alias("k")).agg(F.count("*").alias("n"), F.sum(square(vector)).alias("q"))
    found = sizes.join(sums, "k").select("k", "n", "q", F.col("s.x").alias("s")).collect()
    clusters = F.array(*[
        F.struct(F.lit(r.k).alias("k"), F.lit(float(r.n)).alias("n"), F.lit(r.q).alias("q"), F.lit(r.s).alias("s")) for r in found
    ])

    def gap(c: Column) -> Column:
        both = F.aggregate(F.zip_with(F.col("_v"), c["s"], lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
        return (F.col("_q") + c["q"] / c["n"] - 2 * both / c["n"]) * F.when(c["k"] == F.col("_k"), F.try_divide(c["n"], c["n"] - 1)).otherwise(1.0)

    placed = rows.select(F.col(id_column).alias("id"), F.col(cluster).alias("_k"), vector.alias("_v"), square(vector).alias("_q"))
    own = F.array_max(F.transform(F.filter(clusters, lambda c: c["k"] == F.col("_k")), gap))
    other = F.array_min(F.transform(F.filter(clusters, lambda c: c["k"] != F.col("_k")), gap))
    value = F.try_divide(F.col("outer") - F.col("inner"), F.greatest("inner", "outer"))
    scored = placed.select("id", F.col("_k").alias("cluster"), own.alias("inner"), other.alias("outer"))
    return scored.select("id", "cluster", F.when(F.col("inner").isNotNull(), F.coalesce(value, F.lit(0.0))).otherwise(0.0).alias("silhouette"))


def pca_reduce(rows: DataFrame, embedding: str, k: int = 20, name: str = "reduced") -> DataFrame:
    """The first ``k`` principal components of the vectors, less their mean."""
    data = rows.withColumn("_vector", array_to_vector(F.col(embedding).cast("array<double>")))
    centre = StandardScaler(withMean=True, withStd=False, inputCol="_vector", outputCol="_features").fit(data)
    centred = centre.transform(data)
    model = PCA(k=k, inputCol="_features", outputCol="_reduced").fit(centred)
    return model.transform(centred).withColumn(name, vector_to_array("_reduced")).drop("_vector", "_features", "_reduced")


def _cells(vector: str, width: float, tables: int, cuts: int, seed: int) -> Column:
    """Per table one cell id: ``cuts`` random directions, each cut into steps of ``width``."""

    @F.pandas_udf("array<bigint>")
    def assign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            if vectors.empty:
                yield pd.Series([], dtype=object)
                continue
            data = np.asarray(vectors.to_list(), dtype=np.float64)
            rng = np.random.default_rng(seed)
            directions = rng.normal(size=(data.shape[1], tables * cuts))
            directions /= np.linalg.norm(directions, axis=0)
            offsets = rng.uniform(0, width, size=tables * cuts)
            steps = np.floor((data @ directions + offsets) / width).astype(np.int64)
            ids = np.zeros((len(data), tables), dtype=np.uint64)
            for t in range(tables):
                key = np.full(len(data), t + 1, dtype=np.uint64)
                for s in steps[:, t * cuts : (t + 1) * cuts].T:
                    key = (key ^ s.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                ids[:, t] = key
            yield pd.Series(list(ids.view(np.int64)))

    return assign(F.col(vector))


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each connected part. ``edges`` has (a, b), ``nodes`` has (node).

    Every round takes the smallest label among the neighbours and then follows labels one step further, so long
    chains shrink fast. The label table is written to the checkpoint folder each round.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut_lineage(nodes.select("node", F.col("node").alias("component")).distinct())
    while True:
        seen = both.join(labels, both["a"] == labels["node"]).groupBy("b").agg(F.min("component").alias("near"))
        lower = labels.join(seen, labels["node"] == seen["b"], "left").select(
            "node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("step")
        )
        targets = lower.select(F.col("node").alias("_at"), F.col("step").alias("_next"))
        moved = cut_lineage(
            lower.join(targets, F.col("step") == F.col("_at"), "left").select(
                "node", "old", F.least("step", F.coalesce("_next", "step")).alias("component")
            )
        )
        labels = moved.select("node", "component")
        if moved.where(F.col("component") != F.col("old")).isEmpty():
            return labels


def density_clusters(
    rows: DataFrame,
    vector: str,
    width: float,
    min_cluster_size: int = 15,
    min_cell_rows: int = 5,
    tables: int = 6,
    cuts: int = 4,
    seed: int = 0,
    name: str = "cluster",
) -> DataFrame:
    """Density labels from 0, with -1 for noise.

    This is not a hierarchical density method but a linear one: several random grids cut the space into cells, a
    cell with ``min_cell_rows`` rows is dense, dense cells that share a row are linked, and linked cells form a cluster
    if they hold ``min_cluster_size`` rows. No pair of rows is ever built; rows with the same cells, copies
    above all, are counted as one entry from the first step on.
    """
    placed = cut_lineage(rows.withColumn("_cells", _cells(vector, width, tables, cuts, seed)))
    entries = placed.groupBy("_cells").agg(F.count("*").alias("n")).withColumn("entry", F.xxhash64("_cells"))
    entries = cut_lineage(entries)
    spread = entries.select("entry", "n", F.explode("_cells").alias("cell"))
    dense = spread.groupBy("cell").agg(F.sum("n").alias("rows")).where(F.col("rows") >= min_cell_rows).select("cell")
    inside = cut_lineage(spread.join(dense, "cell"))
    anchors = inside.groupBy("entry").agg(F.min("cell").alias("anchor"), F.first("n").alias("n"))
    edges = inside.join(anchors.select("entry", "anchor"), "entry").select(
        F.col("anchor").alias("a"), F.col("cell").alias("b")
    )
    parts = connected_components(edges.where(F.col("a") != F.col("b")).distinct(), dense.withColumnRenamed("cell", "node"))
    owned = anchors.join(parts, anchors["anchor"] == parts["node"]).select("entry", "n", "component")
    large = owned.groupBy("component").agg(F.sum("n").alias("rows")).where(F.col("rows") >= min_cluster_size)
    numbered = with_position(large, seeded_hash(F.col("component"), seed), name=name, shift=HASH_SHIFT)
    labels = owned.join(numbered, "component").select("entry", F.col(name).cast("int").alias(name))
    return (
        placed.withColumn("entry", F.xxhash64("_cells"))
        .join(labels, "entry", "left")
        .withColumn(name, F.coalesce(name, F.lit(NO_CATEGORY)))
        .drop("_cells", "entry")
    )


def cluster_examples(
    rows: DataFrame, cluster: str, id_column: str, text: str, n: int = 8, length: int = EXAMPLE_CHARS, seed: int = 0
) -> DataFrame:
    """Per cluster its id, size and up to ``n`` texts, shortened."""
    sizes = rows.groupBy(cluster).agg(F.count("*").alias("size"))
    short = rows.select(cluster, id_column, truncate_text(F.col(text), length).alias("_text"))
    order = seeded_hash(F.col(id_column), seed)
    picked = first_n(short, [cluster], [order, F.col(id_column)], n)
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("_text")))), lambda t: t["_text"])
    grouped = picked.groupBy(cluster).agg(texts.alias("examples"))
    return sizes.join(grouped, cluster).select(F.col(cluster).alias("id"), "size", "examples")
