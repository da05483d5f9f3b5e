"""Naive Bayes support vectors: a linear classifier of text quality.

Features say whether an n-gram occurs in a text: words, pairs of words, word shapes and triples of them, hashed to ``2**BITS`` columns. Each
indicator is scaled by its log-count ratio between the classes, and a linear model with hinge loss is fitted by dual
coordinate descent. Scores are the margins through a logistic curve fitted on cross-validated margins of the same rows.

The fit takes a bounded sample of labelled rows (``max_rows``, chosen by the hash of the key); scoring runs on every row. Null and empty texts have no feature and get the score of the intercept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .textarrays import Chunk, Words, chunks, mix, windows, words_of

BITS = 18
MAX_ROWS = 8_000
MIN_ROWS, FOLDS = 3, 5
# 0 upper case, 1 lower case, 2 digit, 3 other letters' bytes, otherwise the byte itself
KINDS = np.arange(256, dtype=np.uint64)
KINDS[ord("A"):ord("Z") + 1] = 0
KINDS[ord("a"):ord("z") + 1] = 1
KINDS[ord("0"):ord("9") + 1] = 2
KINDS[128:] = 3


def columns_of(chunk: Chunk, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct feature columns text by text, each text's range in them)."""
    words = words_of(chunk)
    lengths = np.diff(words.offsets)
    owner = np.repeat(np.arange(len(chunk)), lengths)
    pairs, inside = windows(words, 2)
    # the shape of a word: its last two bytes, the kind of its first, and whether it repeats the word before it
    tail = np.maximum(words.ends - 2, words.starts)
    again = np.zeros(len(owner), dtype=np.uint64)
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    kind = KINDS[chunk.data]
    coarse = kind[words.starts] << np.uint64(24) | kind[tail] << np.uint64(16) | kind[words.ends - 1] << np.uint64(8) | again
    fine = coarse << np.uint64(16) | chunk.data[tail].astype(np.uint64) << np.uint64(8) | chunk.data[words.ends - 1]
    fine, coarse = mix(fine | np.uint64(1 << 60)), mix(coarse | np.uint64(2 << 60))
    triples, whole = windows(Words(words.starts, words.ends, coarse, words.offsets), 3)
    values = np.concatenate([words.hashes, pairs[inside], fine, triples[whole]])
    owners = np.concatenate([owner, owner[inside], owner, owner[whole]])
    column = (values >> np.uint64(64 - bits)).astype(np.int64)
    both = np.unique(owners.astype(np.int64) << bits | column)
    return both & ((1 << bits) - 1), np.searchsorted(both >> bits, np.arange(len(chunk) + 1))


def log_count_ratio(columns: np.ndarray, offsets: np.ndarray, good: np.ndarray, width: int, alpha: float = 1.0) -> np.ndarray:
    """log of (smoothed share of the column in class 1) over (the same in class 0); 0 for columns of under ``MIN_ROWS`` rows."""
    owner = np.repeat(good, np.diff(offsets))
    p = alpha + np.bincount(columns[owner], minlength=width)
    q = alpha + np.bincount(columns[~owner], minlength=width)
    return np.where(p + q - 2 * alpha >= MIN_ROWS, np.log((p / p.sum()) / (q / q.sum())), 0.0)


def dual_coordinate_descent(columns, offsets, scale, sign, cost: float = 0.3, rounds: int = 20, seed: int = 7):
    """Weights and intercept of the L1-loss linear machine on rows of unit length."""
    n = len(sign)
    weights, intercept, alpha = np.zeros(len(scale)), 0.0, np.zeros(n)
    values = scale.astype(np.float32)[columns]
    square = np.add.reduceat(np.append(values * values, 0.0), np.minimum(offsets[:-1], len(values))) * (np.diff(offsets) > 0)
    values /= np.repeat(np.sqrt(np.maximum(square, 1e-12)), np.diff(offsets)).astype(np.float32)
    norm = 1.0 + (square > 0)  # with the intercept as one more feature
    dice = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in dice.permutation(n):
            part = slice(offsets[i], offsets[i + 1])
            own, v = columns[part], values[part]
            slope = sign[i] * (weights[own] @ v + intercept) - 1.0
            now = min(max(alpha[i] - slope / norm[i], 0.0), cost)
            step = (now - alpha[i]) * sign[i]
            if step:
                weights[own] += step * v
                intercept += step
                alpha[i] = now
                moved = max(moved, abs(step))
        if moved < 1e-3 * cost:
            break
    return weights, intercept


def margins(columns, offsets, scale, weights, intercept) -> np.ndarray:
    values = scale[columns]
    starts = np.minimum(offsets[:-1], len(values))
    some = np.diff(offsets) > 0
    total = np.add.reduceat(np.append(weights[columns] * values, 0.0), starts) * some
    square = np.add.reduceat(np.append(values * values, 0.0), starts) * some
    return total / np.sqrt(np.maximum(square, 1e-12)) + intercept


def logistic_curve(margin: np.ndarray, good: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, offset) of the most likely logistic curve, with targets held off 0 and 1, by Newton steps."""
    ones, zeros = good.sum(), (~good).sum()
    target = np.where(good, (ones + 1.0) / (ones + 2.0), 1.0 / (zeros + 2.0))
    x = np.stack([margin, np.ones_like(margin)])
    beta = np.array([1.0, np.log((ones + 1.0) / (zeros + 1.0))])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(beta @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (p - target) + 1e-6 * beta)
        beta = beta - step
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def fit(texts: pa.Array, good: np.ndarray, bits: int = BITS) -> dict:
    """The model of labelled texts: weight per column, intercept, curve. A class without rows gives a constant score."""
    width = 1 << bits
    parts = [columns_of(chunk, bits) for chunk in chunks(texts)]
    columns = np.concatenate([c.astype(np.int32) for c, _ in parts]) if parts else np.zeros(0, np.int32)
    counts = np.concatenate([np.diff(o) for _, o in parts]) if parts else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    if good.all() or not good.any():
        share = (good.sum() + 1.0) / (len(good) + 2.0)
        return {"scale": np.zeros(width, np.float32), "weights": np.zeros(width, np.float32), "intercept": 0.0,
                "slope": 0.0, "offset": float(np.log(share / (1 - share)))}

    def machine(rows: np.ndarray):
        keep, inner = np.repeat(rows, counts), np.concatenate([[0], np.cumsum(counts[rows])])
        scale = log_count_ratio(columns[keep], inner, good[rows], width)
        return scale, *dual_coordinate_descent(columns[keep], inner, scale, np.where(good[rows], 1.0, -1.0))

    # the curve is fitted on margins of rows that the machine did not see: each fifth by a machine of the others
    margin, held = np.zeros(len(good)), np.zeros(len(good), dtype=bool)
    for fold in range(FOLDS):
        out = np.arange(len(good)) % FOLDS == fold
        if out.any() and good[~out].any() and not good[~out].all():
            part, inner = np.repeat(out, counts), np.concatenate([[0], np.cumsum(counts[out])])
            margin[out] = margins(columns[part], inner, *machine(~out))
            held |= out
    scale, weights, intercept = machine(np.ones(len(good), dtype=bool))
    if not held.any() or good[held].all() or not good[held].any():
        margin, held = margins(columns, offsets, scale, weights, intercept), np.ones(len(good), dtype=bool)
    slope, offset = logistic_curve(margin[held], good[held])
    return {"scale": scale.astype(np.float32), "weights": weights.astype(np.float32), "intercept": float(intercept),
            "slope": max(slope, 0.0), "offset": offset}


def sample_labels(labels: DataFrame, key: str, label: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """(key, good) of about ``max_rows`` labelled keys: those with a key hash under the share that ``max_rows`` is of all.

    Keys that are null, have no 0 or 1 as label or have both take no part.
    """
    rows = labels.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("_least"), F.max(label).alias("_most"))
    rows = rows.filter((F.col("_least") == F.col("_most")) & F.col("_most").isin(0, 1))
    rows = rows.select(key, (F.col("_most") == 1).alias("good"), F.shiftrightunsigned(F.xxhash64(key), 32).alias("_h"))
    share = max_rows / max(rows.count(), 1)
    return rows.filter(F.col("_h") < int(min(share, 1.0) * 2**32)).drop("_h")


def fit_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_rows: int = MAX_ROWS) -> dict:
    """Fit on the documents of a sample of labels. The sample is bounded, so it is what is broadcast in the join.

    The fit runs in one task over the sample; the model, two numbers per column, comes to the driver.
    """
    sample = sample_labels(labels, key, label, max_rows)
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(sample), key)
    rows = rows.select("_text", "good", F.xxhash64("_text").alias("_h"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        rows = pa.Table.from_batches(batches) if batches else schema.empty_table()
        rows = rows.sort_by([("h", "ascending"), ("good", "ascending")])
        model = fit(rows["text"], rows["good"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool))
        yield pa.RecordBatch.from_pydict({
            "scale": pa.array([model["scale"].tobytes()], pa.binary()), "weights": pa.array([model["weights"].tobytes()], pa.binary()),
            "numbers": pa.array([[model["intercept"], model["slope"], model["offset"]]], pa.list_(pa.float64())),
        })

    schema = pa.schema([("text", pa.string()), ("good", pa.bool_()), ("h", pa.int64())])
    rows = rows.toDF("text", "good", "h").repartition(1)
    row = rows.mapInArrow(learn, "scale binary, weights binary, numbers array<double>").first()
    if row is None:  # no labelled document: every score is one half
        return fit(schema.empty_table()["text"], np.zeros(0, dtype=bool))
    intercept, slope, offset = row["numbers"]
    return {"scale": np.frombuffer(row["scale"], np.float32), "weights": np.frombuffer(row["weights"], np.float32),
            "intercept": intercept, "slope": slope, "offset": offset}


def score(docs: DataFrame, text: str, model: dict, keep: list[str], name: str = "score") -> DataFrame:
    """The columns ``keep`` of every row and its score, 0 to 1, higher for class 1."""
    model = docs.sparkSession.sparkContext.broadcast(model)  # two numbers per column: 2 MB whatever the corpus

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        scale, weights = m["scale"].astype(np.float64), m["weights"].astype(np.float64)
        for batch in batches:
            found = [np.zeros(0)]
            for chunk in chunks(batch.column(0)):
                columns, offsets = columns_of(chunk)
                margin = margins(columns, offsets, scale, weights, m["intercept"])
                found.append(1.0 / (1.0 + np.exp(-np.clip(m["slope"] * margin + m["offset"], -30, 30))))
            arrays = [*batch.columns[1:], pa.array(np.concatenate(found))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, name])

    schema = StructType([docs.schema[c] for c in keep] + [StructField(name, DoubleType())])
    return docs.select(F.col(text).alias("_scored_text"), *keep).mapInArrow(scored, schema)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds
