"""Whitening of embeddings by polarisation: covariances out of variances alone.

A vector's entries become whole numbers, ``floor(scale * entry) + offset``. The fit list holds each distinct whole-number vector
once. For every dimension, and for the sum of every two dimensions, tasks add up exact squares of values centred at the rounded
mean; what the rounding left over is taken off exactly, so that each figure is the exact sum of squared deviations. Then
``2 * cov(a, b) = var(a + b) - var(a) - var(b)``, still in whole numbers; the division to double is the only rounding before ``eigh``.

Copies are dropped before the shuffle, so a vector that a third of the rows hold costs a row per task. What comes to the driver
is ``d * (d + 1) / 2`` numbers for ``d`` dimensions, added up by Spark before.

Rows go whose vector is null or empty or holds null, NaN or infinite entries. Vectors of different lengths are an error, as are whole
numbers that do not fit a long. Components whose variance is nothing beside the largest (``FLAT``) have null ``whitened`` values. A
``deviation`` beyond a long is null. Null ids stay, repeated rows stay, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..storage import materialise

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
FLAT = 1e-13
NARROW = 1 << 62  # sums below it are added up as longs, others as Python's whole numbers
BLOCK = 4096


def whole_numbers(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """``floor(scale * entry) + offset`` of every entry, as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(offset).cast("long"))


def is_usable(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite numbers."""
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def matrix_of(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.unique(np.diff(column.offsets.to_numpy()))
    if len(lengths) > 1:
        raise ValueError(f"vectors of {lengths.tolist()} entries in one table")
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), int(lengths[0]) if len(lengths) else 0)


def added(rows: np.ndarray) -> list[int]:
    """Exact sums of the columns."""
    most = int(np.abs(rows).max(initial=0))
    exact = rows if most * max(len(rows), 1) < NARROW else rows.astype(object)
    return [int(v) for v in exact.sum(axis=0)]


def summed(parts: DataFrame) -> list[int]:
    """Entry by entry, the sum of lists of whole numbers spelled as text: one list per task comes in."""
    rows = parts.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))
    return [int(row["total"]) for row in sorted(rows.collect(), key=lambda row: row["at"])]


def totals(rows: DataFrame, vector: str) -> tuple[int, list[int]]:
    """(rows, sum of each dimension)."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for batch in batches:
            if len(batch):
                values = matrix_of(batch.column(0))
                own = [len(values), *added(values)]
                if total and len(own) != len(total):
                    raise ValueError(f"vectors of {len(total) - 1} and {len(own) - 1} entries in one table")
                total = [a + b for a, b in zip(total, own, strict=True)] if total else own
        yield pa.RecordBatch.from_pydict({"sums": pa.array([[str(v) for v in total]], pa.list_(pa.string()))})

    found = summed(rows.select(vector).mapInArrow(add, "sums array<string>"))
    return (found[0], found[1:]) if found else (0, [])


def pairs_of(dimensions: int) -> list[tuple[int, int]]:
    """Every dimension with itself and with each later one."""
    return [(a, b) for a in range(dimensions) for b in range(a, dimensions)]


def squares(rows: np.ndarray) -> list[int]:
    """For each pair of dimensions the exact sum of squares of their sum, and of a dimension alone where both are the same."""
    most = int(np.abs(rows).max(initial=0))
    exact = rows if (2 * most) ** 2 * max(len(rows), 1) < NARROW else rows.astype(object)
    out: list[int] = []
    for a in range(rows.shape[1]):
        sums = exact[:, a:] + exact[:, a:a + 1]
        sums[:, 0] = exact[:, a]
        out += (sums * sums).sum(axis=0).tolist()
    return out


def pair_squares(rows: DataFrame, vector: str, centre: list[int]) -> list[int]:
    """``squares`` of the vectors less ``centre`` over all rows."""
    shift = np.array(centre, dtype=np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * len(pairs_of(len(shift)))
        for batch in batches:
            values = matrix_of(batch.column(0)) if len(batch) else np.zeros((0, len(shift)), np.int64)
            if values.shape[1] != len(shift):
                raise ValueError(f"vectors of {values.shape[1]} and {len(shift)} entries in one table")
            for at in range(0, len(values), BLOCK):
                total = [a + b for a, b in zip(total, squares(values[at:at + BLOCK] - shift), strict=True)]
        yield pa.RecordBatch.from_pydict({"sums": pa.array([[str(v) for v in total]], pa.list_(pa.string()))})

    return summed(rows.select(vector).mapInArrow(add, "sums array<string>"))


@dataclass
class Whitening:
    """Exact sums of a fit list and the components of its covariance."""

    n: int
    sums: list[int]
    centre: list[int]
    variances: np.ndarray
    directions: np.ndarray
    explained: np.ndarray

    @property
    def rest(self) -> np.ndarray:
        """What the means have beyond ``centre``."""
        return np.array([(s - self.n * c) / max(self.n, 1) for s, c in zip(self.sums, self.centre, strict=True)])

    @property
    def projection(self) -> np.ndarray:
        """Directions over the roots of their variances; a flat one is NaN."""
        flat = self.variances <= FLAT * self.variances.max(initial=0.0)
        return self.directions / np.sqrt(np.where(flat, np.nan, self.variances))

    def whitened(self, values: np.ndarray) -> np.ndarray:
        return ((values - np.array(self.centre, dtype=np.int64)) - self.rest) @ self.projection

    def deviations(self, values: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - S) ** 2, exact; None beyond a long."""
        rest = [s - self.n * c for s, c in zip(self.sums, self.centre, strict=True)]
        shifted = values - np.array(self.centre, dtype=np.int64)
        most = self.n * int(np.abs(shifted).max(initial=0)) + max(map(abs, rest), default=0)
        kind = np.int64 if most * most * len(rest) < NARROW else object
        own = shifted.astype(kind) * self.n - np.array(rest, dtype=kind)
        return [d if d < 1 << 63 else None for d in (own * own).sum(axis=1).tolist()]


def covariance(n: int, rest: list[int], found: list[int]) -> np.ndarray:
    """The covariance matrix, each entry rounded once, out of sums of squares of all ``pairs_of`` the dimensions.

    ``rest`` are the dimensions' sums after centring; n * sum of squares - rest ** 2 is n times the exact sum of squared deviations.
    """
    d = len(rest)
    scattered = {
        (a, b): n * square - (rest[a] if a == b else rest[a] + rest[b]) ** 2
        for (a, b), square in zip(pairs_of(d), found, strict=True)
    }
    out = np.empty((d, d))
    for (a, b), scatter in scattered.items():
        out[a, b] = out[b, a] = scatter / n**2 if a == b else (scatter - scattered[a, a] - scattered[b, b]) / (2 * n**2)
    return out


def fit(rows: DataFrame, vector: str, components: int = COMPONENTS) -> Whitening:
    """The whitening of a fit list: ``rows`` of whole-number vectors, each counted as it stands."""
    n, sums = totals(rows, vector)
    if not n:
        return Whitening(0, [], [], np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    values, vectors = np.linalg.eigh(covariance(n, rest, pair_squares(rows, vector, centre)))
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0)
    trace = values.sum()
    explained = values / trace if trace > 0 else np.full(len(values), np.nan)
    return Whitening(n, sums, centre, values[:components], vectors[:, :components], explained[:components])


def identity_error(rows: DataFrame, vector: str, model: Whitening) -> float | None:
    """The largest entry of the whitened fit list's covariance less the identity, measured; None without a component.

    Each task adds up the products of its own rows; Spark adds the tasks' lists entry by entry.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)  # follows the dimensions
    some = ~np.isnan(model.projection).any(axis=0) if model.n else np.zeros(0, bool)
    k = int(some.sum())
    if not k:
        return None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            if len(batch):
                own = shared.value.whitened(matrix_of(batch.column(0)))[:, some]
                own = np.column_stack([np.ones(len(own)), own])
                total += own.T @ own
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})

    parts = rows.select(vector).mapInArrow(add, "sums array<double>")
    cells = parts.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("total")).collect()
    total = np.array([row["total"] for row in sorted(cells, key=lambda row: row["at"])]).reshape(k + 1, k + 1)
    mean = total[0, 1:] / model.n
    return float(np.abs(total[1:, 1:] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def project(rows: DataFrame, vector: str, model: Whitening, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row with ``deviation`` and the array ``whitened``, a value per component (null if flat)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # follows the dimensions
    schema = StructType([rows.schema[c] for c in keep] + [
        StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))])

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if not len(batch):
                continue
            values = matrix_of(batch.column(0))
            out = own.whitened(values)
            flat = pa.array(out.ravel(), pa.float64(), mask=np.isnan(out.ravel()))
            offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(own.deviations(values), pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                names=[*keep, "deviation", "whitened"])

    return rows.select(F.col(vector).alias("_vector"), *keep).mapInArrow(projected, schema)


def whiten(
    rows: DataFrame, key: str, vector: str, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET,
) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every usable row and component, numbered from 1."""
    usable = rows.filter(is_usable(F.col(vector))).select(F.col(key).alias("_id"), whole_numbers(F.col(vector), scale, offset).alias("_x"))
    distinct = materialise(usable.select("_x").distinct(), name="fit-list")
    model = fit(distinct, "_x", components)
    error = identity_error(distinct, "_x", model)
    long_rows = project(usable, "_x", model, ["_id"]).select("_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    shares = [None if np.isnan(e) else float(e) for e in model.explained]
    explained = F.array(*(F.lit(e).cast("double") for e in shares)) if shares else F.array().cast("array<double>")
    return long_rows.select(
        F.col("_id").alias(key),
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("_at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
