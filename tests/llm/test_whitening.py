"""Embedding whitening against exact fractions and numpy."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from grapevine.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, component string, n int"


def frame(spark, rows):
    """Vectors beside columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)


def vectors(seed: int, n: int, d: int) -> list[tuple[int, list[float]]]:
    dice = random.Random(seed)
    return [(i, [dice.gauss(j, 1 + j % 3) + (dice.gauss(0, 1) if j else 0) for j in range(d)]) for i in range(n)]


def whole(vector) -> tuple[int, ...]:
    return tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vector)


def plain_covariance(xs: list[tuple[int, ...]]) -> list[list[Fraction]]:
    n, d = len(xs), len(xs[0])
    means = [Fraction(sum(x[j] for x in xs), n) for j in range(d)]
    return [[sum((x[a] - means[a]) * (x[b] - means[b]) for x in xs) / n for b in range(d)] for a in range(d)]


def test_variances_of_sums_give_the_exact_covariance(spark):
    rows = vectors(1, 40, 5)
    xs = sorted({whole(v) for _, v in rows})
    usable = frame(spark, rows + rows[:7]).select(whitening.whole_numbers(F.col("embedding")).alias("x")).distinct()
    n, sums = whitening.totals(usable, "x")
    assert n == len(xs) and sums == [sum(x[j] for x in xs) for j in range(5)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    found = whitening.pair_squares(usable, "x", centre)
    expected = np.array([[float(c) for c in row] for row in plain_covariance(xs)])
    assert (whitening.covariance(n, rest, found) == expected).all()


def test_every_row_and_component(spark):
    rows = vectors(2, 60, 6)
    rows += [(100 + i, rows[3][1]) for i in range(90)]  # copies count once in the fit
    got = whitening.whiten(frame(spark, rows), "vec_id", "embedding", components=4).collect()
    assert len(got) == 4 * len(rows)
    xs = sorted({whole(v) for _, v in rows})
    n, sums = len(xs), [sum(x[j] for x in xs) for j in range(6)]
    cov = np.array([[float(c) for c in row] for row in plain_covariance(xs)])
    values, directions = np.linalg.eigh(cov)
    values, directions = values[::-1], directions[:, ::-1]
    by_id = {(r.vec_id, r.component): r for r in got}
    signs = {}
    for i, v in rows:
        x = whole(v)
        own = [float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)]
        for k in range(4):
            row = by_id[i, k + 1]
            assert row.n == n and row.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            assert row.explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
            assert row.identity_error < 1e-9
            expected = float(np.dot(own, directions[:, k]) / math.sqrt(values[k]))
            sign = signs.setdefault(k, 1 if expected * row.whitened > 0 else -1)
            assert row.whitened == pytest.approx(sign * expected, abs=1e-9)


def test_vectors_that_go_and_that_stay(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (None, [0.0, 0.5]), (2, [2.0, 1.0]), (3, [-1.0, -0.0])]
    bad = [(4, None), (5, []), (6, [1.0, None]), (7, [nan, 1.0]), (8, [1.0, inf]), (9, [-inf, 1.0]), (None, None)]
    got = whitening.whiten(frame(spark, good + bad), "vec_id", "embedding").collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got) == sorted((i is None, i or 0, k) for i, _ in good for k in (1, 2))
    assert {r.n for r in got} == {4}
    assert whitening.whiten(frame(spark, bad), "vec_id", "embedding").count() == 0
    assert whitening.whiten(frame(spark, []), "vec_id", "embedding").count() == 0


def test_flat_dimensions_and_single_vectors(spark):
    got = whitening.whiten(frame(spark, [(1, [1.0, 5.0]), (2, [3.0, 5.0])]), "vec_id", "embedding").collect()
    assert {(r.vec_id, r.component, r.whitened if r.component == 2 else abs(r.whitened)) for r in got} == {
        (1, 1, 1.0), (2, 1, 1.0), (1, 2, None), (2, 2, None)}
    assert all(r.explained == (1.0 if r.component == 1 else 0.0) and r.identity_error < 1e-12 for r in got)
    alone = whitening.whiten(frame(spark, [(1, [1.0, 5.0])] * 3), "vec_id", "embedding").collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 0, None, None, None)] * 6


def test_wide_entries_stay_exact(spark):
    rows = [(1, [1e12, 1.0]), (2, [-1e12, 3.0]), (3, [5e11, 2.0])]
    xs = [whole(v) for _, v in rows]
    sums = [sum(c) for c in zip(*xs, strict=True)]
    got = whitening.whiten(frame(spark, rows), "vec_id", "embedding").collect()
    exact = {i: sum((3 * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for (i, _), x in zip(rows, xs, strict=True)}
    assert all(r.deviation == (exact[r.vec_id] if exact[r.vec_id] < 1 << 63 else None) for r in got)
    assert all(r.explained == pytest.approx(1.0) for r in got if r.component == 1)


def test_lengths_that_differ_are_an_error(spark):
    with pytest.raises(Exception, match="entries in one table"):
        whitening.whiten(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]), "vec_id", "embedding").collect()


def test_query_over_the_given_table(spark):
    got = queries.op11_whitening(spark, "/root/testdata/sf0.001").toPandas()
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas()
    xs = sorted({whole(v) for v in table["embedding"] if v is not None and np.isfinite(np.asarray(v, float)).all()})
    assert set(got["n"]) == {len(xs)} and (got.groupby("vec_id").size() == 16).all()
    assert got["identity_error"].max() < 1e-9
    first = got[got["component"] == 1].drop_duplicates("vec_id")
    assert len(first) == len(table)
