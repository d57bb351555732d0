"""Whitening against whole-number brute force and numpy."""

from fractions import Fraction

import numpy as np
import pytest

from hiresift.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def plain(vectors, components=4, scale=256):
    """n, exact deviations and whitened values of plain rows, by whole numbers and one eigh."""
    x = [[int(np.floor(c * scale)) for c in v] for v in vectors]
    fit = [list(v) for v in sorted(set(map(tuple, x)))]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    width = len(sums)
    covariance = np.array(
        [[float(Fraction(n * sum(r[i] * r[j] for r in fit) - sums[i] * sums[j], n * n)) for j in range(width)] for i in range(width)]
    )
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:components]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in x])
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    return n, deviations, centred @ axes[:, order] / np.sqrt(values[order]), values[order] / np.trace(covariance)


def compare(spark, vectors, components=4, tolerance=1e-7):
    table = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], SCHEMA).repartition(3)
    rows = whitening.whiten(table, components).orderBy("vec_id", "component").collect()
    n, deviations, whitened, explained = plain(vectors, components)
    k = whitened.shape[1]
    assert len(rows) == len(vectors) * k
    got = np.array([r.whitened for r in rows]).reshape(-1, k)
    signs = np.sign((got * whitened).sum(0))
    assert np.abs(got - whitened * signs).max() < tolerance
    assert [int(r.deviation) for r in rows[::k]] == deviations
    assert {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1
    assert rows[0].identity_error < 1e-4
    assert np.allclose([r.explained for r in rows[:k]], explained, rtol=1e-9)


def test_whitening_equals_brute_force_with_repeated_rows(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(150, 6)) * [3, 2, 1, 1, 0.5, 0.2]
    compare(spark, np.concatenate([vectors, vectors[:1].repeat(60, 0), vectors[20:30]]))


@pytest.mark.parametrize("offset", [1e9, 1e14, -3e15])
def test_far_shifted_vectors_lose_nothing(spark, offset):
    rng = np.random.default_rng(2)
    compare(spark, offset + np.floor(rng.normal(size=(80, 5)) * 4000) * 0.25)


def test_numbers_of_many_limbs(spark):
    rng = np.random.default_rng(3)
    compare(spark, rng.normal(size=(50, 4)) * 1e14)


def test_scatter_is_exact_whatever_the_size_of_numbers():
    rng = np.random.default_rng(4)
    for high in (2**10, 2**30, 2**61):
        x = rng.integers(-high, high, (9000, 3))
        scatter = whitening.Scatter([5, -high, 2**62])
        scatter.add(x[:4000]), scatter.add(x[4000:])
        y = np.concatenate([np.ones((9000, 1), object), x.astype(object) - np.array([5, -high, 2**62], object)], 1)
        assert (scatter.flush() == y.T @ y).all()
        numbers = scatter.flush()[0]
        assert whitening.unwired(np.frombuffer(whitening.wire(numbers), "int64").reshape(whitening.WIRE_LIMBS, -1)) == list(numbers)


def test_nulls_other_lengths_constants_and_empty_tables(spark):
    rng = np.random.default_rng(5)
    fine = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(40, 3)))]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0])]
    short = [(200 + i, [float(i), 7.0]) for i in range(5)]
    table = spark.createDataFrame([(*r, "a", 1) for r in fine + odd + short + [(None, [0.5, 0.5, 0.5])]], SCHEMA + ", x string, component int")
    rows = whitening.whiten(table).collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert set(by_id) == {None, *range(40), *range(200, 205)}
    assert all(len(v) == (2 if k and k >= 200 else 3) for k, v in by_id.items())
    # The second dimension of the short vectors is constant: no variance, no whitened value.
    assert all(by_id[200 + i][2].whitened is None and by_id[200 + i][1].whitened is not None for i in range(5))
    assert {r.n for r in rows if r.vec_id and r.vec_id >= 200} == {5}
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)).collect()
    assert [(r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    assert whitening.whiten(table.limit(0)).count() == 0
