import math

import numpy as np
import pytest

from annalist.llm import whitening
from annalist.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, n string, x string, component string"


def brute(rows, components=4):
    """Rows of the contract with numpy's eigendecomposition of the exact covariance."""
    good = [(k, [math.floor(256 * float(np.float32(c))) for c in v]) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(v) for _, v in good})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    away = np.array([[n * c - s for c, s in zip(v, sums)] for v in distinct], float) / n
    values, vectors = np.linalg.eigh(away.T @ away / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for key, v in good:
        exact = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        centred = np.array([n * c - s for c, s in zip(v, sums)], float) / n
        for k in range(min(components, len(sums))):
            out.append((key, k + 1, n, exact, float(centred @ vectors[:, k] / np.sqrt(values[k])), values[k] / values.sum()))
    return out


def check(found, expected, digits=1e-8):
    """Equal but for the sign of each component."""
    found = sorted((tuple(r)[:6] for r in found), key=lambda r: (str(r[0]), r[1], abs(r[4])))
    expected = sorted(expected, key=lambda r: (str(r[0]), r[1], abs(r[4])))
    assert [r[:4] for r in found] == [r[:4] for r in expected]
    for component in {r[1] for r in found}:
        pairs = [(f[4], e[4]) for f, e in zip(found, expected) if f[1] == component]
        sign = 1 if sum(a * b for a, b in pairs) > 0 else -1
        assert max(abs(a - sign * b) for a, b in pairs) < digits
    assert max(abs(f[5] - e[5]) / e[5] for f, e in zip(found, expected)) < 1e-10


@pytest.mark.parametrize("seed", range(8))
def test_updates_equal_a_decomposition(seed):
    random = np.random.default_rng(seed)
    d, n = (7, 200) if seed % 2 else (16, 60)
    rows = random.integers(-50, 50, (n, d)).astype(float)
    if seed in (2, 3):
        rows[:, 2] = 5  # a constant dimension
    if seed in (4, 5):
        rows[:, 3] = rows[:, 1]  # dependent dimensions
    if seed == 6:
        rows = np.repeat(np.eye(d) * 9, 6, axis=0)  # many equal eigenvalues
    if seed == 7:
        rows *= 10.0 ** random.integers(-3, 6, d)
    spectrum = whitening.Spectrum(d)
    for row in rows[:-13]:
        spectrum.add(row)
    other = whitening.Spectrum(d)
    for row in rows[-13:]:
        other.add(row)
    spectrum.merge(whitening.Spectrum.unpacked(other.packed()))
    away = rows - rows.mean(axis=0)
    scatter = away.T @ away
    size = np.linalg.norm(scatter)
    assert spectrum.count == len(rows) and np.allclose(spectrum.mean, rows.mean(axis=0))
    assert np.abs(spectrum.values - np.linalg.eigvalsh(scatter)).max() < 1e-12 * size
    assert np.abs(spectrum.vectors @ np.diag(spectrum.values) @ spectrum.vectors.T - scatter).max() < 1e-12 * size
    assert np.abs(spectrum.vectors.T @ spectrum.vectors - np.eye(d)).max() < 1e-12


def test_roots_of_a_secular_equation():
    random = np.random.default_rng(1)
    for n in (1, 2, 5, 40):
        poles = np.sort(random.random(n)) * 10.0 ** random.integers(-6, 6)
        poles = np.unique(poles)
        weights = random.standard_normal(len(poles)) * 10.0 ** random.integers(-5, 1, len(poles))
        weights /= np.linalg.norm(weights)
        rho = 10.0 ** random.integers(-4, 4)
        gaps = whitening.secular_roots(poles, weights, rho)
        roots = np.sort((poles[:, None] - gaps)[0])
        exact = np.linalg.eigvalsh(np.diag(poles) + rho * np.outer(weights, weights))
        assert np.abs(roots - exact).max() < 1e-13 * max(abs(exact).max(), 1e-300) * 8


def vectors(random, count, d=6):
    mixed = random.standard_normal((count, d)) @ (random.standard_normal((d, d)) * np.arange(1, d + 1))
    return [[float(np.float32(c)) for c in v] for v in mixed]


def test_against_brute_force(spark, scratch):
    rows = list(enumerate(vectors(np.random.default_rng(2), 300)))
    rows += [(7, rows[3][1]), (None, rows[4][1])] + [(1000 + i, rows[0][1]) for i in range(400)]  # one vector that most rows have
    bad = [(2000, None), (2001, []), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2003, [1.0, math.nan, 1.0, 1.0, 1.0, 1.0]), (2004, [1.0, -math.inf, 1.0, 1.0, 1.0, 1.0]), (2005, [1.0, 2.0])]
    table = spark.createDataFrame([(k, v, "a", "b", "c") for k, v in rows + bad], SCHEMA).repartition(9)
    found = whitening.whiten(table, scratch).collect()
    check(found, brute(rows))
    errors = {r.identity_error for r in found}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_given_vectors(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(QUERIES["op13_whitening"](spark, sf_dir).collect(), brute(rows))


def test_few_and_constant_vectors(spark, scratch):
    table = lambda rows: spark.createDataFrame([(k, v, "a", "b", "c") for k, v in rows], SCHEMA)
    assert whitening.whiten(table([]), scratch).count() == 0
    assert whitening.whiten(table([(1, None), (2, [])]), scratch).count() == 0
    one = whitening.whiten(table([(1, [1.0, 2.0]), (2, [1.0, 2.0])]), scratch).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation) for r in one) == [(1, 1, 1, 0), (1, 2, 1, 0), (2, 1, 1, 0), (2, 2, 1, 0)]
    assert {(r.whitened, r.explained, r.identity_error) for r in one} == {(None, None, None)}
    line = sorted(whitening.whiten(table([(1, [0.0, 0.0, 0.0]), (2, [1.0, 1.0, 0.0])]), scratch).collect())
    assert [r.component for r in line] == [1, 2, 3] * 2 and [r.deviation for r in line] == [2 * 256**2] * 6
    assert [r.whitened is None for r in line] == [False, True, True] * 2
    assert abs(line[0].whitened) == pytest.approx(1) and line[0].explained == pytest.approx(1) and line[0].identity_error < 1e-12


def test_deviations_are_exact():
    x = np.array([[1, -(1 << 40)], [3, 1 << 62]], np.int64)
    sums = [4, (1 << 62) - (1 << 40)]
    assert whitening.deviations(x, 2, sums) == [v if v < 1 << 63 else None for v in (sum((2 * int(c) - s) ** 2 for c, s in zip(r, sums)) for r in x.tolist())]
    assert whitening.deviations(np.array([[1, 2], [5, 9]], np.int64), 2, [6, 11]) == [16 + 49, 16 + 49]
