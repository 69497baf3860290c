"""Whitening of vectors by an eigendecomposition that grows row by row.

Every partition of the distinct vectors keeps the spectrum of its scatter matrix and updates
it with one centred rank-one term a row: the secular equation gives the new eigenvalues,
after deflation of those that do not move. Spectra of partitions are combined by rank-one
updates too, one for every direction of the smaller and one for the distance of the means.
The combined directions are refined by a Rayleigh-Ritz step over all vectors: the covariance
in these directions is summed on the executors and its small eigenproblem solved once.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import record_batch
from annalist.operators.lineage import Scratch

#: integer steps of one unit of an entry
STEPS = 256
#: spectra that one task combines
TOGETHER = 16
#: rank-one updates between two orthogonalisations, which keep rounding from adding up
TIDY = 512
EPSILON = float(np.finfo(np.float64).eps)
LONG = 1 << 63


def secular_roots(poles: np.ndarray, weights: np.ndarray, rho: float) -> np.ndarray:
    """``gaps[i, k] = poles[i] - root[k]`` of ``1 + rho * sum(weights ** 2 / (poles - root)) = 0``.

    ``poles`` rise strictly, ``weights`` are a unit vector without zeros, ``rho`` is positive.
    Root k lies between pole k and the next, the last within ``rho`` of its pole. Each is found
    as a distance from the nearer pole, so that gaps keep their relative accuracy: a rational
    function with both poles is fitted to either side's sum, and bisection keeps it inside.
    """
    n = len(poles)
    ends = np.append(poles[1:], poles[-1] + rho)
    square = rho * weights**2
    middle = (poles + ends) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        value = 1 + (square[:, None] / (poles[:, None] - middle[None, :])).sum(axis=0)
    left = (value > 0) | (np.arange(n) == n - 1)
    origin = np.where(left, poles, ends)
    delta = poles[:, None] - origin[None, :]
    below, above = poles - origin, ends - origin
    half = (ends - poles) / 2
    low = np.where(left, 0.0, -half)
    high = np.where(left, np.where(np.arange(n) == n - 1, rho, half), 0.0)
    at = (low + high) / 2
    lower = np.arange(n)[:, None] <= np.arange(n)[None, :]
    for _ in range(100):
        gaps = delta - at
        terms = square[:, None] / gaps
        value = 1 + terms.sum(axis=0)
        done = np.abs(value) <= 4 * n * EPSILON * (1 + np.abs(terms).sum(axis=0))
        done |= (high - low) <= 2 * EPSILON * np.abs(at)
        if done.all():
            break
        low, high = np.where(value < 0, at, low), np.where(value > 0, at, high)
        slopes = terms / gaps
        psi = np.where(lower, slopes, 0).sum(axis=0)
        phi = slopes.sum(axis=0) - psi
        x, y = below - at, above - at
        a = (x + y) * value - x * y * (psi + phi)
        b = x * y * value
        c = value - x * psi - y * phi
        with np.errstate(divide="ignore", invalid="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = at + step
        inside = np.isfinite(new) & (new > low) & (new < high)
        at = np.where(done, at, np.where(inside, new, (low + high) / 2))
    return delta - at


class Spectrum:
    """Number, mean, and spectrum of the scatter matrix of vectors seen so far.

    ``values`` rise; column k of ``vectors`` belongs to ``values[k]``.
    """

    def __init__(self, dimensions: int):
        self.count, self.mean = 0, np.zeros(dimensions)
        self.values, self.vectors = np.zeros(dimensions), np.eye(dimensions)
        self.updates = 0

    def add(self, vector: np.ndarray) -> None:
        """One more vector: a rank-one term along its distance from the mean."""
        away = vector - self.mean
        self.count += 1
        self.mean = self.mean + away / self.count
        if self.count > 1:
            self.update(away, (self.count - 1) / self.count)

    def merge(self, other: "Spectrum") -> None:
        """The spectrum of both sets of vectors."""
        if not other.count:
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.update(vector, value)
        away, both = other.mean - self.mean, self.count + other.count
        if self.count:
            self.update(away, self.count * other.count / both)
        self.mean = self.mean + away * (other.count / both)
        self.count = both

    def update(self, direction: np.ndarray, rho: float) -> None:
        """Spectrum of the scatter matrix plus ``rho`` times the direction's outer product."""
        weights = self.vectors.T @ direction
        length = float(np.linalg.norm(weights))
        rho = rho * length * length
        if not rho > 0 or not np.isfinite(rho):
            return
        weights = weights / length
        small = 8 * EPSILON * max(abs(self.values[-1]), rho)
        self._gather_equal(weights, small)
        moved = np.flatnonzero(rho * np.abs(weights) > small)
        if len(moved):
            poles, part = self.values[moved], weights[moved]
            gaps = secular_roots(poles, part / np.linalg.norm(part), rho * float(part @ part))
            # weights for which the computed roots are exact, so that vectors are orthogonal
            ratios = gaps.copy()
            between = poles[:, None] - poles[None, :]
            off = ~np.eye(len(moved), dtype=bool)
            ratios[off] /= between[off]
            exact = np.sqrt(np.abs(ratios.prod(axis=1))) * np.sign(part)
            turn = exact[:, None] / gaps
            turn /= np.linalg.norm(turn, axis=0)
            self.vectors[:, moved] = self.vectors[:, moved] @ turn
            nearest = np.abs(gaps).argmin(axis=0)
            self.values[moved] = poles[nearest] - gaps[nearest, np.arange(len(moved))]
            order = np.argsort(self.values, kind="stable")
            self.values, self.vectors = self.values[order], self.vectors[:, order]
        self.updates += 1
        if self.updates % TIDY == 0:
            q, r = np.linalg.qr(self.vectors)
            self.vectors = q * np.sign(np.diag(r))

    def _gather_equal(self, weights: np.ndarray, small: float) -> None:
        """Turns the vectors of equal values so that one of them has all their weight."""
        close = np.diff(self.values) <= small
        if not close.any():
            return
        start = 0
        while start < len(close):
            if not close[start]:
                start += 1
                continue
            stop = start + 1
            while stop < len(self.values) and self.values[stop] - self.values[start] <= small:
                stop += 1
            part = weights[start:stop]
            length = float(np.linalg.norm(part))
            if np.count_nonzero(part) > 1:
                mirror = part.copy()
                mirror[-1] += np.copysign(length, part[-1])
                mirror /= np.linalg.norm(mirror)
                own = self.vectors[:, start:stop]
                self.vectors[:, start:stop] = own - 2 * np.outer(own @ mirror, mirror)
                last = -np.copysign(length, part[-1])
                weights[start:stop] = 0
                weights[stop - 1] = last
            start = stop

    def packed(self) -> bytes:
        return np.concatenate([[len(self.mean), self.count], self.mean, self.values, self.vectors.ravel()]).tobytes()

    @staticmethod
    def unpacked(data: bytes) -> "Spectrum":
        numbers = np.frombuffer(data, np.float64)
        d = int(numbers[0])
        out = Spectrum(d)
        out.count, out.mean = int(numbers[1]), numbers[2 : 2 + d].copy()
        out.values, out.vectors = numbers[2 + d : 2 + 2 * d].copy(), numbers[2 + 2 * d :].reshape(d, d).copy()
        return out


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def usable(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``key, x``: the rows whose vector is neither NULL nor empty nor holds a NULL or non-finite
    entry, each entry c as ``floor(256 * c)``, a long (those beyond a long become its bounds)."""
    entries = F.transform(F.col(vector), lambda c: c.cast("double"))
    good = F.forall(entries, lambda c: F.coalesce((F.abs(c) < F.lit(float("inf"))) & ~F.isnan(c), F.lit(False)))
    steps = F.transform(entries, lambda c: F.floor(c * STEPS))
    return rows.filter(good & (F.size(vector) > 0)).select(F.col(key).alias("vec_id"), steps.alias("x"))


def _sums(dimensions: int):
    """Exact sums of a task's vectors, in two halves that cannot overflow: of x >> 32, then of the rest."""

    def run(batches):
        high, low = np.zeros(dimensions, np.int64), np.zeros(dimensions, np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), dimensions)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"sums": [[*high.tolist(), *low.tolist()]]})

    return run


def _spectra(dimensions: int):
    def run(batches):
        spectrum = Spectrum(dimensions)
        for batch in batches:
            for row in _matrix(batch.column("x"), dimensions).astype(np.float64):
                spectrum.add(row)
        if spectrum.count:
            yield pa.RecordBatch.from_pydict({"spectrum": pa.array([spectrum.packed()], pa.binary())})

    return run


def _combined(batches):
    """One spectrum of all those of a group, row by row; rows are sorted by group."""
    group, spectrum = None, None
    for batch in batches:
        for g, data in zip(batch.column("part").to_pylist(), batch.column("spectrum").to_pylist()):
            other = Spectrum.unpacked(data)
            if g != group:
                if spectrum:
                    yield pa.RecordBatch.from_pydict({"spectrum": pa.array([spectrum.packed()], pa.binary())})
                group, spectrum = g, other
            else:
                spectrum.merge(other)
    if spectrum:
        yield pa.RecordBatch.from_pydict({"spectrum": pa.array([spectrum.packed()], pa.binary())})


def _covariances(basis: np.ndarray, mean: np.ndarray):
    """Sums of the outer products of a task's centred vectors in ``basis``."""

    def run(batches):
        total = np.zeros((basis.shape[1], basis.shape[1]))
        for batch in batches:
            away = (_matrix(batch.column("x"), len(mean)).astype(np.float64) - mean) @ basis
            total += away.T @ away
        yield pa.RecordBatch.from_pydict({"sums": [total.ravel().tolist()]})

    return run


def _summed(rows: DataFrame, count: int, kind: str = "double") -> list:
    """Entrywise sum of the arrays in column ``sums``, summed on the executors."""
    cells = rows.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum(F.col("value").cast(kind)).alias("value")).collect()
    out = [0] * count
    for at, value in cells:
        out[at] = value
    return out


def spectrum_of(fit: DataFrame, dimensions: int, scratch: Scratch) -> Spectrum:
    """Spectrum of the scatter matrix of all vectors: those of tasks, combined level by level.

    A task gets at most ``TOGETHER`` spectra, so neither a task nor the driver holds more.
    """
    spectra, found = scratch.counted(fit.mapInArrow(_spectra(dimensions), "spectrum binary"))
    while found > 1:
        parts = -(-found // TOGETHER)
        numbered = spectra.withColumn("part", F.pmod(F.xxhash64("spectrum"), F.lit(parts))).repartition(parts, "part").sortWithinPartitions("part")
        before = spectra
        spectra, found = scratch.counted(numbered.mapInArrow(_combined, "spectrum binary"))
        scratch.drop(before)
    rows = spectra.collect()
    return Spectrum.unpacked(bytes(rows[0][0])) if rows else Spectrum(dimensions)


WHITENED = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list:
    """``sum((n * x - sums) ** 2)`` of every row, exactly; None where it exceeds a long."""
    low = min(min(n * int(x.min()) - s for s in sums), 0) if len(x) else 0
    high = max(max(n * int(x.max()) - s for s in sums), 0) if len(x) else 0
    if len(sums) * max(-low, high) ** 2 < LONG and max(abs(s) for s in sums) < LONG:
        away = n * x - np.array(sums, np.int64)
        return (away * away).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < LONG else None for v in exact]


def whiten(rows: DataFrame, scratch: Scratch, components: int = 4, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable row.

    Unusable are rows whose vector is NULL, empty, or holds a NULL or non-finite entry, and
    those of another length than most distinct vectors have (the longer one, if equally many).
    An entry c counts as the long ``x = floor(256 * c)``. The covariance V is that of the
    distinct x vectors, ``n`` in number, with divisor n; ``S`` are their sums. Components are
    its unit eigenvectors by falling eigenvalue e, from 1 to ``components`` or the number of
    dimensions; the largest entry of each is positive.

    * ``deviation``: sum over dimensions of ``(n * x - S) ** 2``, exact; NULL beyond a long.
    * ``whitened``: ``x - S / n`` along the component over the root of e; NULL where e is no
      more than rounding (fewer distinct vectors than components, constant dimensions).
    * ``explained``: e over the trace of V; NULL if that is 0.
    * ``identity_error``: largest absolute entry of the covariance of ``whitened`` over the
      distinct vectors, minus the identity; NULL without a component that can be whitened.

    Repeated rows and vectors, also a vector that a third of all rows have, are combined within
    tasks before they meet. Rows are not shuffled; keys may be NULL or repeated; other columns
    are not read. What leaves the executors are numbers of the size of V at most. Tables are
    written to ``scratch``: the distinct vectors, and one spectrum a task.
    """
    spark = rows.sparkSession
    good = usable(rows, vector, key)
    fit = scratch.keep(good.select("x").distinct())
    sizes = fit.groupBy(F.size("x").alias("d")).count()
    # as many rows as there are lengths
    most = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    kind = rows.schema[key].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if most is None:
        return spark.createDataFrame([], schema)
    d = most["d"]
    good, fit = (t.filter(F.size("x") == d) for t in (good, fit))
    halves = [int(v) for v in _summed(fit.mapInArrow(_sums(d), "sums array<bigint>"), 2 * d, "decimal(38,0)")]
    n, sums = most["count"], [(h << 32) + s for h, s in zip(halves[:d], halves[d:])]
    mean = np.array([s / n for s in sums])

    spectrum = spectrum_of(fit, d, scratch)
    basis = spectrum.vectors[:, ::-1]
    in_basis = lambda b, m: np.array(_summed(fit.mapInArrow(_covariances(b, m), "sums array<double>"), b.shape[1] ** 2)).reshape(-1, b.shape[1]) / n
    # Rayleigh-Ritz: the covariance in these directions, whose eigenvectors refine them
    values, turn = np.linalg.eigh(in_basis(basis, mean))
    vectors = np.linalg.qr(basis)[0] @ turn[:, ::-1]
    values, trace = values[::-1], float(values.sum())
    k = min(components, d)
    vectors, values = vectors[:, :k], values[:k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    real = values > 64 * d * EPSILON * max(trace, 0)
    scales = np.where(real, 1 / np.sqrt(np.where(real, values, 1)), np.nan)
    error = None
    if real.any():
        white = vectors[:, real] * scales[real]
        error = float(np.abs(in_basis(white, mean) - np.eye(real.sum())).max())
    white, shares = vectors * scales, [float(v) / trace if trace > 0 else None for v in values]

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            if not len(x):
                continue
            found = ((x.astype(np.float64) - mean) @ white).ravel()
            again = pa.array(np.repeat(np.arange(len(x)), k))
            made = record_batch(
                pa.schema(list(WHITENED)[1:]),
                np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                [n] * len(x) * k,
                np.repeat(np.array(deviations(x, n, sums), object), k),
                pa.array(found, from_pandas=True),
                shares * len(x),
                [error] * len(x) * k,
            )
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(again), *made.columns], names=WHITENED.names)

    return good.mapInArrow(run, schema).withColumnRenamed("vec_id", key)
