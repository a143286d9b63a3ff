"""Embedding whitening (operator 13) by contour integration.

Vectors are whole numbers, x = floor(256 * c). The fit list is every distinct x once; its sums are exact,
and its covariance V is added up from vectors that are centred first. The leading components come from
FEAST: counts of eigenvalues above trial shifts (inertia of V - s I) find an interval of the real line
that holds the wanted eigenvalues and ends in a gap; a circle around the interval carries quadrature
nodes, and the complex shifted systems (z I - V) X = Y of the nodes, one Spark task each, sum up to the
projection of Y onto the interval's eigenvectors; Rayleigh-Ritz takes values and vectors out of the
projected space. That repeats until the residuals are down to rounding and the number of Ritz values
inside the interval is the one that the inertia counts ask for, so that none is missed; a space that
does not get there is doubled, up to the whole one. Leading eigenvalues that cannot be told from the next
are all in the interval.

The work over rows (distinct vectors, sums, covariance, whitened rows) is spread by Spark; each task
sums up what it has read. The driver and a task hold the matrix of one vector length, whose size depends on
that length and not on the number of rows.

Rows whose vector is null or empty or holds a null or non-finite entry take no part; rows without an id
stay. Vectors of different length are whitened apart, each length with a fit of its own. Repeated rows
count once in the fit and stay in the result. Directions without variance are no components, so that a
length with a single distinct vector gives no row, as does an empty table. A component beyond 64 bits is the nearest
whole number of 64 bits; a deviation beyond them is null. Other columns are not looked at.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wattline.llm.common import materialize

COMPONENTS, SCALE = 4, 256
# Quadrature nodes on the upper half of the circle; trial shifts in a round.
NODES, SHIFTS = 8, 16
ROUNDS, REPEATS = 14, 8
# Residual against the largest eigenvalue, and what counts as no variance, by the length of vectors.
RESIDUAL, NOTHING = 4e-15, 4e-16


def whole_vectors(df, vector="embedding", key="vec_id"):
    """Written (vec_id, x, size) of the rows that take part."""
    parts = F.transform(df[vector], lambda c: c.cast("double"))
    fine = ~F.exists(parts, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.where(df[vector].isNotNull() & (F.size(df[vector]) > 0) & fine).select(
        df[key].cast("long").alias("vec_id"), F.transform(parts, lambda c: F.floor(c * SCALE)).alias("x"))
    return materialize(rows.withColumn("size", F.size("x")), "vectors")


def matrix(column):
    """A list column of equal lengths as a matrix of whole numbers."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


class Fit:
    """Count and exact sums of the distinct vectors; the mean is a whole number and a rest below one."""

    def __init__(self, n, sums):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]
        self.part = np.array([r / n for r in self.rest])

    def centred(self, x):
        """x less the mean, as doubles."""
        if np.abs(x.astype(float)).max(initial=0) < 2.0**61:
            return (x - self.whole) - self.part
        return x.astype(float) - (self.whole + self.part)

    def deviations(self, x):
        """Sum over dimensions of (n * x - sum)^2, exact; null beyond 64 bits."""
        far = np.abs(x.astype(float) - self.whole).max(initial=0) + 1
        if far * far * self.n * self.n * x.shape[1] < 2.0**62:
            off = self.n * (x - self.whole) - np.array(self.rest, np.int64)
            return pa.array((off * off).sum(axis=1), pa.int64())
        found = [sum((self.n * (v - w) - r) ** 2 for v, w, r in zip(row, self.whole.tolist(), self.rest, strict=True))
                 for row in x.tolist()]
        return pa.array([v if v < 1 << 63 else None for v in found], pa.int64())


def summed(fits):
    """Fit of the distinct vectors (column x). Sums are kept in two halves of 32 bits, which cannot overflow."""

    def run(batches):
        n, high, low = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            at = np.arange(len(high), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(np.full(len(at), n)), pa.array(high), pa.array(low)],
                names=["at", "n", "high", "low"])

    totals = fits.mapInArrow(run, "at int, n long, high long, low long").groupBy("at").agg(
        *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low"))).orderBy("at").collect()
    return Fit(int(totals[0].n), [(int(r.high) << 32) + int(r.low) for r in totals])


def covariance(fits, fit):
    """Covariance of the distinct vectors: each task adds up products of centred vectors, and row by row
    the tasks' sums are added."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                d = fit.centred(matrix(batch.column(0)))
                total = d.T @ d if total is None else total + d.T @ d
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total))], names=["at", "sums"])

    def add(table):
        rows = matrix(table.column("sums").combine_chunks())
        return pa.table({"at": table.column("at")[:1], "sums": pa.array([rows.sum(axis=0)])})

    schema = "at int, sums array<double>"
    found = fits.mapInArrow(run, schema).groupBy("at").applyInArrow(add, schema).collect()
    v = np.array([r.sums for r in sorted(found, key=lambda r: r.at)]) / fit.n
    return (v + v.T) / 2


def above(v, shift):
    """How many eigenvalues of v lie above the shift, by the inertia of v - shift I (pivots of one or two)."""
    a = v - shift * np.eye(len(v))
    found, bound = 0, (1 + 17**0.5) / 8
    while len(a):
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        i, j = np.unravel_index(int(off.argmax()), off.shape) if len(a) > 1 else (0, 0)
        pivots = [p] if len(a) == 1 or diagonal[p] >= bound * off[i, j] else [int(i), int(j)]
        rest = np.setdiff1d(np.arange(len(a)), pivots)
        if len(pivots) == 1:
            found += a[p, p] > 0
            if a[p, p] == 0:
                break  # all that is left is zero: no eigenvalue above the shift
        else:
            found += 1  # a block of two whose determinant is negative: one on each side
        block, side = a[np.ix_(pivots, pivots)], a[np.ix_(rest, pivots)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
    return int(found)


def counts(spark, v, shifts):
    """Eigenvalues above each shift, a task for each shift."""
    shifts = list(shifts)

    def run(batches):
        for batch in batches:
            at = batch.column(0)
            yield pa.RecordBatch.from_arrays(
                [at, pa.array([above(v, shifts[i]) for i in at.to_pylist()], pa.int64())], names=["at", "n"])

    got = spark.range(0, len(shifts), 1, len(shifts)).mapInArrow(run, "at long, n long").collect()
    return [n for _, n in sorted((r.at, r.n) for r in got)]


def interval(spark, v, k):
    """(low, high, count): an interval with the k largest eigenvalues above rounding, fewer if there are no
    more; its ends lie in gaps of the spectrum, and count is the number of eigenvalues in it."""
    high = float(np.abs(v).sum(axis=1).max()) * 1.01
    if not high > 0:
        return 0.0, 0.0, 0
    low = high * NOTHING * len(v)
    known = dict(zip((low, high), counts(spark, v, (low, high)), strict=True))
    k = min(k, known[low])
    if not k:
        return low, high, 0
    a, b = low, high  # at least k above a, fewer above b
    for _ in range(ROUNDS):
        trial = [a + (b - a) * i / (SHIFTS + 1) for i in range(1, SHIFTS + 1)]
        known |= dict(zip(trial, counts(spark, v, trial), strict=True))
        exact = sorted(s for s, n in known.items() if n == k)
        a = max((s for s, n in known.items() if n > k), default=low)
        b = min(s for s, n in known.items() if n < k)
        # A few shifts in the gap below the k-th eigenvalue: its middle is far from both sides.
        if len(exact) > 3 or b - a <= 1e-14 * high:
            break
    middle = exact[len(exact) // 2] if exact else a
    return middle, min(s for s, n in known.items() if n == 0), known[middle]


def projected(spark, v, basis, low, high):
    """(Ritz values, Ritz vectors): the basis put through the quadrature, a task for each node, and
    Rayleigh-Ritz in the space that comes out."""
    x, weight = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2

    def solve(batches):
        for batch in batches:
            parts = []
            for i in batch.column(0).to_pylist():
                turn = np.exp(1j * np.pi * (1 + x[i]) / 2)
                shifted = (centre + radius * turn) * np.eye(len(v)) - v
                parts.append((weight[i] / 2 * radius * turn * np.linalg.solve(shifted, basis.astype(complex))).real)
            space = sum(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(1, np.int32)), pa.array([space.tobytes()], pa.binary())], names=["one", "space"])

    def ritz(table):
        parts = [np.frombuffer(s.as_buffer(), float).reshape(basis.shape) for s in table.column("space")]
        left, strength, _ = np.linalg.svd(sum(parts), full_matrices=False)
        q = left[:, strength > strength[0] * 1e-14]
        values, turned = np.linalg.eigh(q.T @ v @ q)
        vectors = q @ turned
        return pa.table({"value": values, "vector": pa.array(list(vectors.T))})

    nodes = spark.range(0, NODES, 1, NODES).mapInArrow(solve, "one int, space binary")
    found = nodes.groupBy("one").applyInArrow(ritz, "value double, vector array<double>").collect()
    found.sort(key=lambda r: -r.value)
    return np.array([r.value for r in found]), np.array([r.vector for r in found]).T


def leading(spark, v, k=COMPONENTS):
    """(eigenvalues, falling; unit eigenvectors as columns): the k leading ones, fewer if there are no more."""
    low, high, count = interval(spark, v, k)
    if not count:
        return np.zeros(0), np.zeros((len(v), 0))
    width = min(len(v), 2 * count + 4)
    while True:
        basis, last = np.random.default_rng(13).standard_normal((len(v), width)), np.inf
        for _ in range(REPEATS):
            values, basis = projected(spark, v, basis, low, high)
            inside = (values > low) & (values < high)
            away = v @ basis[:, inside] - basis[:, inside] * values[inside]
            error = np.linalg.norm(away, axis=0).max(initial=0) / high
            if inside.sum() == count and (error <= RESIDUAL or error <= 100 * RESIDUAL and error > last / 4):
                k = min(k, count)
                return values[inside][:k], basis[:, inside][:, :k]
            last = error
        if width == len(v):
            raise ArithmeticError(f"{inside.sum()} of {count} eigenvalues found, residual {error}")
        width = min(len(v), 2 * width)


def identity_error(fits, fit, turn):
    """Largest entry of (covariance of the whitened distinct vectors - identity), from the vectors themselves."""
    k = turn.shape[1]

    def run(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                w = fit.centred(matrix(batch.column(0))) @ turn
                total += np.vstack([w.sum(axis=0), w.T @ w])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "sums"])

    got = fits.mapInArrow(run, "at long, sums double").groupBy("at").agg(F.sum("sums").alias("s")).orderBy("at").collect()
    total = np.array([r.s for r in got]).reshape(k + 1, k) / fit.n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


def whitened(rows, fit, turn, explained, error):
    """The result rows of one vector length."""
    k = turn.shape[1]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            places = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(places), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(places), fit.n)), fit.deviations(x).take(places),
                pa.array((fit.centred(x) @ turn).ravel()), pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(places), error))], names=RESULT_NAMES)

    return rows.select("vec_id", "x").mapInArrow(run, RESULT)


RESULT_NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
RESULT = """vec_id long, component int, n long, deviation long, whitened double, explained double,
    identity_error double"""


def whiten(df, k=COMPONENTS, vector="embedding", key="vec_id"):
    """(key, component, n, deviation, whitened, explained, identity_error): every row's vector in its
    ``k`` leading components."""
    spark = df.sparkSession
    rows = whole_vectors(df, vector, key)
    every = materialize(rows.select("size", "x").distinct(), "fit")
    found = None
    for (size,) in sorted(every.select("size").distinct().collect()):
        fits = every.where(F.col("size") == size).select("x")
        fit = summed(fits)
        v = covariance(fits, fit)
        values, vectors = leading(spark, v, k)
        if not len(values):
            continue
        turn = vectors / np.sqrt(values)
        part = whitened(rows.where(F.col("size") == size), fit, turn, values / np.trace(v), identity_error(fits, fit, turn))
        found = part if found is None else found.unionByName(part)
    found = spark.createDataFrame([], RESULT) if found is None else found
    return found.withColumnRenamed("vec_id", key)
