"""Whitening of embeddings by an eigendecomposition that grows by rank-one updates.

The spectrum of a set of vectors is its count, its mean, and the eigenvalues and eigenvectors of its
scatter matrix (the sum of centred outer products). One more vector adds a multiple of one outer product
of its centred self; the new eigenvalues are the roots of a secular equation, the new eigenvectors follow
from them. Each task starts several spectra and feeds them the rows of its partition, a vector to each in
a step. Two spectra combine by the rank-one updates that the eigenpairs of one are to the other, and one
more for the distance of the means. Spectra of partitions meet in groups of ``FAN``, round by round, so
no task and not the driver ever sees more than a few of them. A Rayleigh-Ritz pass over all rows then
refines the leading eigenvectors against the covariance itself; directions that the residuals show to be
missing join the basis, so the result doesn't rest on the rounding of a million updates.

Vectors that are null, empty, or hold null or non-finite entries (or entries beyond 2^45) are dropped, and
so are vectors of another length than most have (ties: the longer). An empty table gives no rows. Equal
vectors count once in the fit, so a third of all rows may be one vector. A component without variance has
``whitened`` null and ``explained`` 0; where all variance is 0, so is every component's. Rows with null or
repeated ids are returned as they are. The order of eigenvectors of equal eigenvalues is open. Columns
besides the two that are named are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import forget, written

#: Spectra that meet in one task of a round.
FAN = 8
#: Vectors that a spectrum gets at least before another one is worth its combination, and spectra of a task at most.
STREAM, LANES = 512, 16
#: Directions besides the wanted ones in the Rayleigh-Ritz basis, and the residual, against the largest eigenvalue, that ends it.
SPARE, RESIDUAL = 8, 1e-12
_EPS = np.finfo(float).eps


# --- rank-one updates, many at once -------------------------------------------------------------


def _rotate_equal(d: np.ndarray, z: np.ndarray, u: np.ndarray, tol: np.ndarray) -> None:
    """Deflation of equal eigenvalues: rotations in the plane of two neighbours move all of ``z`` to the later one."""
    for i in np.flatnonzero((np.diff(d, axis=1) <= tol[:, None]).any(axis=0)):
        rows = np.flatnonzero((d[:, i + 1] - d[:, i] <= tol) & (z[:, i] != 0))
        if not len(rows):
            continue
        a, b = z[rows, i], z[rows, i + 1]
        r = np.hypot(a, b)
        c, s = (b / r)[:, None], (a / r)[:, None]
        left, right = u[rows, :, i], u[rows, :, i + 1]
        u[rows, :, i], u[rows, :, i + 1] = c * left - s * right, s * left + c * right
        z[rows, i], z[rows, i + 1] = 0.0, r


def _roots(d: np.ndarray, w: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(w / (d - x)), one after each of the first ``k`` poles of a row: the pole each is nearest to, and its distance from it.

    Each step fits a function with the two poles around the root to the sums left and right of it and
    takes that function's root; a step that leaves the bracket is a bisection instead.
    """
    lanes, m = d.shape
    place = np.arange(m)
    mine = (place[None, :] < k[:, None]).ravel()
    last = (place[None, :] >= k[:, None] - 1).ravel()
    upper = np.where(last, (d + w.sum(axis=1)[:, None]).ravel(), np.concatenate([d[:, 1:], d[:, -1:]], axis=1).ravel())
    lower = d.ravel()
    half = (upper - lower) / 2
    with np.errstate(all="ignore"):
        right_half = (1 + np.einsum("lk,ljk->lj", w, 1 / (d[:, None, :] - (lower + half).reshape(lanes, m, 1)))).ravel() < 0
        from_left = ~right_half | last
        origin = np.where(from_left, lower, upper)
        low = np.where(from_left, np.where(right_half, half, 0.0), -half)
        high = np.where(from_left, np.where(right_half, 2 * half, half), 0.0)
        tau = (low + high) / 2
        # Only the roots that are still open are carried on.
        left = np.flatnonzero(mine)
        lane, before = left // m, (place[None, :] <= (left % m)[:, None]).astype(float)
        shifted, weights = d[lane] - origin[left, None], w[lane]
        t, lo, hi, dl, du = tau[left], low[left], high[left], (lower - origin)[left], (upper - origin)[left]
        for _ in range(80):
            term = 1 / (shifted - t[:, None])
            slope = term * term * weights
            term *= weights
            total, dtotal = term.sum(axis=1), slope.sum(axis=1)
            psi, dpsi = np.einsum("ij,ij->i", term, before), np.einsum("ij,ij->i", slope, before)
            phi, dphi = total - psi, dtotal - dpsi
            f = 1 + total
            lo, hi = np.where(f < 0, t, lo), np.where(f < 0, hi, t)
            done = (np.abs(f) <= 4 * _EPS * (1 + np.abs(psi) + np.abs(phi))) | (hi - lo <= 2 * _EPS * np.abs(t))
            to_left, to_right = dl - t, du - t
            c = f - to_left * dpsi - to_right * dphi
            a = (to_left + to_right) * f - to_left * to_right * dtotal
            b = to_left * to_right * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            new = t + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            t = np.where(done, t, np.where((new > lo) & (new < hi), new, (lo + hi) / 2))
            tau[left] = t
            if done.all():
                break
            if done.mean() > 0.25:
                on = ~done
                left, before, shifted, weights, t, lo, hi, dl, du = (x[on] for x in (left, before, shifted, weights, t, lo, hi, dl, du))
    origin, tau = origin.reshape(lanes, m), tau.reshape(lanes, m)
    return origin, tau


def rank_one(d: np.ndarray, u: np.ndarray, v: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of ``u diag(d) u' + weight v v'`` for each lane: d (L, m), u (L, m, m), v (L, m), weight (L) of 0 or more.

    Entries of the update that don't matter and equal eigenvalues are deflated: their eigenpairs stay. The
    update is taken anew from the roots before the eigenvectors are worked out, so these are orthogonal
    even where roots lie close to poles.
    """
    lanes, m = d.shape
    u = u.copy()
    z = np.einsum("lij,li->lj", u, v) * np.sqrt(weight)[:, None]
    tol = 8 * _EPS * np.maximum(np.abs(d).max(axis=1), (z * z).sum(axis=1))
    z[z * z <= _EPS * tol[:, None] / 8] = 0.0
    _rotate_equal(d, z, u, tol)
    active = z != 0
    k = active.sum(axis=1)
    order = np.argsort(np.where(active, d, np.inf), axis=1, kind="stable")
    take = lambda x: np.take_along_axis(x, order, axis=1)
    poles, zs, on = take(d), take(z), np.arange(m)[None, :] < k[:, None]
    u = np.take_along_axis(u, order[:, None, :], axis=2)
    dp = np.where(on, poles, 0.0)
    w = np.where(on, zs * zs, 0.0)
    # Poles that are out stand far off, with no weight, and never come into a sum.
    far = np.where(on, dp, (dp.max(axis=1) + w.sum(axis=1) + 1)[:, None] * 4)
    origin, tau = _roots(far, w, k)
    both = on[:, :, None] & on[:, None, :]
    with np.errstate(all="ignore"):
        gap = far[:, None, :] - origin[:, :, None] - tau[:, :, None]  # [root j, pole i]: d_i - x_j
        # Products of (x_j - d_i) over the gaps to the other poles: pole j before i pairs with root j, pole j + 1 after it.
        between = far[:, None, :] - far[:, :, None]  # [j, i]: d_i - d_j
        shifted = np.concatenate([between[:, 1:, :], np.ones((lanes, 1, m))], axis=1)
        j, i = np.arange(m)[:, None], np.arange(m)[None, :]
        ends = (j == (k - 1)[:, None, None]) & (j >= i)
        ratio = np.where(both, gap / np.where(ends, -1.0, np.where(j < i, between, shifted)), 1.0)
        new_z = np.sqrt(np.abs(np.prod(ratio, axis=1)))
        new_z = np.where(on, np.copysign(new_z, zs), 0.0)
        vec = np.where(both, new_z[:, None, :] / gap, 0.0)
        vec /= np.sqrt((vec * vec).sum(axis=2, keepdims=True))
    vec = np.where(on[:, :, None], vec, np.eye(m)[None])
    values = np.where(on, origin + tau, poles)
    rise = np.argsort(values, axis=1, kind="stable")
    vec = np.take_along_axis(vec, rise[:, :, None], axis=1)
    return np.take_along_axis(values, rise, axis=1), u @ vec.transpose(0, 2, 1)


class Spectra:
    """Lanes of spectra: counts, means, eigenvalues and eigenvectors of the scatter matrices."""

    def __init__(self, lanes: int, m: int) -> None:
        self.n = np.zeros(lanes)
        self.mean = np.zeros((lanes, m))
        self.values = np.zeros((lanes, m))
        self.vectors = np.broadcast_to(np.eye(m), (lanes, m, m)).copy()

    def add(self, x: np.ndarray) -> None:
        """One vector to each of the first ``len(x)`` lanes."""
        s = slice(0, len(x))
        away = x - self.mean[s]
        self.values[s], self.vectors[s] = rank_one(self.values[s], self.vectors[s], away, self.n[s] / (self.n[s] + 1))
        self.n[s] += 1
        self.mean[s] += away / self.n[s, None]

    def fold(self) -> None:
        """The second half of the lanes into the first, until one is left."""
        while len(self.n) > 1:
            half = -(-len(self.n) // 2)
            pairs = len(self.n) - half
            n, other = self.n[:pairs], self.n[half:]
            values, vectors = self.values[:pairs], self.vectors[:pairs]
            for i in range(self.values.shape[1]):
                values, vectors = rank_one(values, vectors, self.vectors[half:, :, i], np.maximum(self.values[half:, i], 0.0))
            away, total = self.mean[half:] - self.mean[:pairs], np.maximum(n + other, 1)
            values, vectors = rank_one(values, vectors, away, n * other / total)
            self.mean[:pairs] += away * (other / total)[:, None]
            self.values[:pairs], self.vectors[:pairs], self.n[:pairs] = values, vectors, n + other
            self.n, self.mean, self.values, self.vectors = self.n[:half], self.mean[:half], self.values[:half], self.vectors[:half]

    @staticmethod
    def of(parts: list[tuple[float, np.ndarray]], m: int) -> Spectra:
        out = Spectra(len(parts), m)
        for i, (n, flat) in enumerate(parts):
            out.n[i], out.mean[i], out.values[i], out.vectors[i] = n, flat[:m], flat[m : 2 * m], flat[2 * m :].reshape(m, m)
        return out

    def batch(self, place: int) -> pa.RecordBatch:
        flat = np.concatenate([self.mean[0], self.values[0], self.vectors[0].ravel()])
        return pa.record_batch([pa.array([place], pa.int64()), pa.array([self.n[0]]), pa.array([flat])], names=["place", "n", "flat"])


_SPECTRUM = "place long, n double, flat array<double>"


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _spectrum_of(m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId()
        out = None
        for b in batches:
            x = _matrix(b.column(0)).astype(float)
            if out is None and len(x):
                out = Spectra(min(LANES, max(1, len(x) // STREAM)), m)
            for i in range(0, len(x), len(out.n) if out else 1):
                out.add(x[i : i + len(out.n)])
        if out is not None:
            out.fold()
            yield out.batch(place)

    return run


def _combined(m: int):
    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("place").to_numpy(), kind="stable")
        n, flat = t.column("n").to_numpy(), t.column("flat").combine_chunks()
        out = Spectra.of([(n[i], flat[i].values.to_numpy(zero_copy_only=False)) for i in order], m)
        out.fold()
        return pa.Table.from_batches([out.batch(t.column("place")[0].as_py() // FAN)])

    return run


def fit_spectrum(fit: DataFrame, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues of the scatter matrix of ``fit(x)``, and eigenvectors as columns; one m x m matrix comes to the driver."""
    state = written(fit.select("x").mapInArrow(_spectrum_of(m), _SPECTRUM), "spectra")
    last = state.agg(F.max("place")).first()[0]  # one number
    while last > 0:
        last //= FAN
        group = F.floor(F.col("place") / FAN).cast("long").alias("g")
        new = written(state.groupBy(group).applyInArrow(_combined(m), _SPECTRUM), "spectra")
        forget(state)
        state = new
    row = state.first()
    forget(state)
    flat = np.array(row["flat"])
    return flat[m : 2 * m][::-1], flat[2 * m :].reshape(m, m)[:, ::-1]


# --- Rayleigh-Ritz -------------------------------------------------------------------------------


def _applied(fit: DataFrame, centre: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The covariance of ``fit`` times ``basis``; tasks return sums of ``basis``'s size, which Spark adds up."""
    m, p = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((m, p)), 0
        for b in batches:
            away = _matrix(b.column(0)) - centre
            total += away.T @ (away @ basis)
            n += len(away)
        if n:
            yield pa.record_batch([pa.array(np.arange(m * p)), pa.array(total.ravel()), pa.array(np.full(m * p, n))], names=["cell", "s", "n"])

    sums = fit.select("x").mapInArrow(run, "cell long, s double, n long").groupBy("cell").agg((F.sum("s") / F.sum("n")).alias("s"))
    out = np.zeros(m * p)
    for row in sums.collect():  # m x p numbers
        out[row["cell"]] = row["s"]
    return out.reshape(m, p)


def refine(fit: DataFrame, centre: np.ndarray, basis: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues and eigenvectors of the covariance by Rayleigh-Ritz passes over all rows.

    A pass gives the covariance's action on the basis, from which come the Ritz pairs and their residuals.
    While a wanted pair's residual is too large, the residuals join the basis; it has m directions at most,
    and with all of them the pairs are exact.
    """
    m = len(centre)
    while True:
        moved = _applied(fit, centre, basis)
        inner = basis.T @ moved
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        pairs, rest = basis @ turn, moved @ turn - (basis @ turn) * values
        worst = np.linalg.norm(rest[:, :wanted], axis=0).max()
        if worst <= RESIDUAL * max(values[0], 0.0) or basis.shape[1] == m:
            return values[:wanted], pairs[:, :wanted]
        rest -= pairs @ (pairs.T @ rest)
        more, size, _ = np.linalg.svd(rest, full_matrices=False)
        more = more[:, size > RESIDUAL * size[0]][:, : m - basis.shape[1]]
        basis, _ = np.linalg.qr(np.hstack([pairs, more - pairs @ (pairs.T @ more)]))


# --- the operator --------------------------------------------------------------------------------


def scaled_vectors(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``key, x``: rows with usable vectors, whose entries become the whole numbers ``floor(scale * entry)``."""
    c = F.col(vector)
    usable = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float(2**45))
    rows = embeddings.select(F.col(key).alias("vec_id"), F.transform(c, lambda e: e.cast("double")).alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(F.forall("v", lambda e: F.coalesce(usable(e), F.lit(False))))
    return rows.select("vec_id", F.transform("v", lambda e: F.floor(e * scale)).alias("x"))


def whiten(embeddings: DataFrame, components: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: the leading components of each usable row.

    ``deviation``, the squared length of n times the centred vector, is an exact ``decimal(38, 0)``.
    ``identity_error`` is measured on the fit's whitened vectors, over components that have variance.
    """
    spark = embeddings.sparkSession
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = scaled_vectors(embeddings, key, vector)
    length = rows.groupBy(F.size("x").alias("m")).agg(F.count("*").alias("k")).agg(F.max_by("m", F.struct("k", "m"))).first()[0]  # one number
    if length is None:
        return spark.range(0).selectExpr(*(f"CAST(NULL AS {t}) AS {c}" for c, t in (x.split(" ") for x in schema.split(", ")))).filter(F.lit(False))
    rows = rows.filter(F.size("x") == length)
    fit = written(rows.select("x").distinct(), "fit")
    places = fit.select(F.posexplode("x").alias("i", "e")).groupBy("i").agg(F.sum("e").alias("s"), F.count("*").alias("n"), F.sum(F.col("e").cast("decimal(38,0)") * F.col("e")).alias("q"))
    sums = sorted(places.collect(), key=lambda r: r["i"])  # a row for each dimension
    n, s = sums[0]["n"], [r["s"] for r in sums]
    centre = np.array([float(x) for x in s]) / n
    trace = float(sum(int(r["q"]) * n - r["s"] ** 2 for r in sums)) / float(n) ** 2
    wanted = min(components, length)
    _, vectors = fit_spectrum(fit, length)
    values, directions = refine(fit, centre, vectors[:, : min(length, wanted + SPARE)], wanted)
    real = values > length * _EPS * max(trace, 0.0)
    axes = directions / np.sqrt(np.where(real, values, 1.0))
    white = axes[:, real].T @ _applied(fit, centre, axes[:, real]) if real.any() else np.zeros((0, 0))
    error = float(np.abs(white - np.eye(len(white))).max(initial=0.0))
    shares = [float(v / trace) if ok else 0.0 for v, ok in zip(values, real, strict=True)]
    total = np.array(s, dtype=object)
    bound = max(abs(x) for x in s) + 1

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for b in batches:
            x = _matrix(b.column(1))
            if not len(x):
                continue
            # Whole numbers of 64 bits where nothing can overflow, else Python's.
            top = n * int(np.abs(x).max(initial=0)) + bound
            away = x * n - total.astype(np.int64) if length * top * top < 2**62 else x.astype(object) * n - total
            deviation = [Decimal(int(v)) for v in (away * away).sum(axis=1)]
            w = (x - centre) @ axes
            out = np.repeat(np.arange(len(x)), wanted)
            which = np.tile(np.arange(wanted), len(x))
            yield pa.record_batch(
                [
                    b.column(0).take(pa.array(out)), pa.array(which + 1, pa.int32()), pa.array(np.full(len(out), n)), pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(out)),
                    pa.array(w.ravel(), mask=~real[which]), pa.array(np.array(shares)[which]), pa.array(np.full(len(out), error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select(F.col("vec_id").cast("long"), "x").mapInArrow(project, schema)
