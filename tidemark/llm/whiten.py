"""Whitening of embeddings by an eigendecomposition that grows row by row.

Every partition holds a count, a mean and a spectrum. A new vector is a centred rank-one update of the covariance: in the basis of
the current eigenvectors it is a diagonal matrix plus ``rho z z'``, whose eigenvalues are the roots of the secular equation; entries of ``z`` that
vanish and equal eigenvalues are deflated. Spectra of partitions are joined by successive rank-one updates, one for each eigenpair of the
other and one for the distance of the means. A pass over all vectors then projects them on the joined basis and solves the small
Rayleigh-Ritz problem there, which brings the components to working precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ready, store

SCALE = 256
COMPONENTS = 4
#: Spectra that one task joins in a round.
FAN = 16
#: Rows of one matrix product.
ROWS = 4096
_EPS = np.finfo(float).eps
_STATE = "part long, n long, mean binary, basis binary, spectrum binary"


# ---- one update

def _roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho * sum(z2 / (d - x))`` for rising distinct ``d``: the pole each root is nearer to, and its distance from it."""
    n = len(d)
    if n == 1:
        return np.zeros(1, np.int64), rho * z2
    top = d[-1] + rho * z2.sum()
    upper = np.append(d[1:], top)
    middle = (d + upper) / 2
    right = 1 + rho * (z2 / (d[None, :] - middle[:, None])).sum(axis=1) <= 0  # the root lies beyond the middle
    right[-1] = False  # above the last pole there is no other
    pole = np.arange(n) + right
    gap = d[None, :] - d[pole][:, None]  # distances of all poles from the origin of each root
    low = np.where(right, (d - upper) / 2, 0.0)
    high = np.where(right, 0.0, (upper - d) / 2)
    high[-1] = upper[-1] - d[-1]
    rows = np.arange(n)
    left, here = np.tril(np.ones((n, n), bool)), rho * z2
    after = np.minimum(rows + 1, n - 1)
    x = (low + high) / 2
    for _ in range(80):
        away = gap - x[:, None]
        part = here / away
        below, above = np.where(left, part, 0).sum(axis=1), np.where(left, 0, part).sum(axis=1)
        f = 1 + below + above
        low, high = np.where(f < 0, x, low), np.where(f >= 0, x, high)
        done = np.abs(f) <= 4 * _EPS * n * (1 + np.abs(below) + np.abs(above))
        if (done | (high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high)))).all():
            break
        # both halves as simple fractions with the right value and slope: a quadratic for the step
        slope = part / away
        one, two = away[rows, rows], away[rows, after]
        s_low, s_up = np.where(left, slope, 0).sum(axis=1), np.where(left, 0, slope).sum(axis=1)
        rest = f - one * s_low - np.where(rows < n - 1, two * s_up, 0.0)
        a = np.where(rows < n - 1, rest, f - one * s_low)
        p, q = one**2 * s_low, np.where(rows < n - 1, two**2 * s_up, 0.0)
        # a + p / (one - t) + q / (two - t) = 0
        b = a * (one + two) + p + q
        c = a * one * two + p * two + q * one
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(b * b - 4 * a * c, 0))
            t = np.where(b >= 0, 2 * c / (b + root), (b - root) / (2 * a))
            t = np.where(rows == n - 1, np.where(a > 0, one + p / a, np.nan), t)
        new = x + t
        ok = np.isfinite(new) & (new > low) & (new < high)
        x = np.where(done, x, np.where(ok, new, (low + high) / 2))
    return pole, x


def rank_one(spectrum: np.ndarray, basis: np.ndarray, vector: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (rising) and basis (columns) of ``basis diag(spectrum) basis' + rho vector vector'``, ``rho`` above 0."""
    z = basis.T @ vector
    size = float(np.sqrt(z @ z))
    if rho <= 0 or size == 0:
        return spectrum, basis
    z, rho = z / size, rho * size * size
    tol = 8 * _EPS * max(abs(spectrum[-1]), abs(spectrum[0]), rho)
    keep = rho * np.abs(z) > tol  # other entries leave their eigenpair as it is
    d, basis = spectrum.copy(), basis.copy()
    live = np.flatnonzero(keep)
    last = None
    for i in live[np.append(False, np.diff(d[live]) <= tol)] if len(live) > 1 else []:
        # equal eigenvalues: turn their plane so that one of the two leaves the update
        last = live[np.searchsorted(live, i) - 1]
        r = np.hypot(z[last], z[i])
        c, s = z[i] / r, z[last] / r
        basis[:, last], basis[:, i] = c * basis[:, last] - s * basis[:, i], s * basis[:, last] + c * basis[:, i]
        z[i], z[last], keep[last] = r, 0.0, False
    live = np.flatnonzero(keep)
    if not len(live):
        return d, basis
    own, weight = d[live], z[live]
    pole, x = _roots(own, weight**2, rho)
    away = (own[None, :] - own[pole][:, None]) - x[:, None]  # pole j minus root i
    # weights for which these roots are exact: the vectors then are orthogonal to working precision
    between = own[None, :] - own[:, None]
    np.fill_diagonal(between, 1.0)
    fit = np.sqrt(np.abs(np.prod(away / between.T, axis=0) / rho)) * np.where(weight < 0, -1.0, 1.0)
    turn = fit[None, :] / away
    turn /= np.sqrt((turn**2).sum(axis=1))[:, None]
    basis[:, live] = basis[:, live] @ turn.T
    d[live] = own[pole] + x
    order = np.argsort(d, kind="stable")
    return d[order], basis[:, order]


@dataclass
class Spectrum:
    """Count, mean, and eigenpairs of the scatter (the covariance times the count) of some vectors."""

    n: int
    mean: np.ndarray
    basis: np.ndarray
    scatter: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Spectrum:
        return cls(0, np.zeros(width), np.eye(width), np.zeros(width))

    def add(self, vector: np.ndarray) -> None:
        apart = vector - self.mean
        if self.n:
            self.scatter, self.basis = rank_one(self.scatter, self.basis, apart, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + apart / self.n

    def join(self, other: Spectrum) -> None:
        if not other.n:
            return
        apart, n = other.mean - self.mean, self.n + other.n
        for value, vector in zip(other.scatter, other.basis.T, strict=True):
            self.scatter, self.basis = rank_one(self.scatter, self.basis, vector, float(value))
        if self.n:
            self.scatter, self.basis = rank_one(self.scatter, self.basis, apart, self.n * other.n / n)
        self.mean = self.mean + apart * (other.n / n)
        self.n = n
        self.basis = np.linalg.qr(self.basis)[0]  # rounding of many turns

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "mean": self.mean.tobytes(), "basis": self.basis.tobytes(), "spectrum": self.scatter.tobytes()}

    @classmethod
    def of(cls, row) -> Spectrum:
        mean = np.frombuffer(row["mean"])
        return cls(int(row["n"]), mean, np.frombuffer(row["basis"]).reshape(len(mean), -1), np.frombuffer(row["spectrum"]))


# ---- over partitions

def _matrix(column: pa.Array, kind) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _grow(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Spectrum.empty(width)
        for batch in batches:
            for vector in _matrix(batch.column("x"), float):
                state.add(vector)
        if state.n:
            yield pa.RecordBatch.from_pylist([state.row(0)], pa.schema([("part", pa.int64()), ("n", pa.int64()), *[(c, pa.binary()) for c in ("mean", "basis", "spectrum")]]))

    return run


def _joined(rows: pd.DataFrame) -> pd.DataFrame:
    first, *others = [Spectrum.of(r) for r in rows.sort_values("part").to_dict("records")]
    for other in others:
        first.join(other)
    return pd.DataFrame([first.row(int(rows["part"].iloc[0]) // FAN)])


def spectrum_of(fit: DataFrame, width: int) -> Spectrum:
    """The spectrum of all rows ``x`` of ``fit``: every partition grows its own, ``FAN`` at a time are joined until one is left."""
    parts = fit.mapInArrow(_grow(width), _STATE).withColumn("part", F.spark_partition_id().cast("long"))
    parts = store(parts, "spectra")
    while parts.count() > 1:
        parts = store(parts.groupBy(F.floor(F.col("part") / FAN).alias("_group")).applyInPandas(_joined, _STATE), "spectra")
    return Spectrum.of(parts.first())


def _sums(width: int, products):
    """Arrow pass: one row a task with the sum of ``products(x)`` over blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            rows = _matrix(batch.column("x"), np.int64)
            for at in range(0, len(rows), ROWS):
                part = products(rows[at : at + ROWS])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], ["sums"])

    return run


def _total(fit: DataFrame, width: int, products, kind: str) -> list:
    """Sums over all rows, added up in two steps so that the driver receives one row."""
    parts = fit.mapInArrow(_sums(width, products), f"sums array<{kind}>")
    wide = "decimal(38,0)" if kind == "bigint" else "double"
    each = parts.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast(wide)).alias("v"))
    found = each.orderBy("at").collect()  # width or width * width numbers
    return [int(r["v"]) if kind == "bigint" else float(r["v"]) for r in found]


@dataclass
class Whitening:
    """Components by falling eigenvalue (rows), and the exact count and sums of the fit list."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; a component without variance has none (NaN)."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = _centred(x, self.n, self.sums) @ self.components.T / np.sqrt(self.values)
        out[:, self.values <= 0] = np.nan
        return out


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - S / n``, where whole parts cancel before anything is rounded."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole) - np.array([(s % n) / n for s in sums])


def whole_vectors(table: DataFrame) -> DataFrame:
    """``vec_id, x``: rows whose vector has only finite entries, each as ``floor(256 c)``. Null and empty vectors go."""
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    good = good & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return table.where(good).select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("x"))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of the distinct vectors ``x``; None without vectors. Vectors of different lengths are an error.

    The fit list is written once; every pass reads all of it. The driver receives sums, one spectrum and one small matrix.
    """
    spark = ready(vectors.sparkSession)
    distinct = store(vectors.select("x").distinct(), "fit-list")
    shortest, longest, n = distinct.agg(F.min(F.size("x")), F.max(F.size("x")), F.count("*")).first()
    if not n:
        return None
    if shortest != longest:
        raise ValueError(f"vectors have {shortest} to {longest} entries")
    width = longest
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    state = spectrum_of(distinct.repartition(tasks, F.xxhash64("x")), width)
    sums = _total(distinct, width, lambda rows: rows.sum(axis=0), "bigint")
    basis = np.linalg.qr(state.basis[:, ::-1])[0]

    def projected(rows: np.ndarray) -> np.ndarray:
        y = _centred(rows, n, sums) @ basis
        return y.T @ y

    small = np.array(_total(distinct, width, projected, "double")).reshape(width, width) / n
    values, turn = np.linalg.eigh((small + small.T) / 2)
    first = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(small))
    vectors_ = (basis @ turn[:, first]).T
    vectors_ *= np.where(vectors_[np.arange(len(first)), np.abs(vectors_).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    kept = np.where(values[first] > trace * 64 * _EPS, values[first], 0.0)
    out = Whitening(int(n), sums, vectors_, kept, trace, 0.0)
    live = np.flatnonzero(kept > 0)
    if len(live):
        def whitened(rows: np.ndarray) -> np.ndarray:
            w = out.project(rows)[:, live]
            return np.append(w.T @ w, w.sum(axis=0)[None], axis=0)

        both = np.array(_total(distinct, width, whitened, "double")).reshape(len(live) + 1, len(live)) / n
        covariance = both[:-1] - np.outer(both[-1], both[-1])
        out.identity_error = float(np.abs(covariance - np.eye(len(live))).max())
    return out


def _whiten(model: Whitening):
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        explained = model.values / model.trace if model.trace > 0 else np.zeros(k)
        for batch in batches:
            rows = _matrix(batch.column("x"), np.int64)
            m = len(rows)
            if not m:
                continue
            apart = rows.astype(object) * model.n - np.array(model.sums, object)
            deviation = [int(v) for v in (apart * apart).sum(axis=1)]
            white = model.project(rows)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, model.n)), pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                pa.array(white.ravel(), pa.float64(), from_pandas=True), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error)),
            ], names)

    return run


def whiten(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, one row per vector and component (as many as there are, to ``components``).

    Rows whose vector is null, empty, or holds a null or a value that is not finite give no row. Copies of a vector count once in the fit; rows that repeat or
    lack a vec_id all come out. A component without variance (all of them for a single distinct vector) has a null ``whitened`` and explains 0;
    ``identity_error`` is then that of the others. Of eigenvectors the largest entry is positive. A deviation beyond 64 bits is an
    error, not a wrong number. Other columns are not touched. An empty table gives no row.
    """
    vectors = whole_vectors(table)
    model = fit(vectors, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(_whiten(model), schema)
