"""Whitening of vectors: every principal direction rescaled to unit variance.

Rows with a null vector or a null or non-finite entry are dropped; every other vector takes part. Entries become whole numbers
x = floor(scale * c) + offset. One pass counts the rows and sums each dimension, exactly. A second sums the products of the
entries, each entry centred first on the whole part of its mean; the remainder, below one, is taken off afterwards in whole
numbers, so that the covariance is the correctly rounded one whatever order the tasks end in. Matrix products run on doubles,
over as many rows at a time as keep every sum below 2^53, where doubles are whole. (Where entries spread over more than 2^40 no such
sum is whole, and sums of doubles serve.)

The matrix, of the width of a vector, is reduced to tridiagonal form by Householder reflections; bisection on Sturm counts
finds its leading eigenvalues; inverse iteration finds their vectors, where vectors of close eigenvalues are made
orthogonal again. The directions, of bounded size, go to all tasks, which project their rows.

A row keeps its id, null or repeated, and repeated rows all count. A vector shorter than the longest is filled up with zeros,
an empty one too. Directions without variance have no whitened value: as many components come back as the covariance has
rank, at most `most`; an empty table, or one of equal vectors, gives an empty result. Equal eigenvalues leave a choice of directions;
any orthogonal ones serve. A direction's sign is that in which its largest entry is positive. Extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pick

EXACT = 2**53      # doubles hold every whole number up to here
WIDEST = 2**40     # entries farther than this from their mean are summed as doubles
EPS = np.finfo(np.float64).eps


def entries(vectors: DataFrame, scale: int, offset: int) -> DataFrame:
    """Rows (id, x) of the vectors that take part, entries as whole numbers.

    An entry too large for a long counts as not finite."""
    rows = vectors.where("v is not null").withColumn("v", F.col("v").cast("array<double>"))
    rows = rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**62 / scale)))
    return rows.select("id", F.transform("v", lambda c: F.floor(c * scale) + offset).alias("x"))


def matrix(column: pa.Array, width: int, fill: int) -> np.ndarray:
    """Lists of longs as the rows of a matrix; shorter ones are filled up."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.full((len(column), width), fill, np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


@dataclass(frozen=True)
class Centre:
    """Number of rows and the sum of each dimension."""

    n: int
    sums: tuple[int, ...]
    spread: int  # no entry is farther from the whole part of its mean

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        return [s % self.n for s in self.sums]


def centre(rows: DataFrame, offset: int) -> Centre | None:
    """Exact sums by dimension: one row for each task and dimension is shuffled."""
    def add(batches: Iterator[pa.RecordBatch]):
        n, sums, low, high = 0, [], [], []
        for batch in batches:
            width = max(len(sums), max((len(v) for v in batch.column(0)), default=0))
            x = matrix(batch.column(0), width, offset)
            if not len(x):
                continue
            grow = width - len(sums)
            sums += [n * offset] * grow  # rows so far were shorter
            low += [offset if n else 2**63] * grow
            high += [offset if n else -2**63] * grow
            n += len(x)
            # halves of 32 bits: their sums fit in a long
            tops, ends = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            sums = [s + (int(t) << 32) + int(e) for s, t, e in zip(sums, tops, ends, strict=True)]
            low = [min(a, int(b)) for a, b in zip(low, x.min(axis=0), strict=True)]
            high = [max(a, int(b)) for a, b in zip(high, x.max(axis=0), strict=True)]
        yield pa.RecordBatch.from_pydict(
            {"i": range(-1, len(sums)), "n": [n] * (len(sums) + 1), "s": [Decimal(s) for s in (0, *sums)], "low": [0, *low], "high": [0, *high]},
            pa.schema([("i", pa.int32()), ("n", pa.int64()), ("s", pa.decimal128(38, 0)), ("low", pa.int64()), ("high", pa.int64())]))

    parts = rows.select("x").mapInArrow(add, "i int, n long, s decimal(38,0), low long, high long")
    found = {r["i"]: r for r in parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    n = found[-1]["n"] if found else 0
    if not n or len(found) == 1:
        return None
    dims = [found[i] for i in range(len(found) - 1)]
    sums = tuple(int(d["s"]) + (n - d["n"]) * offset for d in dims)  # tasks with shorter vectors only
    ends = [(min(d["low"], offset), max(d["high"], offset)) if d["n"] < n else (d["low"], d["high"]) for d in dims]
    return Centre(n, sums, max(max(h - s // n, s // n - lo) for s, (lo, h) in zip(sums, ends, strict=True)))


def product_sums(rows: DataFrame, width: int, made, kind: str) -> np.ndarray:
    """Sum over all rows of v v' and, in the last row, of v, for v = made(batch column); one partial matrix a task."""
    decimal = kind != "double"

    def add(batches: Iterator[pa.RecordBatch]):
        total = None
        for batch in batches:
            for part in made(batch.column(0)):
                total = part if total is None else total + part
        if total is None:
            return
        at = np.indices(total.shape).reshape(2, -1).astype(np.int32)
        values = [Decimal(int(t)) for t in total.ravel()] if decimal else total.ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[0]), pa.array(at[1]), pa.array(values, pa.decimal128(38, 0) if decimal else pa.float64())], names=["i", "j", "s"])

    parts = rows.select("x").mapInArrow(add, f"i int, j int, s {kind}")
    out = np.zeros((width + 1, width), object if decimal else np.float64)
    for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = int(r["s"]) if decimal else r["s"]
    return out


def covariance(rows: DataFrame, about: Centre, offset: int) -> np.ndarray:
    """Covariance with divisor n, correctly rounded where entries spread over no more than 2^40."""
    whole, d, n = about.whole, len(about.sums), about.n
    exact = about.spread <= WIDEST
    high = about.spread >> 20 > 0  # entries are cut into a part above and one below 2^20

    def whole_products(column):
        x = matrix(column, d, offset) - whole
        if not exact:
            v = x.astype(np.float64) - np.array(about.rest) / n
            yield np.vstack([v.T @ v, v.sum(axis=0)])
            return
        pieces = [(x, 0)] if not high else [(x & 0xFFFFF, 0), (x >> 20, 20)]
        for a, p in pieces:
            for b, q in pieces:
                size = max(1, int(np.abs(a).max(initial=1)) * int(np.abs(b).max(initial=1)))
                step = max(1, EXACT // size)
                for s in range(0, len(x), step):
                    part = a[s:s + step].T.astype(np.float64) @ b[s:s + step].astype(np.float64)
                    yield np.vstack([part, np.zeros(d)]).astype(np.int64).astype(object) * (1 << (p + q))

    sums = product_sums(rows, d, whole_products, "decimal(38,0)" if exact else "double")[:d]
    if not exact:
        return (sums + sums.T) / 2 / n
    rest = about.rest
    return np.array([[float(Fraction(n * int(sums[i, j]) - rest[i] * rest[j], n * n)) for j in range(d)] for i in range(d)])


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder reflections: diagonal, off-diagonal and the unit vectors reflected at (below each column)."""
    a, mirrors = a.copy(), []
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        rest = np.abs(v[1:]).max()
        if rest == 0:
            mirrors.append(np.zeros(len(v)))
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        below = a[k + 1:, k + 1:]
        p = 2 * below @ v
        w = p - (v @ p) * v
        below -= np.outer(v, w) + np.outer(w, v)
        a[k + 1, k], a[k + 2:, k] = -np.copysign(size, a[k + 1, k]), 0
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def below(diag: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm count: the number of eigenvalues below each x."""
    tiny = np.finfo(np.float64).tiny / EPS * max(1.0, float((off**2).max(initial=0)))
    q, count = np.full(x.shape, 1.0), np.zeros(x.shape, np.int64)
    for i in range(len(diag)):
        q = diag[i] - x - (off[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diag: np.ndarray, off: np.ndarray, most: int) -> np.ndarray:
    """The largest eigenvalues, falling, each bisected until its interval has no double inside."""
    d = len(diag)
    radius = np.abs(np.concatenate([[0], off])) + np.abs(np.concatenate([off, [0]]))
    reach = max(float(np.abs(diag).max() + radius.max()), np.finfo(np.float64).tiny)
    low, high = np.full(min(most, d), (diag - radius).min() - reach * EPS * d), np.full(min(most, d), (diag + radius).max() + reach * EPS * d)
    wanted = d - np.arange(len(low))  # the k-th largest has d - k + 1 eigenvalues at or below it
    for _ in range(200):
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        small = below(diag, off, middle) < wanted
        low, high = np.where(small, middle, low), np.where(small, high, middle)
    return low + (high - low) / 2


def solve_shifted(diag: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """Solve (T - shift) y = b by elimination with row exchanges; zero pivots become tiny."""
    n = len(diag)
    main, up, up2, y = (diag - shift).copy(), np.append(off, 0.0), np.zeros(n), b.copy()
    for i in range(n - 1):
        under = off[i]
        if abs(under) > abs(main[i]):
            old, old_up = main[i], up[i]
            main[i], up[i], up2[i] = under, main[i + 1], up[i + 1]
            factor = old / under
            main[i + 1], up[i + 1] = old_up - factor * up[i], -factor * up2[i]
            y[i], y[i + 1] = y[i + 1], y[i] - factor * y[i + 1]
        else:
            if abs(main[i]) < tiny:
                main[i] = tiny
            factor = under / main[i]
            main[i + 1] -= factor * up[i]
            y[i + 1] -= factor * y[i]
    for i in range(n - 1, -1, -1):
        if abs(main[i]) < tiny:
            main[i] = np.copysign(tiny, main[i])
        known = (up[i] * y[i + 1] if i + 1 < n else 0.0) + (up2[i] * y[i + 2] if i + 2 < n else 0.0)
        y[i] = (y[i] - known) / main[i]
        if abs(y[i]) > 1e250:  # keep in range: only the direction counts
            y /= 1e250
    return y


def inverse_iteration(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, as rows; those of close values are made orthogonal."""
    d, norm = len(diag), float(np.abs(diag).max() + 2 * np.abs(off).max(initial=0))
    draw, out = np.random.default_rng(5), np.zeros((len(values), len(diag)))
    cluster = shift = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            cluster = k
        # equal values would give the same system again: keep the shifts apart
        shift = min(value, shift - 10 * EPS * norm) if k > cluster else value
        y = draw.uniform(-1, 1, d)
        for _ in range(6):
            y = solve_shifted(diag, off, shift, y / np.linalg.norm(y), EPS * norm)
            for _ in range(2):
                y = y / np.linalg.norm(y)
                y -= out[cluster:k].T @ (out[cluster:k] @ y)
        out[k] = y / np.linalg.norm(y)
    return out


def leading_components(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues, falling, and their unit vectors as rows, without those that rounding alone could have made."""
    scale = float(np.abs(cov).max(initial=0))
    if not scale:
        return np.zeros(0), np.zeros((0, len(cov)))
    diag, off, mirrors = tridiagonal(cov / scale)
    values = leading_values(diag, off, most)
    values = values[values > 16 * len(cov) * EPS * values[0]]
    vectors = inverse_iteration(diag, off, values)
    for k in range(len(mirrors) - 1, -1, -1):
        tail = vectors[:, k + 1:]
        tail -= 2 * np.outer(tail @ mirrors[k], mirrors[k])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    largest = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], 1)
    return values * scale, vectors * np.sign(largest)


@dataclass(frozen=True)
class Whitening:
    """A fitted projection: whitened = (x - mean) @ directions.T, one direction a component."""

    about: Centre
    offset: int
    directions: np.ndarray
    explained: np.ndarray

    def apply(self, column: pa.Array) -> np.ndarray:
        x = matrix(column, len(self.about.sums), self.offset) - self.about.whole
        return (x - np.array([r / self.about.n for r in self.about.rest])) @ self.directions.T

    def deviations(self, column: pa.Array) -> list[int]:
        """Squared distance from the mean, times n^2, exactly."""
        n, x = self.about.n, matrix(column, len(self.about.sums), self.offset) - self.about.whole
        rest = np.array(self.about.rest, object if n >= 2**62 else np.int64)
        reach = n * (int(np.abs(x).max(initial=0)) + 1)
        x = x if reach * reach * max(1, x.shape[1]) < 2**63 else x.astype(object)
        return [int(s) for s in ((n * x - rest) ** 2).sum(axis=1)]


def fit(rows: DataFrame, most: int, offset: int) -> Whitening | None:
    about = centre(rows, offset)
    if about is None:
        return None
    cov = covariance(rows, about, offset)
    values, vectors = leading_components(cov, most)
    trace = float(np.trace(cov))
    return Whitening(about, offset, vectors / np.sqrt(values)[:, None], values / trace if trace else values)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows."""
    k, n = len(model.directions), model.about.n

    def products(column):
        w = model.apply(column)
        yield np.vstack([w.T @ w, w.sum(axis=0)])

    sums = product_sums(rows, k, products, "double")
    mean = sums[k] / n
    return float(np.abs(sums[:k] / n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, id: str = "vec_id", vector: str = "embedding", most: int = 32, scale: int = 64, offset: int = 1_000_000, fit_on: Column | None = None) -> DataFrame:
    """One row for each vector and component: id, component (from 1), n, deviation (decimal: the sum over dimensions
    of (n * x - S)^2), whitened, explained (share of the variance) and identity_error (of the fit)."""
    rows = entries(pick(df, id=id, v=vector), scale, offset)
    learned = rows if fit_on is None else rows.where(fit_on)
    model = fit(learned, most, offset)
    schema = f"id {df.schema[id].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None or not len(model.directions):
        return df.sparkSession.createDataFrame([], schema)
    error, k = identity_error(learned, model), len(model.directions)

    def project(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for s in range(0, batch.num_rows, max(1, 65_536 // k)):
                part = batch.slice(s, max(1, 65_536 // k))
                m, each = part.num_rows, np.repeat(np.arange(part.num_rows), k)
                away = pa.array([Decimal(x) for x in model.deviations(part.column(1))], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.about.n)), away.take(pa.array(each)), pa.array(model.apply(part.column(1)).ravel()),
                    pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error)),
                ], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
