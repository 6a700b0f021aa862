"""Whitening of vectors on their leading principal components.

Vectors are put on an integer grid, and the distinct grid vectors are the fit list. Its sums are
exact; its covariance is summed from centred blocks, one product a batch and one row per entry and
task. The matrix of a space (d x d, in one task) goes through Householder steps to a tridiagonal
one, whose leading eigenvalues are bisected by Sturm counts; inverse iteration, with vectors of
close eigenvalues orthogonalised against each other, gives the components. What is broadcast for
the projection is the model: some numbers for each dimension, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strictpast.llm.workers import importable, typed
from strictpast.session import stage

#: Grid steps of a unit, components, and the share of the largest eigenvalue below which one counts as zero.
SCALE, COMPONENTS, NOTHING = 256, 4, 64 * np.finfo(float).eps
#: Eigenvalues closer than this share of the matrix's norm have their vectors kept orthogonal.
CLUSTER = 1e-3
LONG = 2**63 - 1


# --- symmetric eigenproblem ---------------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Householder reduction: diagonal, off-diagonal and the mirrors' unit vectors."""
    a, mirrors = a.copy(), []
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = np.linalg.norm(v)
        if not size:
            mirrors.append(None)
            continue
        v /= size
        block = a[k + 1 :, k + 1 :]
        p = 2 * (block @ v)
        w = p - (v @ p) * v
        block -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * (v @ a[k + 1 :, k]) * v
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def count_below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie below each of ``x``."""
    tiny = np.finfo(float).tiny ** 0.5
    q, count = diagonal[0] - x, np.zeros(len(x), int)
    for i in range(len(diagonal)):
        if i:
            q = diagonal[i] - x - off[i - 1] ** 2 / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection within Gershgorin's bounds."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    place = n - 1 - np.arange(k)
    while True:
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            return middle
        above = count_below(diagonal, off, middle) <= place
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def solve(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """``(T - shift) x = b`` by elimination with row exchanges; pivots are ``least`` at least."""
    n, b = len(diagonal), b.copy()
    main, upper, far = diagonal - shift, np.append(off, 0.0), np.zeros(n)
    for i in range(n - 1):
        below = off[i]
        if abs(below) > abs(main[i]):
            factor = main[i] / below
            main[i], upper[i], far[i], main[i + 1], upper[i + 1] = (
                below, main[i + 1], upper[i + 1], upper[i] - factor * main[i + 1], -factor * upper[i + 1])
            b[i], b[i + 1] = b[i + 1], b[i] - factor * b[i + 1]
        else:
            main[i] = main[i] if abs(main[i]) > least else least
            factor = below / main[i]
            main[i + 1] -= factor * upper[i]
            b[i + 1] -= factor * b[i]
    main[-1] = main[-1] if abs(main[-1]) > least else least
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            b[i] -= upper[i] * b[i + 1]
        if i + 2 < n:
            b[i] -= far[i] * b[i + 2]
        b[i] /= main[i] if abs(main[i]) > least else least
    return b


def leading_pairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows."""
    scale = np.abs(a).max(initial=0.0)
    n = len(a)
    if not scale:
        return np.zeros(min(k, n)), np.eye(min(k, n), n)
    diagonal, off, mirrors = tridiagonal(a / scale)
    values = leading_values(diagonal, off, min(k, n))
    norm = np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0)
    least = np.finfo(float).eps * norm
    random = np.random.default_rng(n)
    vectors: list[np.ndarray] = []
    for j, value in enumerate(values):
        close = [v for v, e in zip(vectors, values) if e - value <= CLUSTER * norm]
        z = random.standard_normal(n)
        for _ in range(6):
            z = solve(diagonal, off, value - j * least, z / np.linalg.norm(z), least)
            z /= np.linalg.norm(z)
            for _ in range(2):
                for v in close:
                    z -= (v @ z) * v
        vectors.append(z / np.linalg.norm(z))
    out = np.array(vectors)
    for k, v in reversed(list(enumerate(mirrors))):
        if v is not None:
            out[:, k + 1 :] -= 2 * np.outer(out[:, k + 1 :] @ v, v)
    return values * scale, out / np.linalg.norm(out, axis=1, keepdims=True)


# --- the model ------------------------------------------------------------------------------


@dataclass
class Space:
    """What is known of the vectors of one length: fit rows, exact sums, components."""

    n: int
    sums: list[int]
    components: np.ndarray | None = None
    values: np.ndarray | None = None
    trace: float = 0.0
    error: float | None = None

    def __post_init__(self) -> None:
        parts = [divmod(s, self.n) for s in self.sums]
        self.whole = [w for w, _ in parts]
        self.rest = [r for _, r in parts]
        self.fraction = np.array([r / self.n for r in self.rest])

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """``x`` less the whole part of the means: integers, exact."""
        whole = np.array(self.whole, object)
        if len(x) and x.size and max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, self.whole)) < 2**62:
            return x - whole.astype(np.int64)
        return x.astype(object) - whole

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.offsets(x).astype(np.float64) - self.fraction

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact squared distances from the sums: sum of ``(n * x - S) ** 2`` for each row."""
        y, n = self.offsets(x), self.n
        largest = max(abs(int(y.max())), abs(int(y.min()))) if y.size else 0
        rest = np.array(self.rest, object)
        if y.dtype == np.int64 and y.shape[1] * largest * max(largest, n) < 2**62:
            rest = rest.astype(np.int64)
        else:
            y = y.astype(object)
        square, mixed = (y * y).sum(axis=1).tolist(), (y * rest).sum(axis=1).tolist()
        constant = sum(r * r for r in self.rest)
        return [n * n * a - 2 * n * b + constant for a, b in zip(square, mixed)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Coordinates of unit variance; NaN for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.values > NOTHING * max(self.values.max(initial=0.0), 0.0), 1 / np.sqrt(self.values), np.nan)
        return self.centred(x) @ self.components.T * scale


def finite(vector: str) -> Column:
    """Vectors without nulls, NaN or infinities."""
    v = F.col(vector)
    entries = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(v.isNotNull() & entries, F.lit(False))


def grid(vector: str, scale: int) -> Column:
    """Components as integers, ``floor(scale * c)``; beyond the range of a long they stop at its ends."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, matrix)`` of each length that occurs in a column of integer lists."""
    lengths = np.asarray(column.value_lengths())
    starts = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.asarray(column.flatten())
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        yield at, flat[starts[at][:, None] + np.arange(d)]


def fit_sums(fit: DataFrame) -> dict[int, Space]:
    """Rows and exact sums of every length; what comes back is one number for each component."""
    low = (1 << 22) - 1
    x = F.col("x")
    # Three parts of a long, so that sums of any number of rows stay exact.
    parts = [x.bitwiseAND(low), F.shiftright(x, 22).bitwiseAND(low), F.shiftright(x, 44)]
    entries = fit.select("d", F.posexplode("x").alias("i", "x")).groupBy("d", "i")
    sums = entries.agg(F.count("*").alias("n"), *(F.sum(p).alias(f"p{j}") for j, p in enumerate(parts)))
    found: dict[int, dict[int, tuple[int, int]]] = {}
    for r in sums.collect():
        found.setdefault(r.d, {})[r.i] = (r.n, r.p0 + (r.p1 << 22) + (r.p2 << 44))
    return {d: Space(by[0][0], [by[i][1] for i in range(d)]) for d, by in found.items()}


def covariance(fit: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """``(d, i, j, v)`` with ``i >= j``: the covariance of each length, divisor n."""
    schema = T.StructType.fromDDL("d int, i int, j int, v double")
    model = fit.sparkSession.sparkContext.broadcast(spaces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, x in matrices(batch.column(0)):
                d = x.shape[1]
                if d:
                    c = model.value[d].centred(x) / np.sqrt(model.value[d].n)
                    sums[d] = sums.get(d, 0.0) + c.T @ c
        for d, total in sums.items():
            i, j = np.tril_indices(d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=schema.names)

    return fit.select("x").mapInArrow(run, schema).groupBy("d", "i", "j").agg(F.sum("v").alias("v"))


def eigenpairs(entries: DataFrame, k: int) -> DataFrame:
    """``(d, place, value, trace, vector)`` of the ``k`` leading components of each length."""
    schema = T.StructType.fromDDL("d int, place int, value double, trace double, vector array<double>")

    def run(table: pa.Table) -> pa.Table:
        d = table["d"][0].as_py()
        a = np.zeros((d, d))
        i, j, v = (table[c].to_numpy() for c in ("i", "j", "v"))
        a[i, j] = v
        a[j, i] = v
        values, vectors = leading_pairs(a, k)
        return pa.table({
            "d": pa.array([d] * len(values), pa.int32()), "place": pa.array(range(len(values)), pa.int32()), "value": pa.array(values),
            "trace": pa.array([float(np.trace(a))] * len(values)), "vector": pa.array(list(vectors), pa.list_(pa.float64()))})

    return entries.groupBy("d").applyInArrow(run, schema)


def fit_spaces(vectors: DataFrame, k: int = COMPONENTS) -> dict[int, Space]:
    """Fit ``(x)``, integer vectors, by length; each distinct vector counts once.

    The driver gets ``k + 1`` numbers for each component of each length and, last, the covariance
    of the whitened fit rows, of which the largest departure from the identity is kept.
    """
    fit = stage(vectors.select("x").distinct().select(F.size("x").alias("d"), "x"), "fit-list")
    spaces = fit_sums(fit)
    found: dict[int, list] = {}
    for r in eigenpairs(stage(covariance(fit, spaces), "covariance"), k).collect():
        found.setdefault(r.d, []).append(r)
    for d, rows in found.items():
        rows.sort(key=lambda r: r.place)
        space = spaces[d]
        space.trace = rows[0].trace
        space.values, space.components = np.array([r.value for r in rows]), np.array([r.vector for r in rows])
    model = fit.sparkSession.sparkContext.broadcast(spaces)
    schema = T.StructType.fromDDL("d int, i int, j int, n long, v double, a double, b double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch.column(0)):
                if d := x.shape[1]:
                    w = model.value[d].whitened(x)
                    i, j = np.tril_indices(w.shape[1])
                    v, totals = (w.T @ w)[i, j], w.sum(axis=0)
                    full = np.full(len(i), d, np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in (full, i.astype(np.int32), j.astype(np.int32), np.full(len(i), len(x)), v, totals[i], totals[j])],
                        names=schema.names)

    sums = fit.select("x").mapInArrow(run, schema).groupBy("d", "i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "v", "a", "b")))
    for r in sums.collect():
        departure = abs(r.v / r.n - r.a / r.n * (r.b / r.n) - (r.i == r.j))
        if departure == departure:
            spaces[r.d].error = max(departure, spaces[r.d].error or 0.0)
    return spaces


def whiten(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, k: int = COMPONENTS
) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error, deviation_exact)``.

    Rows whose vector is null or holds a null or non-finite entry are dropped. An entry ``c`` is read
    as ``x = floor(scale * c)``, cut at the ends of a long. The fit list holds each distinct ``x`` vector
    once: ``n`` of them with sums ``S``. Every remaining row gives one row for each component up to ``k``:
    ``deviation`` is the sum of ``(n * x - S) ** 2`` (null beyond a long; ``deviation_exact`` has all digits),
    ``whitened`` the projection of ``x - S / n`` over the standard deviation of the component (null for a
    component without variance), ``explained`` its share of the variance (null if there is none) and
    ``identity_error`` the largest departure of the whitened fit list's covariance from the identity
    (null without a component of variance). Components are numbered by falling variance; a vector and its
    opposite are both right, and all rows get the same one.

    Vectors of another length are a space of their own, with their own ``n``; an empty vector has no
    component and gives no row. A null key and repeated keys or rows are rows like others. Other columns
    are not read, whatever their names; an empty table gives an empty result.
    """
    importable(table.sparkSession)
    kept = table.where(finite(vector)).select(F.col(key).alias("key"), grid(vector, scale).alias("x"))
    spaces = fit_spaces(kept, k)
    model = table.sparkSession.sparkContext.broadcast(spaces)
    numbers = "component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    schema = T.StructType([typed(table, key), *T.StructType.fromDDL(numbers).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch.column(1)):
                if not x.shape[1]:
                    continue
                space = model.value[x.shape[1]]
                m, parts = len(at), len(space.values)
                rows = np.repeat(np.arange(m), parts)
                exact = space.deviations(x)
                within = pa.array([e if e <= LONG else None for e in exact], pa.int64())
                whitened = space.whitened(x).ravel()
                share = space.values / space.trace if space.trace > 0 else np.full(parts, np.nan)
                error = np.nan if space.error is None else space.error
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(at[rows])), pa.array(np.tile(np.arange(1, parts + 1, dtype=np.int32), m)),
                    pa.array(np.full(len(rows), space.n)), within.take(take), pa.array(whitened, from_pandas=True),
                    pa.array(np.tile(share, m), from_pandas=True), pa.array(np.full(len(rows), error), from_pandas=True),
                    pa.array([str(e) for e in exact]).take(take)], names=schema.names)

    return kept.mapInArrow(run, schema)
