"""Embedding whitening with a compensated covariance.

Entries are whole numbers on a common offset that dwarfs their spread, so products of raw entries would lose what matters. Sums are exact
whole numbers; each entry is centred exactly, as (n x - S) / n in double-double; outer products of the centred entries are
accumulated in double-double by an error-free transformation of matrix products: entries are sliced so that products of slices add up
without rounding in ordinary matrix multiplications, and the slices' products are added by two-sums. Tasks hand on the high and low
parts of their matrices, which are merged by two-sums in the order of the partitions. The eigenproblem of the merged matrix goes
to LAPACK's tridiagonal divide-and-conquer driver (``numpy.linalg.eigh``: Householder tridiagonalisation, then divide and
conquer); its vectors are refined in double-double against both parts of the matrix, so small eigenvalues beside large ones
keep their digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import small_batches, stored

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Rows multiplied at once; slices of a number, and the sum of their places up to which products count (about 105 bits).
BLOCK, SLICES = 1024, 5
#: Tasks' matrices are merged in so many groups first.
GROUPS = 64
#: An eigenvalue below this share of the largest is zero: its component has no spread to scale.
ZERO = 2.0**-88
#: Times the eigenvectors are refined.
ROUNDS = 4

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b and what its rounding lost, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> Pair:
    """a b and what its rounding lost, exactly (Dekker)."""

    def halves(x):
        c = 134_217_729.0 * x
        high = c - (c - x)
        return high, x - high

    p, (a1, a2), (b1, b2) = a * b, halves(a), halves(b)
    return p, a2 * b2 - (((p - a1 * b1) - a2 * b1) - a1 * b2)


def add(a: Pair, b: Pair) -> Pair:
    """Double-double sum."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def _slices(a: Pair, axis: int) -> list[np.ndarray]:
    """a as a sum of slices, with so few bits each that sums of products of two slices along ``axis`` are exact."""
    high, low = a
    bits = -(-(53 + int(np.ceil(np.log2(max(2, high.shape[axis]))))) // 2)
    out = []
    for _ in range(SLICES):
        most = np.abs(high).max(axis=axis, keepdims=True)
        unit = np.where(most > 0, np.exp2(np.ceil(np.log2(np.where(most > 0, most, 1.0))) + bits), 0.0)
        top = np.where(unit > 0, (high + unit) - unit, 0.0)
        out.append(top)
        high, low = two_sum(high - top, low)
    return out


def product(a: Pair, b: Pair) -> Pair:
    """The matrix product in double-double."""
    x, y = _slices(a, 1), _slices(b, 0)
    out = (np.zeros((x[0].shape[0], y[0].shape[1])),) * 2
    for place in range(SLICES - 1, -1, -1):  # small terms first
        for i in range(place + 1):
            out = add(out, (x[i] @ y[place - i], np.zeros(1)))
    return out


def _transposed(a: Pair) -> Pair:
    return a[0].T, a[1].T


def outer(a: Pair) -> Pair:
    """a' a in double-double, symmetric."""
    x = _slices(a, 0)
    out = (np.zeros((x[0].shape[1],) * 2),) * 2
    for place in range(SLICES - 1, -1, -1):
        for i in range(place // 2 + 1):
            found = x[i].T @ x[place - i]
            out = add(out, (found, np.zeros(1)))
            if 2 * i != place:
                out = add(out, (found.T, np.zeros(1)))
    return out


def entries(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in the batch and whole-number entries of its usable vectors, by length."""
    vectors = batch.column(column)
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
    for dim in (int(d) for d in np.unique(lengths) if d):
        at = np.flatnonzero(lengths == dim)
        flat = vectors.take(pa.array(at)).flatten()
        scaled = np.floor(flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) * SCALE)
        fine = (np.abs(scaled) < 2.0**62).all(axis=1)  # false for nan, too
        if fine.any():
            yield at[fine], scaled[fine].astype(np.int64) + OFFSET


def distances(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: long where that is certain to suffice, else Python's whole numbers."""
    s = np.array(sums, dtype=object)
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) < 1 << 62:
        return n * x - s.astype(np.int64)
    return n * x.astype(object) - s


def centred(far: np.ndarray, n: int) -> Pair:
    """(n x - S) / n in double-double."""
    if far.dtype == object:
        parts = [(v / n, Fraction(int(v), n)) for v in far.ravel()]
        return tuple(np.array(p, dtype=float).reshape(far.shape) for p in ([h for h, _ in parts], [float(f - Fraction(h)) for h, f in parts]))
    top = far.astype(np.float64)
    rest = (far - top.astype(np.int64)).astype(np.float64)
    high = top / n
    p, e = two_product(high, np.float64(n))
    return two_sum(high, (((top - p) - e) + rest) / n)


def squares(far: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row; null where it exceeds a long."""
    most = int(np.abs(far).max(initial=0))
    if most * most * far.shape[1] < 1 << 63:
        return (far * far).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in (sum(int(x) ** 2 for x in row) for row in far)]


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for batch in batches:
        for _, x in entries(batch, "embedding"):
            n, sums = found.setdefault(x.shape[1], [0, [0] * x.shape[1]])
            small = int(np.abs(x).max()) * len(x) < 1 << 62
            new = x.sum(axis=0).tolist() if small else x.astype(object).sum(axis=0).tolist()
            found[x.shape[1]] = [n + len(x), [a + b for a, b in zip(sums, new)]]
    for dim, (n, sums) in found.items():
        columns = [pa.array([dim] * dim, type=pa.int32()), pa.array(range(dim), type=pa.int32()), pa.array([n] * dim, type=pa.int64()), pa.array([Decimal(s) for s in sums], type=pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(columns, names=["dim", "place", "n", "s"])


MATRIX = "dim int, part long, place int, high binary, low binary"


def _rows_out(dim: int, part: int, matrix: Pair) -> pa.RecordBatch:
    size = len(matrix[0])
    return pa.RecordBatch.from_arrays(
        [pa.array([dim] * size, type=pa.int32()), pa.array([part] * size, type=pa.int64()), pa.array(range(size), type=pa.int32()),
         *(pa.array([r.tobytes() for r in np.ascontiguousarray(m)], type=pa.binary()) for m in matrix)], names=["dim", "part", "place", "high", "low"])


def _gathered(batches: Iterator[pa.RecordBatch], terms: Callable[[pa.RecordBatch], Iterator[tuple[int, Pair]]], of: Callable[[Pair], Pair]) -> Iterator[pa.RecordBatch]:
    """The double-double sum, over the blocks of a task's rows, of ``of(block)``, for each length of vectors."""
    from pyspark import TaskContext

    total: dict[int, Pair] = {}
    for batch in batches:
        for dim, rows in terms(batch):
            for k in range(0, len(rows[0]), BLOCK):
                new = of((rows[0][k : k + BLOCK], rows[1][k : k + BLOCK]))
                total[dim] = add(total[dim], new) if dim in total else new
    for dim, matrix in total.items():
        yield _rows_out(dim, TaskContext.get().partitionId(), matrix)


def _merge(table: pa.Table) -> pa.Table:
    """One row of a matrix, from all tasks of a group: high and low parts are added in the order of the tasks."""
    order = pc.sort_indices(table, sort_keys=[("part", "ascending")])
    table = table.take(order)
    total: Pair | None = None
    for high, low in zip(table.column("high").to_pylist(), table.column("low").to_pylist()):
        new = (np.frombuffer(high), np.frombuffer(low))
        total = new if total is None else add(total, new)
    head = table.slice(0, 1)
    return pa.table({
        "dim": head.column("dim"), "part": pa.array([table.column("part")[0].as_py() % GROUPS], type=pa.int64()), "place": head.column("place"),
        "high": pa.array([total[0].tobytes()], type=pa.binary()), "low": pa.array([total[1].tobytes()], type=pa.binary())})


def _merged(parts: DataFrame) -> dict[int, Pair]:
    """Tasks' matrices -> one for each length, by way of groups of tasks; a matrix of dim x dim is what reaches the driver."""
    once = parts.groupBy("dim", "place", F.pmod("part", F.lit(GROUPS)).alias("_g")).applyInArrow(_merge, MATRIX)
    rows = once.groupBy("dim", "place").applyInArrow(_merge, MATRIX).collect()
    out: dict[int, Pair] = {}
    for dim in {r["dim"] for r in rows}:
        own = sorted((r["place"], r["high"], r["low"]) for r in rows if r["dim"] == dim)
        out[dim] = (np.array([np.frombuffer(h) for _, h, _ in own]), np.array([np.frombuffer(w) for _, _, w in own]))
    return out


def divided(a: Pair, n: int) -> Pair:
    """a / n in double-double."""
    high = a[0] / n
    p, e = two_product(high, np.float64(n))
    return two_sum(high, (((a[0] - p) - e) + a[1]) / n)


def eigen(matrix: Pair) -> tuple[np.ndarray, Pair]:
    """Eigenvalues, falling, and unit eigenvectors (columns, in double-double) of a symmetric double-double matrix.

    Divide and conquer gives them to double precision of the largest; then vectors are corrected by what X'X and X'AX, in
    double-double, miss of diagonal (Ogita and Aishima), and those whose eigenvalues are too close to tell apart are turned within their own block.
    The largest entry of a vector is positive.
    """
    size = len(matrix[0])
    _, vectors = np.linalg.eigh((matrix[0] + matrix[0].T) / 2)
    x: Pair = (vectors, np.zeros_like(vectors))
    norm = float(np.abs(matrix[0]).sum(axis=1).max()) if size else 0.0
    for step in range(2 * ROUNDS):
        r, s = _missing(x), product(_transposed(x), product(matrix, x))
        values = np.diag(s[0]) / (1 - np.diag(r[0]))
        off = s[0] - np.diag(np.diag(s[0]))
        close = 2 * (np.linalg.norm(off) + norm * np.linalg.norm(r[0]))
        if step % 2:
            order = np.argsort(values)
            starts = np.flatnonzero(np.diff(values[order], prepend=-np.inf) > close)
            for a, b in zip(starts, [*starts[1:], size]):
                block = order[a:b]
                if len(block) > 1:
                    local = s[0][np.ix_(block, block)]
                    _, turn = np.linalg.eigh((local + local.T) / 2)
                    turned = product((x[0][:, block], x[1][:, block]), (turn, np.zeros_like(turn)))
                    x[0][:, block], x[1][:, block] = turned
            continue
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > close
        step_by = np.where(apart, (s[0] + values[None, :] * r[0]) / np.where(apart, gap, 1.0), r[0] / 2)
        x = add(x, product(x, (step_by, np.zeros_like(step_by))))
    s, r = product(_transposed(x), product(matrix, x)), _missing(x)
    values = np.diag(s[0]) / (1 - np.diag(r[0]))
    order = np.argsort(-values, kind="stable")
    sign = np.sign(x[0][np.abs(x[0]).argmax(axis=0), np.arange(size)])[order]
    return values[order], (x[0][:, order] * sign, x[1][:, order] * sign)


def _missing(x: Pair) -> Pair:
    """I - X'X."""
    found = product(_transposed(x), x)
    return add((np.eye(len(found[0])), np.zeros_like(found[0])), (-found[0], -found[1]))


class Fit:
    """What one length of vectors has learnt: number of vectors, sums, and once solved, components and their shares."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        self.vectors: Pair = (np.zeros((len(sums), 0)),) * 2
        self.values, self.trace = np.zeros(0), 0.0

    def solve(self, scatter: Pair, components: int) -> None:
        matrix = divided(scatter, self.n)
        values, vectors = eigen(matrix)
        self.trace = float(np.diag(matrix[0]).sum())
        self.values = values[:components]
        self.vectors = (np.ascontiguousarray(vectors[0][:, :components]), np.ascontiguousarray(vectors[1][:, :components]))

    @property
    def spread(self) -> np.ndarray:
        """Standard deviations; nan where a component has none."""
        least = ZERO * max(self.values.max(initial=0.0), 0.0) * max(1, len(self.sums))
        return np.sqrt(np.where(self.values > least, self.values, np.nan))

    def explained(self) -> list[float | None]:
        return [max(0.0, float(v)) / self.trace if self.trace > 0 else None for v in self.values]


def _whitened_batches(batches: Iterator[pa.RecordBatch], fits: dict[int, Fit]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, x in entries(batch, "embedding"):
            fit = fits[x.shape[1]]
            far = distances(x, fit.n, fit.sums)
            high, low = centred(far, fit.n)
            found = np.concatenate([product((high[k : k + BLOCK], low[k : k + BLOCK]), fit.vectors)[0] for k in range(0, len(x), BLOCK)]) / fit.spread
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, max(1, found.shape[1]), dtype=np.int32)), pa.array(found.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(at)), pa.array(np.full(len(at), x.shape[1], dtype=np.int32)), pa.array(squares(far), type=pa.int64()), rows],
                names=["vec_id", "dim", "deviation", "whitened"])


def _terms(batch: pa.RecordBatch, means: dict[int, Pair]) -> Iterator[tuple[int, Pair]]:
    """Whitened rows, less their means where these are known; components without spread are left out as zeros."""
    dims = batch.column("dim").to_numpy()
    for dim in (int(d) for d in np.unique(dims)):
        own = batch.column("whitened").take(pa.array(np.flatnonzero(dims == dim)))
        found = np.nan_to_num(own.flatten().fill_null(0.0).to_numpy(zero_copy_only=False).reshape(len(own), -1), nan=0.0)
        mean = means.get(dim)
        yield dim, (found, np.zeros_like(found)) if mean is None else add((found, np.zeros_like(found)), (-mean[0], -mean[1]))


def _total(rows: Pair) -> Pair:
    return product((np.ones((1, len(rows[0]))), np.zeros((1, len(rows[0])))), rows)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> ``vec_id, component, n, deviation, whitened, explained, identity_error``, a row for each usable vector and component.

    Vectors that are null, empty, or hold null or non-finite entries (or such whose whole number exceeds a long) are left out; the others are the fit
    list. Vectors of different lengths have a fit each, as if they were tables of their own. Each entry c counts as x = floor(64 c) + 1000000. Components
    are the first ``components`` eigenvectors of the covariance (fewer if vectors are shorter), numbered from 1 by falling eigenvalue e, ties in any
    order. ``deviation``: the exact sum of (n x - S)^2, null if it exceeds a long. ``whitened``: x - S/n projected on the component, over sqrt(e); null
    for components without any spread (e zero), which ``identity_error`` leaves out. ``explained``: e / trace, null if all vectors are equal.
    ``identity_error``: the largest absolute entry of the measured covariance of whitened less the identity, null if no component has a
    spread. Repeated rows count each time; vec_id may be null. An empty table gives an empty result; other columns are ignored.

    Passes: sums, scatter, whitened rows (kept), their means, their covariance, result. A task hands on one matrix for each length. No row
    is dealt by a key until the result, which needs no shuffle.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    sums = base.mapInArrow(_sum_batches, "dim int, place int, n long, s decimal(38,0)").groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim", "place").collect()
    fits = {dim: Fit(next(r["n"] for r in sums if r["dim"] == dim), [int(r["s"]) for r in sums if r["dim"] == dim]) for dim in {r["dim"] for r in sums}}
    if not fits:
        return spark.createDataFrame([], schema)

    def offsets(batch: pa.RecordBatch) -> Iterator[tuple[int, Pair]]:
        for _, x in entries(batch, "embedding"):
            fit = fits[x.shape[1]]
            yield x.shape[1], centred(distances(x, fit.n, fit.sums), fit.n)

    for dim, scatter in _merged(base.mapInArrow(lambda b: _gathered(b, offsets, outer), MATRIX)).items():
        fits[dim].solve(scatter, components)
    rows, _ = stored(base.mapInArrow(lambda b: _whitened_batches(b, fits), "vec_id long, dim int, deviation long, whitened array<double>"), "whitened")
    means = {dim: divided((t[0][0], t[1][0]), fits[dim].n) for dim, t in _merged(rows.mapInArrow(lambda b: _gathered(b, lambda x: _terms(x, {}), _total), MATRIX)).items()}
    around = _merged(rows.mapInArrow(lambda b: _gathered(b, lambda x: _terms(x, means), outer), MATRIX))
    facts = []
    for dim, fit in fits.items():
        spread = np.flatnonzero(np.isfinite(fit.spread))
        left = np.abs(divided(around[dim], fit.n)[0] - np.eye(len(fit.values)))[np.ix_(spread, spread)]
        facts.append((dim, fit.n, fit.explained(), float(left.max()) if left.size else None))
    known = spark.createDataFrame(facts, "_dim int, n long, shares array<double>, identity_error double")
    # one row for each length of vectors
    return rows.join(F.broadcast(known), F.col("dim") == F.col("_dim")).select("vec_id", "n", "deviation", "shares", "identity_error", F.posexplode("whitened").alias("_c", "whitened")).select(
        "vec_id", (F.col("_c") + 1).alias("component"), "n", "deviation", "whitened", F.get("shares", F.col("_c")).alias("explained"), "identity_error")
