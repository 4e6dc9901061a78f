"""Embedding whitening: a distributed centred covariance, its leading eigenvectors, and their projection.

The covariance of the distinct quantised vectors is summed over tasks after exact centring. One task for each number
of dimensions makes it tridiagonal by Householder reflections, finds the leading eigenvalues by bisection on Sturm
counts and their vectors by inverse iteration, orthogonalised again inside clusters. The components are broadcast
and all vectors projected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, settle, small_batches

#: Quantisation of an entry c: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components at most, and bytes of all models together up to which they are broadcast.
COMPONENTS, BROADCAST = 16, 64 << 20
EPS = np.finfo(np.float64).eps
#: Eigenvalues closer than this share of the norm are a cluster, whose vectors are orthogonalised against each other.
CLUSTER = 1e-3
#: Bytes of vectors that a step of a task centres at once, and integers up to which doubles are exact.
STEP, WHOLE = 8 << 20, 1 << 53


# --- eigenvectors of one symmetric matrix ---


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, reflectors) of Q'vQ, where Q is the product of the Householder reflections
    I - 2hh' over the rows h of reflectors, in order; a zero row reflects nothing."""
    a, d = np.array(v, dtype=np.float64), len(v)
    h = np.zeros((max(d - 2, 0), d))
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        scale = np.abs(x[1:]).max()
        if scale == 0:
            continue
        x /= max(scale, np.abs(x[0]))
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        u = h[k, k + 1 :] = x / np.linalg.norm(x)
        p = a[k + 1 :, k + 1 :] @ u
        w = 2 * (p - (u @ p) * u)
        a[k + 1 :, k + 1 :] -= np.outer(u, w) + np.outer(w, u)
        a[k + 1 :, k] -= 2 * (u @ a[k + 1 :, k]) * u
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, 1).copy(), h


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each of the numbers `at` how many eigenvalues of the tridiagonal matrix are smaller."""
    square, least = off**2, max(EPS * EPS * max(np.abs(off).max(initial=0.0), np.abs(diagonal).max()), np.finfo(np.float64).tiny)
    count, q = np.zeros(len(at), dtype=np.int64), np.inf
    for k in range(len(diagonal)):
        q = diagonal[k] - at - (square[k - 1] / q if k else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until no double lies between its bounds or they differ by a
    rounding of the matrix."""
    beside = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    low, high = (diagonal - beside).min(), (diagonal + beside).max()
    norm = max(abs(low), abs(high))
    low, high = np.full(k, low - EPS * norm), np.full(k, high + EPS * norm)
    rank = len(diagonal) - 1 - np.arange(k)  # the eigenvalue has so many smaller ones at most
    while True:
        middle = (low + high) / 2
        if ((high - low <= EPS * norm / 4) | (middle <= low) | (middle >= high)).all():
            return middle
        above = sturm_counts(diagonal, off, middle) <= rank
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """x with (T - shift)x = b by elimination with row exchanges; pivots of less than `least` become that."""
    n = len(diagonal)
    main, up, upper, x = diagonal - shift, np.append(off, 0.0), np.zeros(n), b.copy()
    for k in range(n - 1):
        low, below, beyond = off[k], main[k + 1], up[k + 1]
        if abs(low) > abs(main[k]):  # exchange rows k and k + 1
            factor = main[k] / low
            main[k], main[k + 1] = low, up[k] - factor * below
            up[k], upper[k], up[k + 1] = below, beyond, -factor * beyond
            x[k], x[k + 1] = x[k + 1], x[k] - factor * x[k + 1]
        else:
            if abs(main[k]) < least:
                main[k] = np.copysign(least, main[k])
            factor = low / main[k]
            main[k + 1] = below - factor * up[k]
            x[k + 1] -= factor * x[k]
    main = np.where(np.abs(main) < least, np.copysign(least, main), main)
    for k in range(n - 1, -1, -1):
        if k + 1 < n:
            x[k] -= up[k] * x[k + 1]
        if k + 2 < n:
            x[k] -= upper[k] * x[k + 2]
        x[k] /= main[k]
        if abs(x[k]) > 1e150:  # the direction counts, not the length
            x /= abs(x[k])
    return x


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) for falling eigenvalues, by inverse iteration from fixed random vectors.

    A vector is made orthogonal to those before it in its cluster after every solve, twice, so eigenvectors of equal
    eigenvalues are orthogonal too. It is done when its residual is a rounding of the matrix."""
    n, norm = len(diagonal), max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(np.float64).tiny)
    random, out, begin, before = np.random.default_rng(0), np.empty((len(values), n)), 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            begin, before = k, np.inf
        shift = min(value, before - 10 * EPS * norm)  # equal eigenvalues get shifts of their own
        before, x, best = shift, random.standard_normal(n), (np.inf, None)
        for _ in range(12):
            for _ in range(2):
                x -= out[begin:k].T @ (out[begin:k] @ x)
            x /= np.linalg.norm(x)
            product = diagonal * x
            product[:-1] += off * x[1:]
            product[1:] += off * x[:-1]
            rest = np.linalg.norm(product - (x @ product) * x)
            if rest < best[0]:
                best = rest, x.copy()
            if rest <= 4 * EPS * norm:
                break
            x = _solve(diagonal, off, shift, x, EPS * norm)
        out[k] = best[1]
    return out


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as rows) of the k largest eigenvalues of the symmetric matrix v, falling; fewer where an
    eigenvalue is no more than a rounding of the largest, as its direction then holds no variance."""
    scale = np.abs(v).max()
    if scale == 0:
        return np.empty(0), np.empty((0, len(v)))
    diagonal, off, h = tridiagonal(v / scale)
    values = leading_eigenvalues(diagonal, off, min(k, len(v)))
    values = values[values > len(v) * EPS * 8 * values[0]]
    vectors = tridiagonal_vectors(diagonal, off, values)
    for u in h[::-1]:
        vectors -= 2 * np.outer(vectors @ u, u)
    return values * scale, vectors


# --- over tables ---


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, dims, x) of the rows whose vector is neither null nor holds null or non-finite entries; x is
    floor(64 * c) + 1000000 of each entry c as double, as long. Entries beyond a long are cut to its ends."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(~bad, F.transform(v, lambda c: c.cast("double"))).alias("v")).where("v is not null")
    return rows.select("id", F.size("v").alias("dims"), F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _scaled_deviation(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as longs where they hold it, else as Python integers."""
    x_most, s_most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))), max(map(abs, sums), default=0)
    exact = np.int64 if n * x_most + s_most < 1 << 62 else object
    return n * x.astype(exact) - np.array(sums, dtype=exact)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, each entry rounded once where n * x - S is exact in double precision, else twice."""
    return _scaled_deviation(x, n, sums).astype(np.float64) / n


def _steps(dims: int, rows: int):
    step = max(1, STEP // (8 * dims))
    return (slice(k, k + step) for k in range(0, rows, step))


def _sums(table: pa.Table) -> dict:
    return {d: (int(n), [int(s) for s in sums]) for d, n, sums in zip(*(table.column(c).to_pylist() for c in ("dims", "n", "sums")))}


PRODUCTS = "dims int, row int, total array<double>"


def _products(of: dict, project: dict | None = None):
    """For each dims of a task's vectors the rows of the sum of yy', y centred, or projected and whitened. `of` has n
    and sums for each dims, project the components over the roots of their eigenvalues."""

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                if not d or (project is not None and not len(project[d])):
                    continue
                x = _matrix(batch.column("x").take(pa.array(np.flatnonzero(dims == d))), d)
                for part in _steps(d, len(x)):
                    y = centred(x[part], *of[d])
                    y = y if project is None else y @ project[d].T
                    totals[d] = totals.get(d, 0) + y.T @ y
            settle()
        for d, total in totals.items():
            for k in range(0, len(total), 64):
                rows = total[k : k + 64]
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(rows), pa.int32()), pa.array(range(k, k + len(rows)), pa.int32()), pa.array(list(rows), pa.list_(pa.float64()))], ["dims", "row", "total"])

    return run


def _added(table: pa.Table) -> pa.Table:
    """The sum of one row of the matrices of all tasks, from the smallest first number on, so that it is the same however
    tasks end."""
    rows = np.stack(sorted(table.column("total").to_pylist()))
    return pa.table({"dims": table.column("dims")[:1], "row": table.column("row")[:1], "total": pa.array([rows.sum(axis=0)], pa.list_(pa.float64()))})


MODEL = "dims int, n bigint, trace double, sums array<decimal(38,0)>, variances array<double>, vectors array<double>"


def _model(components: int):
    def run(table: pa.Table) -> pa.Table:
        d, n, rows = table.column("dims")[0].as_py(), table.column("n")[0].as_py(), table.sort_by("row")
        v = _matrix(pa.concat_arrays(rows.column("total").chunks), d) / n
        v = (v + v.T) / 2
        values, vectors = leading_components(v, components)
        whole = pa.list_(pa.decimal128(38, 0))
        return pa.table(
            {"dims": pa.array([d], pa.int32()), "n": pa.array([n], pa.int64()), "trace": pa.array([float(np.trace(v))]), "sums": pa.array([table.column("sums")[0].as_py()], whole), "variances": pa.array([values], pa.list_(pa.float64())), "vectors": pa.array([vectors.ravel()], pa.list_(pa.float64()))}
        )

    return run


def _column_sums(batches):
    """For each dims of a task's vectors, in exact integers: their number and the sum of each column."""
    totals: dict[int, list] = {}
    for batch in batches:
        dims = batch.column("dims").to_numpy()
        for d in np.unique(dims).tolist():
            x = _matrix(batch.column("x").take(pa.array(np.flatnonzero(dims == d))), d)
            exact = np.int64 if len(x) * max(abs(int(x.max())), abs(int(x.min()))) < 1 << 62 else object
            n, sums = totals.get(d, (0, [0] * d))
            totals[d] = n + len(x), [a + int(b) for a, b in zip(sums, x.astype(exact).sum(axis=0))]
        settle()
    for d, (n, sums) in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(sums, pa.decimal128(38, 0))], ["dims", "pos", "n", "total"])


def _project(models):
    """The rows of each vector, one for each component."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                n, sums, projection, explained, error = models.value[d]
                at, k = np.flatnonzero(dims == d), len(projection)
                for part in _steps(d, len(at) if k else 0):
                    rows = at[part]
                    x = _matrix(batch.column("x").take(pa.array(rows)), d)
                    gap = _scaled_deviation(x, n, sums)
                    most = int(np.abs(gap).max(initial=0))
                    square = (gap if d * most * most < 1 << 63 else gap.astype(object)) ** 2
                    deviation = pa.array([v if v < 1 << 63 else None for v in square.sum(axis=1).tolist()], pa.int64())
                    white = (gap.astype(np.float64) / n) @ projection.T
                    repeat = np.repeat(np.arange(len(rows)), k)
                    same = lambda value, kind: pa.array(np.full(len(repeat), value), kind)
                    columns = [batch.column("id").take(pa.array(rows[repeat])), pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()), same(n, pa.int64()), deviation.take(pa.array(repeat))]
                    columns += [pa.array(white.ravel()), pa.array(np.tile(explained, len(rows))), same(error, pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
            settle()

    return run


def _chunks(sizes: list[int], components: int):
    """The numbers of dimensions in lists whose models take at most BROADCAST bytes, or a single one."""
    chunk: list[int] = []
    for d in sorted(sizes):
        if chunk and sum(8 * (components + 4) * k for k in (*chunk, d)) > BROADCAST:
            yield chunk
            chunk = []
        chunk.append(d)
    if chunk:
        yield chunk


def _summed(partial: DataFrame) -> DataFrame:
    return partial.groupBy("dims", "row").applyInArrow(_added, PRODUCTS)


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each usable vector and component.

    The fit list is each distinct quantised vector x once: n of them with sums S. `deviation` is the sum of (n x - S)
    squared, exact (null beyond a long); `whitened` is x - S/n projected on the component, over the root of its
    eigenvalue e; `explained` is e over the trace; `identity_error` is the largest entry of the whitened fit list's
    covariance minus the identity. Components have numbers from 1 by falling eigenvalue; those whose eigenvalue is a
    rounding of the largest have no direction and are left out, so a fit list of one vector gives no rows.

    Vectors that are null or hold null or non-finite entries give no rows, nor do empty ones; vectors of different
    dimensions are fitted apart. Rows that share an id, and rows with a null one, come back each. Empty input gives no
    rows. A task sends one matrix of dims by dims for all its vectors; the driver reads one model for each number of
    dimensions, in lists of at most BROADCAST bytes, beyond which more passes follow.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    scratch, context = Scratch(spark), spark.sparkContext
    rows = quantised(vectors, id_col, vector_col).where("dims > 0")
    fit = scratch.save(rows.select("dims", "x").distinct(), "fit")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    out = spark.createDataFrame([], schema)
    chunks = list(_chunks([r.dims for r in fit.select("dims").distinct().collect()], components))
    for k, chunk in enumerate(chunks):
        of = (lambda table: table) if len(chunks) == 1 else (lambda table, chunk=chunk: table.where(F.col("dims").isin(chunk)))
        sums = of(fit).mapInArrow(_column_sums, "dims int, pos int, n bigint, total decimal(38,0)").groupBy("dims", "pos").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))
        sums = sums.groupBy("dims").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "total"))).alias("s"))
        sums = scratch.save(sums.select("dims", "n", F.col("s.total").alias("sums")), f"sums-{k}")
        centres = _sums(sums.toArrow())
        covariance = _summed(of(fit).mapInArrow(_products(centres), PRODUCTS)).join(sums, "dims")
        models = scratch.save(covariance.groupBy("dims").applyInArrow(_model(components), MODEL), f"models-{k}").collect()
        project = {m.dims: np.array(m.vectors).reshape(len(m.variances), m.dims) / np.sqrt(np.array(m.variances))[:, None] for m in models}
        white = _summed(of(fit).mapInArrow(_products(centres, project), PRODUCTS)).select("dims", "row", F.posexplode("total").alias("pos", "v")).join(sums.select("dims", "n"), "dims")
        off = F.abs(F.col("v") / F.col("n") - F.when(F.col("row") == F.col("pos"), 1.0).otherwise(0.0))
        errors = {r.dims: r.error for r in white.groupBy("dims").agg(F.max(off).alias("error")).collect()}
        model = {m.dims: (*centres[m.dims], project[m.dims], np.array(m.variances) / m.trace if len(m.variances) else np.empty(0), errors.get(m.dims)) for m in models}
        out = out.unionByName(of(rows).mapInArrow(_project(context.broadcast(model)), schema))
    return out.withColumnRenamed("id", id_col)
