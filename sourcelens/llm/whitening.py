"""Embedding whitening by cyclic Jacobi rotations.

Three aggregations in tasks: counts and exact sums of the dimensions; the scatter of the vectors, centred before they are
multiplied; and the whitened values' own covariance. A task gives one row per dimension, which Spark shuffles by dimension
and adds up, so the driver only ever sees sums of the size of the dimension, never vectors. The driver rotates the
covariance matrix until every off-diagonal entry has vanished beside the two diagonal ones that it joins, which keeps
small eigenvalues accurate, sorts the components and sends the whitening matrix (dimension times components) to the tasks.

A vector that is null, empty, or holds a null or non-finite entry, or one whose scaled value leaves 62 bits, is left out,
and so is a vector of another length than most have (ties: the longer). Rows without an identifier and rows that repeat
one are vectors of their own. Components without variance are not returned: a single vector, or equal ones, give no rows,
and so does an empty table. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, written

SCALE, SHIFT, MOST = 64.0, 1_000_000, 32
#: Rows that a task multiplies at a time.
ROWS = 4096
#: A component counts as one with variance from this part of the largest on.
LEAST = 1e-13


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column as rows."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim)


def scaled(column: pa.Array, dim: int) -> np.ndarray:
    """floor(64 c) + 1000000 as 64-bit integers."""
    return np.floor(matrix(column, dim) * SCALE).astype(np.int64) + SHIFT


def add_sums(dim: int, prepared):
    """For each task one row (part, values) for each dimension: the exact sum, as two halves of 31 bits and a rest, and the count."""

    def run(batches):
        n, total = 0, [0] * dim
        for batch in batches:
            x = prepared(batch.column(0))
            n += len(x)
            for lo in range(0, len(x), ROWS):
                part = x[lo : lo + ROWS]
                high, low = part >> 31, part & ((1 << 31) - 1)
                total = [t + (int(h) << 31) + int(k) for t, h, k in zip(total, high.sum(axis=0), low.sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([str(t) for t in total])], names=["i", "n", "total"])

    return run


def add_scatter(width: int, centred):
    """For each task the rows of the centred vectors' scatter matrix; the last entry of each row is the vectors' sum."""

    def run(batches):
        scatter, total, n = np.zeros((width, width)), np.zeros(width), 0
        for batch in batches:
            y = centred(batch.column(0))
            n += len(y)
            for lo in range(0, len(y), ROWS):
                part = y[lo : lo + ROWS]
                scatter += part.T @ part
                total += part.sum(axis=0)
        if n:
            rows = np.hstack([scatter, total[:, None]])
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(rows), pa.list_(pa.float64()))], names=["i", "row"])

    return run


def _added(batches):
    """The sum of the rows of each i."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch.column(0).to_pylist(), batch.column(1)):
            row = row.values.to_numpy()
            total[i] = total[i] + row if i in total else row.copy()
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["i", "row"])


def scatter_of(vectors: DataFrame, width: int, centred) -> tuple[np.ndarray, np.ndarray]:
    """The scatter matrix of the centred vectors and their sum, of width rows."""
    kind = "i int, row array<double>"
    rows = vectors.mapInArrow(add_scatter(width, centred), kind).repartition("i").mapInArrow(_added, kind).collect()
    rows = np.array([r.row for r in sorted(rows, key=lambda r: r.i)])
    return (rows[:, :-1] + rows[:, :-1].T) / 2, rows[:, -1]


def jacobi(a: np.ndarray, tol: float = 2.0**-53, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix.

    A sweep rotates every pair of indices once. Pairs go round as in a tournament, so the rotations of a turn touch
    different rows and are done at once. It ends when each off-diagonal entry is below tol times the geometric mean of
    its two diagonal entries, or of what rounding leaves of the trace.
    """
    n = len(a)
    size = n + n % 2
    m = np.zeros((size, size))
    m[:n, :n] = a
    v = np.eye(size)
    least = tol * tol * max(float(np.abs(np.diag(a)).sum()), np.finfo(float).tiny) if n else 0.0
    order = np.arange(size)
    for _ in range(sweeps):
        turned = False
        for _ in range(size - 1):
            p, q = order[: size // 2], order[: size // 2 - 1 : -1]
            apq, app, aqq = m[p, q], m[p, p], m[q, q]
            act = np.abs(apq) > np.maximum(tol * np.sqrt(np.abs(app)) * np.sqrt(np.abs(aqq)), least)
            if act.any():
                turned = True
                p, q, apq, app, aqq = p[act], q[act], apq[act], app[act], aqq[act]
                theta = (aqq - app) / (2 * apq)
                t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                rows_p, rows_q = m[p], m[q]
                m[p], m[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
                cols_p, cols_q = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * cols_p - s * cols_q, s * cols_p + c * cols_q
                m[p, p], m[q, q] = app - t * apq, aqq + t * apq
                m[p, q] = m[q, p] = 0.0
                v_p, v_q = v[:, p], v[:, q]
                v[:, p], v[:, q] = c * v_p - s * v_q, s * v_p + c * v_q
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
        if not turned:
            break
    e = np.diag(m)[:n]
    # The filler of an odd n is never turned: its row and column are zero.
    first = np.argsort(-e, kind="stable")
    return e[first], v[:n, :n][:, first]


def fit_list(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the vectors that take part, each of one length."""
    own = columns(rows, id=id_col, v=vector_col).where(F.col("v").isNotNull() & (F.size("v") > 0))
    good = own.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) * SCALE >= float(1 << 61))))
    usual = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return good.where(F.size("v") == (usual[0].d if usual else 0))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MOST) -> DataFrame:
    """For each vector that takes part: id, n, deviation decimal(38, 0), whitened array<double>, explained array<double>
    and identity_error, with an entry of the arrays for each of the largest components, most at most.

    deviation is the exact sum over dimensions of (n x - S)^2, null beyond 38 digits.
    """
    spark = rows.sparkSession
    kind = "id bigint, n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    own = fit_list(rows, id_col, vector_col)
    head = own.select(F.size("v").alias("d")).first()
    if head is None:
        return spark.createDataFrame([], kind)
    dim = head.d
    sums = own.select("v").mapInArrow(add_sums(dim, lambda c: scaled(c, dim)), "i int, n bigint, total string")
    sums = sums.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("i").collect()
    n, total = sums[0].n, [int(r.total) for r in sums]
    whole = np.array([t // n for t in total], np.int64)
    rest = np.array([(t % n) / n for t in total])

    def centre(c):
        return (scaled(c, dim) - whole).astype(np.float64) - rest

    cov = scatter_of(own.select("v"), dim, centre)[0] / n
    e, vectors = jacobi(cov)
    count = int((e[:most] > LEAST * max(e[0], 0)).sum()) if e[0] > 0 else 0
    if not count:
        return spark.createDataFrame([], kind)
    turn = spark.sparkContext.broadcast(vectors[:, :count] / np.sqrt(e[:count]))
    sums_of = [t - n * int(w) for t, w in zip(total, whole)]

    def deviation(x: np.ndarray) -> list[int]:
        y = x - whole
        bound = (int(np.abs(y).max(initial=0)) + 1) * n
        if bound * bound * dim < 1 << 63:
            return ((n * y - np.array(sums_of, np.int64)) ** 2).sum(axis=1).tolist()
        return [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums_of)) for row in y]

    def project(batches):
        for batch in batches:
            x = scaled(batch.column(1), dim)
            w = ((x - whole).astype(np.float64) - rest) @ turn.value
            exact = pa.array([str(k) for k in deviation(x)], pa.string())
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * count, pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), exact, values], names=["id", "deviation", "whitened"])

    found = written(own.select(F.col("id").cast("bigint"), "v").mapInArrow(project, "id bigint, deviation string, whitened array<double>"))
    plain = found.select("whitened")
    mean = scatter_of(plain, count, lambda c: matrix(c, count))[1] / n
    error = float(np.abs(scatter_of(plain, count, lambda c: matrix(c, count) - mean)[0] / n - np.eye(count)).max())
    share = [float(x) for x in e[:count] / np.trace(cov)]
    return found.select(
        "id", F.lit(n).cast("bigint").alias("n"), F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"), "whitened",
        F.array(*map(F.lit, share)).alias("explained"), F.lit(error).alias("identity_error"),
    )


def whitened_rows(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MOST) -> DataFrame:
    """whiten() as a row for each vector and component; deviation as a 64-bit integer, null where it does not fit."""
    both = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "both")
    out = whiten(rows, id_col, vector_col, most).select("id", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "identity_error", both)
    return out.select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("both.whitened").alias("whitened"), F.col("both.explained").alias("explained"), "identity_error",
    )
