"""Embedding near-duplicates by spherical-cap filters.

The filters are directions of a random product code: after a random rotation the coordinates fall into two halves, each
half has a code book of random unit vectors, and a pair of code words is a direction. A vector belongs to every filter
whose cap, of one height for all, holds it. List decoding finds those from the sorted scores of both halves without
looking at the other pairs. Vectors are joined on filters, and every pair of a filter's vectors is verified by its
cosine in double precision. A pair that meets in several filters counts in the smallest of them, so counts need no pairs
outside a task.

The height and the code books' size follow from the number of vectors and their length: a filter holds about BUCKET vectors if these are
spread out, and a pair at the least cosine shares MEET filters on average. A filter with more than SPLIT vectors, as
groups of near copies make, is dealt as pairs of chunks to several tasks, so no pair in it is left out.

Equal vectors form a class before the join; each class is indexed once and counts with its size. Vectors that are null,
empty, zero, or hold null or non-finite components link with nothing; vectors of different lengths do not link. Rows
that repeat an identifier are vectors of their own. Further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, components, written

COSINE, BUCKET, MEET, SPLIT, CHUNK = 0.9, 16, 6.0, 4096, 2048
SEED, LOW = 11, 8


def tail(t: float) -> float:
    return 0.5 * (1 - erf(t / sqrt(2)))


def both_tail(t: float, rho: float) -> float:
    """The chance that the second of two normal scores with correlation rho is beyond t if the first is."""
    x = np.linspace(t, t + 8, 4001)
    w = np.exp(-(x**2 - t * t) / 2)
    z = (t - rho * x) / sqrt(1 - rho**2)
    beyond = np.array([tail(v) for v in z])
    return float((w * beyond).sum() / w.sum())


def height(n: int, dim: int, cosine: float, bucket: int, meet: float) -> tuple[float, int]:
    """The caps' height as a cosine, and the number of code words of each half.

    Scores count as normal ones in more than LOW dimensions; in fewer the sphere itself is sampled, and caps are wide
    enough to hold two vectors at the least cosine.
    """
    share = min(0.25, bucket / max(n, 1))
    if dim > LOW:
        lo, hi = 0.5, 8.0
        for _ in range(40):  # filters = lists / P(beyond) = n lists / bucket, so P(beyond) = bucket / n
            t = (lo + hi) / 2
            lo, hi = (t, hi) if tail(t) > share else (lo, t)
        beyond, both, least = tail(t), both_tail(t, cosine), t / sqrt(dim)
    else:
        u = np.random.default_rng([SEED, dim, 1]).standard_normal((1 << 16, dim))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        other = cosine * u[:, 0] + sqrt(1 - cosine**2) * u[:, 1] if dim > 1 else u[:, 0]
        least = float(min(np.quantile(u[:, 0], 1 - share), 0.9 * sqrt((1 + cosine) / 2)))
        beyond = max(float((u[:, 0] >= least).mean()), 1e-4)
        both = max(float(((u[:, 0] >= least) & (other >= least)).mean()) / beyond, 0.05)
    return least, max(4, int(np.ceil(np.sqrt(meet / both / beyond))))


class Code:
    """The product code for vectors of one length; plan: number of vectors, least cosine, vectors a filter, filters a pair."""

    def __init__(self, dim: int, plan: tuple[int, float, int, float]):
        rng = np.random.default_rng([SEED, dim])
        least, words = height(plan[0], dim, *plan[1:])
        halves = (dim - dim // 2, dim // 2) if dim > LOW else (dim, 0)  # short vectors have one book of all directions
        self.dim, self.half, self.second = dim, halves[0], words if halves[1] else 1
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.books = [rng.standard_normal((words if halves[1] else words * words, halves[0])), rng.standard_normal((self.second, halves[1]))]
        for book in self.books:
            book /= np.maximum(np.linalg.norm(book, axis=1, keepdims=True), 1e-12)
        self.least = least * sqrt(2 if halves[1] else 1)  # of the sum of the halves' scores

    def filters(self, x: np.ndarray) -> list[np.ndarray]:
        """The sorted filters of each unit vector."""
        x = x @ self.rotation
        a = x[:, : self.half] @ self.books[0].T
        b = x[:, self.half :] @ self.books[1].T
        order = np.argsort(-b, axis=1)
        found = []
        for row, scores, at in zip(a, np.take_along_axis(b, order, 1), order):
            first = np.flatnonzero(row >= self.least - scores[0])
            many = np.searchsorted(-scores, -(self.least - row[first]), "right")
            second = np.concatenate([at[:k] for k in many]) if len(many) else np.zeros(0, np.int64)
            found.append(np.sort(np.repeat(first, many) * self.second + second))
        return found


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rows_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and flat values of a list column."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def entries(classes: DataFrame, plan: tuple, with_vector: bool) -> DataFrame:
    """classes(rep, size, v) -> (dim, filter[, rep, size, v])."""
    names = ["dim", "filter", *["rep", "size", "v"] * with_vector]

    def run(batches):
        codes: dict[int, Code] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                dims, flat = rows_of(part.column(2))
                ends = np.cumsum(dims)
                for dim in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == dim)
                    code = codes.get(dim) or codes.setdefault(dim, Code(dim, plan))
                    lists = code.filters(unit(np.stack([flat[ends[k] - dim : ends[k]] for k in at])))
                    take = pa.array(np.repeat(at, [len(x) for x in lists]))
                    out = [pa.array(np.full(len(take), dim), pa.int32()), pa.array(np.concatenate(lists), pa.int64())]
                    yield pa.RecordBatch.from_arrays(out + [part.column(k).take(take) for k in range(3) if with_vector], names=names)

    kind = dict(classes.dtypes)["v"]
    return classes.select("rep", "size", "v").mapInArrow(run, "dim int, filter bigint" + f", rep bigint, size bigint, v {kind}" * with_vector)


def earlier(lists: list[np.ndarray], f: int) -> np.ndarray:
    """Which of the filters below f each list holds."""
    below = [x[: np.searchsorted(x, f)] for x in lists]
    every, at = np.unique(np.concatenate(below), return_inverse=True)
    out = np.zeros((len(lists), len(every)), np.float32)
    out[np.repeat(np.arange(len(lists)), [len(x) for x in below]), at] = 1
    return out


def links_in(code: Code, f: int, rep: np.ndarray, size: np.ndarray, x: np.ndarray, side: np.ndarray | None, cosine: float):
    """(positions, links that count here, label) of the vectors of a filter that are linked there; side: only pairs across."""
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    if side is not None:
        near &= side[:, None] != side[None, :]
    at = np.flatnonzero(near.any(axis=1))
    if not len(at):
        return at, at, at
    near, own, many = near[np.ix_(at, at)], rep[at], size[at]
    mark = earlier(code.filters(x[at]), f)
    counts = ((near & (mark @ mark.T == 0)) @ many.astype(np.float64)).astype(np.int64) if mark.shape[1] else near @ many
    label, big = own.copy(), np.iinfo(np.int64).max
    while True:
        new = np.minimum(label, np.where(near, label[None, :], big).min(axis=1))
        if (new == label).all():
            return at, counts, label
        label = new


def joined(found: DataFrame, plan: tuple, cosine: float) -> DataFrame:
    """found(dim, filter, c1, c2, chunk, rep, size, v), a group per (dim, filter, c1, c2) -> (rep, n, label)."""
    names = ["rep", "n", "label"]

    def run(batches):
        codes: dict[int, Code] = {}
        held: list[pa.RecordBatch] = []

        def finish():
            group = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            if group.num_rows < 2:
                return None
            dim, f, c1, c2 = (group.column(k)[0].as_py() for k in range(4))
            code = codes.get(dim) or codes.setdefault(dim, Code(dim, plan))
            x = unit(rows_of(group.column(7))[1].reshape(-1, dim))
            side = group.column(4).to_numpy() if c1 != c2 else None
            rep, size = group.column(5).to_numpy(), group.column(6).to_numpy()
            at, n, label = links_in(code, f, rep, size, x, side, cosine)
            return (rep[at], n, label) if len(at) else None

        def out(done):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*done)], names=names)

        last, done, many = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                key = tuple(keys[:, a].tolist())
                if held and key != last and (got := finish()):
                    done.append(got)
                    many += len(got[0])
                last = key
                held.append(batch.slice(a, b - a))
            if many > 1 << 16:
                yield out(done)
                done, many = [], 0
        if held and (got := finish()):
            done.append(got)
        if done:
            yield out(done)

    keys = ["dim", "filter", "c1", "c2"]
    dealt = found.select(*keys, "chunk", "rep", "size", "v").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "rep bigint, n bigint, label bigint")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, bucket: int = BUCKET, meet: float = MEET, split: int = SPLIT) -> DataFrame:
    """A row per row of vectors: id, n_links (other vectors linked directly), component_id, kept."""
    own = columns(vectors, id=id_col, v=vector_col).select(F.col("id").cast("bigint"), "v")
    broken = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    sound = F.coalesce(F.col("id").isNotNull() & ~broken & F.exists("v", lambda x: x != 0), F.lit(False))
    marked = own.withColumn("h", F.when(sound, F.xxhash64("v")))
    classes = written(marked.where("h is not null").groupBy("h", "v").agg(F.min("id").alias("rep"), F.count("*").alias("size")))
    plan = (classes.count(), cosine, bucket, meet)

    hot = entries(classes, plan, False).groupBy("dim", "filter").count().where(F.col("count") > split)
    hot = written(hot.select("dim", "filter", F.ceil(F.col("count") / (split // 2)).cast("int").alias("k")))
    found = entries(classes, plan, True).join(hot, ["dim", "filter"], "left")
    found = found.withColumn("chunk", F.when(F.col("k").isNull(), 0).otherwise(F.pmod(F.xxhash64("rep"), F.col("k"))).cast("int"))
    others = F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)
    found = found.withColumn("other", F.explode(others)).select("*", F.least("chunk", "other").cast("int").alias("c1"), F.greatest("chunk", "other").cast("int").alias("c2"))
    met = written(joined(found, plan, cosine))

    counts = met.groupBy("rep").agg(F.sum("n").alias("n"))
    label = components(met.select(F.col("rep").alias("a"), F.col("label").alias("b")).distinct())
    known = classes.join(counts, "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("h", "v", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    out = marked.join(known, ["h", "v"], "left")
    component = F.coalesce("c", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
