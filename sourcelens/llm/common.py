"""What the operators of this folder share: scratch tables, word and shingle hashing, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text hashed at a time; a longer document is a block of its own.
BLOCK = 1 << 20
#: Words hashed at a time, and bytes that Spark hands Python at a time while a table is written.
SLICE_WORDS, BATCH_BYTES = 1 << 12, 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LOWER = np.frombuffer(LOWER_BYTES, np.uint8)
_SEP = np.zeros(256, bool)
_SEP[[32, *range(9, 14)]] = True
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_SEP] = 0
_BYTE = np.where(_SEP, np.uint64(0), _BYTE[_LOWER])
_PLACE = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; where that is unset, an own one of a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(spark.sparkContext, "_own_scratch", None) or f"file://{tempfile.mkdtemp(prefix='scratch')}"
        spark.sparkContext._own_scratch = base
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession):
    """Queries that run inside hand rows to Python by BATCH_BYTES, so neither side holds more of wide rows at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(BATCH_BYTES))
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a table in the scratch folder: lineage is cut and lost executors cost no recomputation."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Asks the driver to forget what nothing refers to, so that executors delete the shuffles of finished rounds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def freed(spark: SparkSession):
    """Queries that run inside delete their shuffle files when they end; what they gave must be written by then."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "true")
        yield
    finally:
        spark.conf.set(key, before)


def columns(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the given names; further columns, clashing or not, stay out."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in names.items()])


def blocks(texts: pa.Array, limit: int = BLOCK):
    """(first row, row after the last, bytes, offsets) of runs of rows with about limit bytes. Null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which words start, and for each document the number of words before it (and the total)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~_SEP[data]
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    edge = offs[:-1][offs[:-1] < len(data)]
    new[edge] = inside[edge]
    starts = np.flatnonzero(new)
    return starts, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near inputs get unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each lower-cased word, and the documents' first words as in word_spans."""
    starts, first = word_spans(data, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    ends = np.append(starts[1:], len(data))
    power = np.full(int((ends - starts).max()), _BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    out = np.empty(len(starts), np.uint64)
    for lo in range(0, len(starts), SLICE_WORDS):  # what is held for each byte stays small
        at = starts[lo : lo + SLICE_WORDS]
        until = ends[lo : lo + SLICE_WORDS]
        place = np.arange(at[0], until[-1]) - np.repeat(at, until - at)
        out[lo : lo + SLICE_WORDS] = np.add.reduceat(_BYTE[data[at[0] : until[-1]]] * power[place], at - at[0])
    return mix(out), first


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """The hash of each run of width words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * _PLACE[0]
    for k in range(1, width):
        out += words[k : n + k] * _PLACE[k]
    return mix(out)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = 5):
    """For each document its sorted distinct shingle hashes; fewer words than width make one shingle, none make none."""
    words, first = word_hashes(data, offs)
    runs = shingle_hashes(words, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            short = np.uint64(0)
            for k in range(b - a):
                short = short + words[a + k : a + k + 1] * _PLACE[k]
            yield mix(short ^ np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


#: Up to so many distinct edges are joined up in one task; more go through the distributed steps.
LOCAL_EDGES = 1 << 18


def joined_up(batches):
    """(node, component) of all edges (a, b) of a task."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(a), top(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    for lo in range(0, len(nodes), 1 << 16):
        part = nodes[lo : lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([top(x) for x in part], pa.int64())], names=["node", "component"])


def components(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node reachable.

    A number of edges with a checked bound is joined up in one task. More edges go through steps that alternate
    large stars and small stars; each is an aggregation and a join on written tables, so a hub with very many links is
    pre-aggregated and its join side is split by the adaptive planner.
    """
    def settled(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = written(df.distinct())
        return df, tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    cur, mark = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    if mark[0] <= local:
        return written(cur.coalesce(1).mapInArrow(joined_up, "node bigint, component bigint"))
    while mark[0]:
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        new = small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        cur, now = settled(new)
        if now == mark:
            break
        mark = now
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
