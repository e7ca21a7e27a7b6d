"""Substrings of LENGTH bytes that occur twice, by blockwise suffix sorting with a difference cover.

Only the order of suffixes by their first LENGTH bytes matters: two suffixes that tie there begin the same substring. The
cover sample holds the suffixes whose place in their document, modulo v, lies in a perfect difference set. For any two
suffixes there is a shift below v that takes both into the sample, so if they tie, the shifted ones tie on the first
LENGTH - v + 1 bytes.

1. The sample is ranked first, one bucket of it at a time. A rank is shared by samples that tie on those bytes. Within a
   rank the context, v - 1 bytes before and LENGTH after, is compared as well. That settles most suffixes: samples that are alone
   say nothing starts before them that ties; a context that several samples have proves the suffixes before all of them.
2. Suffixes near a rank with different contexts are the long ties that stay open. They are dealt into buckets and each
   bucket is sorted by itself, so a task never holds more than one. Of suffixes that a common context has settled, one
   holder of the context sends its own, for others to tie with.
3. Each document's bytes below a tied suffix go.

Keys are fingerprints: 64 bits for a rank and 64 more for a context within it, 96 bits for an open suffix. Equal bytes always
have equal fingerprints, so no tie is missed; suffixes that differ count as tied with a chance of 2^-64 a pair or less.

Documents are dealt into chunks, which grow with the input so that there are at most CHUNKS or so (a longer document is
a chunk of its own). A chunk sends each key once, however many of its documents have it, so a passage or a copy that a
third of all rows share has at most one entry a chunk in its bucket, and gets an answer for each chunk. Texts are never dealt by
content. Chunks and answers are written tables, so lost executors cost single tasks.

Null text counts as empty. Rows that repeat, or have no identifier, are documents of their own: a repeated row of LENGTH bytes or
more is removed whole, both times. Further columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, columns, freed, mix, scratch, written

LENGTH = 400
#: Perfect difference sets: each difference modulo v, but 0, is that of exactly one pair. Fixed values.
COVERS = {
    7: (1, 2, 4),
    21: (3, 6, 7, 12, 14),
    73: (1, 2, 4, 8, 16, 32, 37, 55, 64),
    273: (1, 2, 4, 8, 16, 32, 64, 91, 117, 128, 137, 182, 195, 205, 234, 239, 256),
}
#: Bytes hashed at a time; least bytes of a chunk; most chunks, but for long documents; bytes of keys that a bucket should have.
PIECE, CHUNK, CHUNKS, BUCKET = 1 << 20, 1 << 20, 1 << 20, 48 << 20
_rng = np.random.default_rng(97)
_TABLES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [0x9E3779B97F4A7C15 | 5, 0xD1342543DE82EF95 | 5]
_INVERSES = [pow(b, -1, 1 << 64) for b in _BASES]
_powers: dict[int, np.ndarray] = {}
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^n modulo 2^64."""
    if base not in _powers or len(_powers[base]) <= n:
        p = np.full(n + 1, np.uint64(base))
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][: n + 1]


class Windows:
    """Fingerprints of any window of some bytes, from prefix sums of byte values times powers of a base."""

    def __init__(self, data: np.ndarray, kind: int):
        self.inverse = powers(_INVERSES[kind], len(data))
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[kind][data] * powers(_BASES[kind], len(data))[:-1], out=self.prefix[1:])

    def __call__(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix((self.prefix[at + size] - self.prefix[at]) * self.inverse[at] + np.asarray(size).astype(np.uint64) * _ODD)


class Chunk:
    """The bytes of some documents, and the cover sample of theirs."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, length: int):
        self.data, self.offs, self.length = data, offs, length
        self.v = max((v for v in COVERS if 10 * v <= 7 * length), default=7)
        self.rank = length - self.v + 1
        self.cover = np.zeros(self.v, bool)
        self.cover[list(COVERS[self.v])] = True

    def pieces(self):
        """(first, after the last) of runs of at most PIECE bytes."""
        for lo in range(0, len(self.data), PIECE):
            yield lo, min(lo + PIECE, len(self.data))

    def around(self, lo: int, hi: int, kind: int) -> tuple[int, Windows]:
        """Fingerprints of windows near a piece, and where they begin."""
        first = max(0, lo - self.v)
        return first, Windows(self.data[first : hi + self.length], kind)

    def places(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of a piece the bytes of its document before it, and those from it on."""
        a, b = int(np.searchsorted(self.offs, lo, "right")) - 1, int(np.searchsorted(self.offs, hi, "left"))
        edges = np.clip(self.offs[a : b + 1], lo, hi)
        at, sizes = np.arange(lo, hi), np.diff(edges)
        return at - np.repeat(self.offs[a:b], sizes), np.repeat(self.offs[a + 1 : b + 1], sizes) - at

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the cover sample, what of the context's bytes before them there is, and the fingerprints of rank and context."""
        found = []
        for lo, hi in self.pieces():
            before, after = self.places(lo, hi)
            at = np.flatnonzero(self.cover[before % self.v] & (after >= self.rank))
            left, right = np.minimum(before[at], self.v - 1), np.minimum(after[at], self.length)
            first, ranks = self.around(lo, hi, 0)
            at += lo
            keys = ranks(at - first, self.rank)
            _, contexts = self.around(lo, hi, 1)
            found.append((at, left, keys, contexts(at - first - left, left + right) ^ mix(left.astype(np.uint64) + np.uint64(1))))
        none = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 2
        return tuple(np.concatenate(x) for x in zip(none, *found))

    def marks(self, at: np.ndarray, left: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Which bytes of a piece begin less than v bytes before one of the samples at `at` (sorted), in its document."""
        a, b = np.searchsorted(at, [lo, hi + self.v])
        edge = np.bincount(np.clip(at[a:b] - left[a:b], lo, hi) - lo, minlength=hi - lo + 1) - np.bincount(np.clip(at[a:b] + 1, lo, hi) - lo, minlength=hi - lo + 1)
        return np.cumsum(edge[:-1]) > 0

    def open_suffixes(self, proven: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys (two parts) of the suffixes that asked marks, and their places in that order."""
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))]
        for lo, hi in self.pieces():
            at = np.flatnonzero(asked[lo:hi]) + lo
            if len(at):
                first, one = self.around(lo, hi, 0)
                high = one(at - first, self.length)
                _, two = self.around(lo, hi, 1)
                found.append((high, two(at - first, self.length).astype(np.uint32), at))
        high, low, at = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((low, high))
        return high[order], low[order], at[order]


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Which entries of sorted keys differ from the one before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def counts(new: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each entry the sum of weights in its group; new marks the groups' first entries."""
    at = np.flatnonzero(new)
    return np.repeat(np.add.reduceat(weight, at), np.diff(np.append(at, len(new)))) if len(at) else np.zeros(0, weight.dtype)


def by_bucket(high: np.ndarray, bits: int):
    """(bucket, first, after the last) of sorted keys; a key's leading bits are its bucket."""
    edges = np.searchsorted(high, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    for bucket, (a, b) in enumerate(zip([0, *edges.tolist()], [*edges.tolist(), len(high)])):
        if b > a:
            yield bucket, a, b


def chunk_of(row, length: int) -> Chunk:
    """A chunk from its texts, a list of binary values."""
    flat = row.values
    n = len(flat)
    offs = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + n + 1].astype(np.int64)
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    return Chunk(data, offs - offs[0], length)


KEYS = "bucket int, chunk bigint, kind int, data binary"
_KEYS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])


def key_rows(chunk: int, high: np.ndarray, low: np.ndarray, several: np.ndarray, bits: int) -> list[tuple]:
    return [(k, chunk, 0, high[a:b].tobytes() + low[a:b].tobytes() + np.packbits(several[a:b]).tobytes()) for k, a, b in by_bucket(high, bits)]


def record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def chunked(limit: int):
    """Rows to chunks of about limit bytes."""
    from pyspark import TaskContext

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).fill_null("").cast(pa.binary())
            for lo, hi, data, _ in blocks(batch.column(1), limit):
                lists = [pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), pa.concat_arrays([x.slice(lo, hi - lo)])) for x in (ids, texts)]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(data)], pa.int64()), *lists], names=["chunk", "n_bytes", "ids", "texts"])
                number += 1

    return run


def sampled(length: int, bits: int):
    """The distinct ranks and contexts of each chunk's cover sample."""

    def run(batches):
        for batch in batches:
            for chunk, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, _, rank, context = chunk_of(row, length).samples()
                order = np.lexsort((context, rank))
                rank, context = rank[order], context[order]
                new = firsts(rank, context)
                several = counts(new, np.ones(len(new), np.int64))[new] > 1
                if len(rank):
                    yield record(key_rows(chunk, rank[new], context[new], several, bits), _KEYS)

    return run


def gathered(batches, width: int):
    """All keys of a task's bucket: (chunks, sizes, high, low, several), and what is only passed on."""
    chunks, sizes, parts, passed = [], [], [], []
    for batch in batches:
        for bucket, chunk, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
            if kind:
                passed.append((bucket, chunk, kind, data))
                continue
            n = len(data) * 8 // (8 * (8 + width) + 1)
            high, low = np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint64 if width == 8 else np.uint32, n, 8 * n)
            parts.append((high, low, np.unpackbits(np.frombuffer(data, np.uint8, -1, (8 + width) * n), count=n)))
            chunks.append((bucket, chunk))
            sizes.append(n)
    if not parts:
        return [], [], None, None, None, passed
    return chunks, sizes, *(np.concatenate(x) for x in zip(*parts)), passed


def answers(chunks: list, sizes: list, states: np.ndarray) -> list[tuple]:
    ends = np.cumsum([0, *sizes]).tolist()
    return [(bucket, chunk, 0, states[a:b].tobytes()) for (bucket, chunk), a, b in zip(chunks, ends, ends[1:])]


#: What is known before a sample: nothing ties; all tie; all tie, others may tie with them (sent by another, by this chunk); open.
ALONE, TIED, TIED_ELSEWHERE, TIED_SENT, OPEN = range(5)


def ranked(batches):
    """The state of each entry of a bucket of the sample."""
    chunks, sizes, rank, context, several, _ = gathered(batches, 8)
    if not chunks:
        return
    order = np.lexsort((context, rank))
    rank, context, weight = rank[order], context[order], several[order].astype(np.int64) + 1
    new_rank, new = firsts(rank), firsts(rank, context)
    in_rank, in_context, kinds = counts(new_rank, weight), counts(new, weight), counts(new_rank, new.astype(np.int64))
    state = np.select([in_rank == 1, kinds == 1, in_context == 1, new], [ALONE, TIED, OPEN, TIED_SENT], TIED_ELSEWHERE)
    out = np.empty(len(state), np.uint8)
    out[order] = state
    rows = answers(chunks, sizes, out)
    for lo in range(0, len(rows), 512):
        yield record(rows[lo : lo + 512], _KEYS)


def sorted_buckets(batches):
    """Which keys of a bucket of suffixes occur twice; what else a chunk has to say is passed on."""
    chunks, sizes, high, low, several, rows = gathered(batches, 4)
    if chunks:
        order = np.lexsort((low, high))
        new = firsts(high[order], low[order])
        out = np.empty(len(order), np.uint8)
        out[order] = counts(new, several[order].astype(np.int64) + 1) > 1
        rows = rows + answers(chunks, sizes, out)
    for lo in range(0, len(rows), 512):
        yield record(rows[lo : lo + 512], _KEYS)


def in_order(table: pa.Table, kind: int) -> list[bytes]:
    """The data of a chunk's rows of a kind, by bucket."""
    rows = sorted(zip(table["bucket"].to_pylist(), table["kind"].to_pylist(), table["data"].to_pylist()), key=lambda r: r[0])
    return [data for _, k, data in rows if k == kind]


def settled(length: int, bits: int, spread: int):
    """A chunk's open suffixes as keys; which suffixes are proven and which were asked for, as bits (kind 1)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _KEYS.empty_table()
        number = left["chunk"][0].as_py()
        chunk = chunk_of(left["texts"].combine_chunks()[0], length)
        at, before, rank, context = chunk.samples()
        order = np.lexsort((context, rank))
        states = np.frombuffer(b"".join(in_order(right, 0)), np.uint8)
        state = np.empty(len(at), np.uint8)
        state[order] = states[np.cumsum(firsts(rank[order], context[order])) - 1]
        proven, asked = np.zeros(len(chunk.data), bool), np.zeros(len(chunk.data), bool)
        tied, sent = (state > ALONE) & (state < OPEN), state >= TIED_SENT
        for lo, hi in chunk.pieces() if tied.any() or sent.any() else ():
            fits = chunk.places(lo, hi)[1] >= length
            proven[lo:hi] = chunk.marks(at[tied], before[tied], lo, hi) & fits
            asked[lo:hi] = chunk.marks(at[sent], before[sent], lo, hi) & fits
        rows = []
        if asked.any():
            high, low, _ = chunk.open_suffixes(proven, asked)
            new = firsts(high, low)
            several = counts(new, np.ones(len(new), np.int64))[new] > 1
            rows = key_rows(number, high[new], low[new], several, bits)
        if proven.any() or asked.any():
            home = int(mix(np.array([number], np.uint64))[0] % np.uint64(spread))
            rows.append((home, number, 1, np.packbits(proven).tobytes() + np.packbits(asked).tobytes()))
        return pa.Table.from_batches([record(rows, _KEYS)]) if rows else _KEYS.empty_table()

    return run


RESULT = "id bigint, n_bytes bigint, spans array<struct<start: bigint, length: bigint>>, kept binary"
_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])
_RESULT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(_SPAN)), ("kept", pa.binary())])


def covered(chunk: Chunk, tied: np.ndarray) -> np.ndarray:
    """Which bytes lie below a tied suffix's first LENGTH bytes."""
    out, last = np.zeros(len(tied), bool), -chunk.length
    for lo, hi in chunk.pieces():
        at = np.arange(lo, hi)
        near = np.maximum.accumulate(np.where(tied[lo:hi], at, last))
        out[lo:hi] = at - near < chunk.length
        last = int(near[-1])
    return out


def removed(length: int):
    """The documents of a chunk without what is covered."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _RESULT.empty_table()
        chunk = chunk_of(left["texts"].combine_chunks()[0], length)
        n, ids, offs = len(chunk.data), left["ids"].combine_chunks()[0].values, chunk.offs
        gone = np.zeros(n, bool)
        for bits in in_order(right, 1):
            half = (n + 7) // 8
            proven = np.unpackbits(np.frombuffer(bits, np.uint8, half), count=n).astype(bool)
            asked = np.unpackbits(np.frombuffer(bits, np.uint8, half, half), count=n).astype(bool)
            if asked.any():
                high, low, at = chunk.open_suffixes(proven, asked)
                found = np.frombuffer(b"".join(in_order(right, 0)), bool)
                proven[at[found[np.cumsum(firsts(high, low)) - 1]]] = True
            gone = covered(chunk, proven)
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        start = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])))
        end = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
        owner = np.searchsorted(offs, start, "right") - 1
        fields = [pa.array(start - offs[owner]), pa.array(end - start)]
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(offs))), pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_SPAN)))
        keep = chunk.data[~gone]
        at = offs - np.concatenate([[0], np.cumsum(gone)])[offs]
        kept = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(keep.tobytes())])
        return pa.Table.from_arrays([ids, pa.array(np.diff(offs)), lists, kept], schema=_RESULT)

    return run


def _chunks(spark: SparkSession, docs: DataFrame, limit: int) -> DataFrame:
    """docs as a written table of chunks, in row groups of a few chunks so that tasks read few at a time."""
    kind, path = "chunk bigint, n_bytes bigint, ids array<bigint>, texts array<binary>", scratch(spark)
    docs.mapInArrow(chunked(limit), kind).write.option("parquet.block.size", 16 << 20).option("compression", "zstd").parquet(path)
    return spark.read.schema(kind).parquet(path)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """For each document: id, n_bytes, spans (start, length) of the bytes that are removed, and kept, the other bytes.

    A byte is removed if a string of `length` bytes that covers it starts anywhere else too, in its document or another.
    length: at least 10.
    """
    if length < 10:
        raise ValueError("length must be at least 10")
    spark = docs.sparkSession
    own = columns(docs, id=id_col, text=text_col).select(F.col("id").cast("bigint"), "text")
    total = own.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    chunks = _chunks(spark, own, max(CHUNK, total // CHUNKS))
    v = Chunk(np.zeros(0, np.uint8), np.zeros(1, np.int64), length).v
    bits = max(5, int(total * 16 * len(COVERS[v]) // v // BUCKET).bit_length())
    ranks = chunks.select("chunk", "texts").mapInArrow(sampled(length, bits), KEYS).repartitionById(1 << bits, "bucket")
    with freed(spark):
        ranks = written(ranks.mapInArrow(ranked, KEYS))
    more = max(6, int(total * 3 // BUCKET).bit_length())  # a quarter of all suffixes would fill the buckets
    texts = chunks.select("chunk", "texts").groupBy("chunk")
    states = texts.cogroup(ranks.groupBy("chunk")).applyInArrow(settled(length, more, 1 << more), KEYS)
    with freed(spark):
        states = written(states.repartitionById(1 << more, "bucket").mapInArrow(sorted_buckets, KEYS))
    return chunks.select("chunk", "ids", "texts").groupBy("chunk").cogroup(states.groupBy("chunk")).applyInArrow(removed(length), RESULT)
