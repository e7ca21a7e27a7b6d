"""Exact duplicates by Patricia tries.

Rows are dealt by length and content hash. Each partition inserts whole byte strings into a compressed radix trie, so
equality is decided on the bytes and never on the hash alone; terminals hold the owner, the smallest or largest
identifier. Copies meet once per input partition before the shuffle, so a group that holds a third of all rows sends
one row for each input partition. Documents then find their owner by an ordinary join, of which the adaptive planner
splits a hot key's side, on length and SHA-256. A trie that outgrows its memory moves its largest subtrees to a task's
own spill files, and these are finished within the same limit.

Null text counts as empty; empty texts are equal to each other. A null identifier never owns a text that another row
has too. Rows that repeat an identifier and a text all count in group_size, and all are kept if theirs is the owner.
Further columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, columns

#: Bytes of strings in a task's trie before it gives up memory.
TRIE_BYTES = 96 << 20
_NODE_BYTES = 400


class Node:
    """An edge's bytes, the nodes below by first byte, and at a terminal what is known of the text that ends here.

    A node with a run stands for a spilled subtree: the run holds what follows its edge in every string below.
    """

    __slots__ = ("below", "edge", "held", "ident", "rows", "run")

    def __init__(self, edge: bytes, ident=None, rows: int = 0, run=None):
        self.edge, self.below, self.ident, self.rows, self.run = edge, {}, ident, rows, run
        self.held = len(edge) + _NODE_BYTES


def common_prefix(key: bytes, at: int, edge: bytes) -> int:
    """How many bytes of edge stand in key from at on."""
    if key.startswith(edge, at):
        return len(edge)
    lo, hi = 0, min(len(edge), len(key) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if key.startswith(edge[lo:mid], at + lo):
            lo = mid
        else:
            hi = mid - 1
    return lo


class PatriciaTrie:
    """Owners of byte strings. better(a, b) says which of two identifiers owns.

    Beyond limit bytes the heaviest subtrees go to files of the task, and strings below them follow. Each is finished
    by a trie of its own with the same limit, which spills in turn, so memory is bounded but for the longest string.
    """

    def __init__(self, better, limit: int = TRIE_BYTES):
        self.better, self.limit, self.root, self.held, self.spilled = better, limit, Node(b""), 0, 0

    def insert(self, key: bytes, ident, rows: int = 1) -> None:
        node, at, size, path = self.root, 0, len(key), []
        while at < size:
            path.append(node)
            child = node.below.get(key[at])
            if child is None:
                child = node.below[key[at]] = Node(key[at:])
                self._grow(path, child.held)
                node, at = child, size
                break
            same = common_prefix(key, at, child.edge)
            if same < len(child.edge):
                top = Node(child.edge[:same])
                child.edge = child.edge[same:]
                top.below[child.edge[0]], node.below[key[at]] = child, top
                child.held -= same
                top.held = child.held + same + _NODE_BYTES
                self._grow(path, _NODE_BYTES)
                child = top
            elif child.run is not None:
                pickle.dump((key[at + same :], ident, rows), child.run)
                return
            node, at = child, at + same
        node.ident = ident if not node.rows else self.better(node.ident, ident)
        node.rows += rows
        if self.held > self.limit:
            self._spill()

    def _grow(self, path: list[Node], size: int) -> None:
        self.held += size
        for node in path:
            node.held += size

    def _spill(self) -> None:
        """Moves the heaviest subtree that is at most half of the trie, or a leaf beside others, to a file."""
        node, path = self.root, []
        while below := [x for x in node.below.values() if x.run is None]:
            path.append(node)
            node = max(below, key=lambda x: x.held)
            if 2 * node.held <= self.held:
                break
        if not path or all(len(x.below) == 1 and not x.rows for x in path):
            return  # nothing, or one string alone
        run = tempfile.TemporaryFile(dir=next(iter(filter(os.path.isdir, os.environ.get("SPARK_LOCAL_DIRS", "").split(","))), None))
        for rest, below in walk(node, b""):
            rest = rest[len(node.edge) :]
            if below.rows:
                pickle.dump((rest, below.ident, below.rows), run)
            for more, ident, rows in records(below.run):
                pickle.dump((rest + more, ident, rows), run)
        self.spilled += 1
        stub = Node(node.edge, run=run)
        path[-1].below[node.edge[0]] = stub
        lost = node.held - stub.held
        self.held -= lost
        for x in path:
            x.held -= lost

    def items(self) -> Iterator[tuple[bytes, object, int]]:
        """(string, owner, rows) of every string; spilled subtrees after the rest, one in memory at a time."""
        spilled = []
        for key, node in walk(self.root, b""):
            if node.rows:
                yield key, node.ident, node.rows
            if node.run is not None:
                spilled.append((key, node.run))
        self.root, self.held = Node(b""), 0
        for prefix, run in spilled:
            part = type(self)(self.better, self.limit)
            for rest, ident, rows in records(run):
                part.insert(rest, ident, rows)
            for rest, ident, rows in part.items():
                yield prefix + rest, ident, rows


def records(run) -> Iterator[tuple]:
    """What a run holds; it is closed then."""
    if run is not None:
        run.seek(0)
        while True:
            try:
                yield pickle.load(run)
            except EOFError:
                break
        run.close()


def walk(node: Node, before: bytes) -> Iterator[tuple[bytes, Node]]:
    """Every node with the string that ends there."""
    stack = [(node, before)]
    while stack:
        node, before = stack.pop()
        key = before + node.edge
        yield key, node
        stack.extend((x, key) for x in node.below.values())


def _better(keep: str):
    pick = max if keep == "largest" else min

    def better(a, b):
        return b if a is None else a if b is None else pick(a, b)

    return better


def _content_hash(text: bytes) -> int:
    return zlib.crc32(text) << 31 ^ zlib.adler32(text[::-1])


def owners(docs: DataFrame, keep: str = "largest", limit: int = TRIE_BYTES) -> DataFrame:
    """docs(id, text) -> (sha256, length, keep_id, group_size) of each text that more than one row has."""
    better = _better(keep)
    once = "length bigint, bucket bigint, text binary, id bigint, n bigint"
    twice = "sha256 string, length bigint, keep_id bigint, group_size bigint"

    def met(batches):
        trie = PatriciaTrie(better, 1 << 62)

        def rows():
            held: list[tuple] = []
            size = 0
            for key, ident, n in trie.items():
                held.append((len(key), _content_hash(key), key, ident, n))
                size += len(key)
                if size > 8 << 20:
                    yield pack(held)
                    held, size = [], 0
            if held:
                yield pack(held)

        def pack(held):
            a, b, c, d, e = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary()), pa.array(d, pa.int64()), pa.array(e, pa.int64())], names=["length", "bucket", "text", "id", "n"])

        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                part = batch.slice(i, 16)
                for ident, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    trie.insert((text or b"").translate(LOWER_BYTES), ident)
                if trie.held > limit:  # meeting before the shuffle is only to save work
                    yield from rows()
                    trie = PatriciaTrie(better, 1 << 62)
        yield from rows()

    def decide(batches):
        trie = PatriciaTrie(better, limit)
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                part = batch.slice(i, 16)
                for text, ident, n in zip(*(part.column(c).to_pylist() for c in ("text", "id", "n"))):
                    trie.insert(text, ident, n)
        for key, ident, n in trie.items():
            if n > 1:
                sha = hashlib.sha256(key).hexdigest()
                yield pa.RecordBatch.from_pydict({"sha256": [sha], "length": pa.array([len(key)], pa.int64()), "keep_id": pa.array([ident], pa.int64()), "group_size": pa.array([n], pa.int64())})

    return docs.mapInArrow(met, once).repartition("length", "bucket").mapInArrow(_batched(decide), twice)


def _batched(rows_of, size: int = 4096):
    """Joins the one-row batches of rows_of."""

    def run(batches):
        held = []
        for one in rows_of(batches):
            held.append(one)
            if len(held) == size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return run


def digests(docs: DataFrame) -> DataFrame:
    """docs(id, text) -> (id, length, sha256) of the normalised texts."""

    def run(batches):
        for batch in batches:
            lengths, shas = [], []
            for i in range(0, batch.num_rows, 256):
                for text in batch.column(1).slice(i, 256).cast(pa.binary()).to_pylist():
                    text = (text or b"").translate(LOWER_BYTES)
                    lengths.append(len(text))
                    shas.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(shas, pa.string())], names=["id", "length", "sha256"])

    return docs.mapInArrow(run, "id bigint, length bigint, sha256 string")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", limit: int = TRIE_BYTES) -> DataFrame:
    """One row per row of docs: id, keep_id (the owner), group_size, kept, text_sha256 (of the normalised text)."""
    own = columns(docs, id=id_col, text=text_col).select(F.col("id").cast("bigint"), "text")
    found = owners(own, keep, limit)
    return (
        digests(own)
        .join(found, ["sha256", "length"], "left")
        .select(
            F.col("id").alias(id_col),
            F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
            F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            F.col("sha256").alias("text_sha256"),
        )
    )
