"""Order-preserving packing of token streams into windows by dynamic programming.

Each input partition keeps its documents' order and is packed on its own, without a shuffle: a window may end at a
document's end (free), at a sentence's end (small penalty) or, inside a stretch without either, on a fixed grid (large
penalty). With boundaries b and window size W the best cost is

    f(j) = penalty(j) + W - b_j + min { f(i) + b_i : b_j - b_i <= W },

a sliding-window minimum, kept in a monotone queue: linear time in boundaries. What is left at the end of a run goes to
windows whose lengths are powers of two, which need no padding. Runs end after RUN tokens, so memory has a bound.

Null text is an empty document, which is its end token alone. Documents of any length are cut freely. Sequence numbers
hold the input partition's number and the window's, so a repeated task gives the same rows. Rows that repeat an
identifier are documents of their own. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns

WINDOW, RUN = 2048, 1 << 20
#: Penalties in padded tokens of a cut at a sentence's end and inside one; a stretch without ends has a grid of window // GRID.
GRID = 64
SENTENCE, INSIDE = 4, 12


def boundaries(ids: np.ndarray, ends: np.ndarray, sentence: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, from 0 on, and what a cut there costs. ends: where documents end."""
    step = max(1, window // GRID)
    stop = sentence[ids]
    stop[:-1] &= ~stop[1:]
    at = np.union1d(np.flatnonzero(stop) + 1, np.append(ends, 0))
    gaps = np.diff(at)
    cost = np.full(len(at), SENTENCE, np.int64)
    if (long := np.flatnonzero(gaps > step)).size:
        grid = np.concatenate([np.arange(at[k] + step, at[k + 1], step) for k in long])
        at = np.concatenate([at, grid])
        cost = np.concatenate([cost, np.full(len(grid), INSIDE, np.int64)])
        order = np.argsort(at, kind="stable")
        at, cost = at[order], cost[order]
    cost[np.searchsorted(at, ends)] = 0
    return at, cost


def best_cuts(at: np.ndarray, cost: np.ndarray, window: int) -> list[int]:
    """Indices into at of the chosen window ends, the last one left out if what follows has no full windows."""
    at_, cost_ = at.tolist(), cost.tolist()
    back = [0] * len(at_)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f(i) + b_i, i), rising in both
    pop, popleft, push = queue.pop, queue.popleft, queue.append
    for j in range(1, len(at_)):
        b = at_[j]
        low = b - window
        while at_[queue[0][1]] < low:
            popleft()
        key, back[j] = queue[0]
        key += cost_[j] + window
        while queue and queue[-1][0] >= key:
            pop()
        push((key, j))
    cuts, j = [], len(at_) - 1
    # The end of the run is cut into powers of two, without padding: the best place from which to do so.
    low = at_[j] - window
    k = j
    best, tail = None, j
    while k >= 0 and at_[k] >= low:
        left = at_[j] - at_[k]
        value = _cost_to(k, at_, cost_, back, window) if best is None or left.bit_count() <= 6 else None
        if value is not None:
            value += 24 * max(0, left.bit_count() - 1)
            if best is None or value < best:
                best, tail = value, k
        k -= 1
        if j - k > 48:
            break
    j = tail
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def _cost_to(k: int, at: list[int], cost: list[int], back: list[int], window: int) -> int:
    """The cost of the last windows that end at boundary k; earlier ones differ little between near boundaries."""
    total = 0
    for _ in range(4):
        if not k:
            break
        total += cost[k] + window - (at[k] - at[back[k]])
        k = back[k]
    return total


def pack_run(ids: np.ndarray, ends: np.ndarray, sentence: np.ndarray, window: int) -> np.ndarray:
    """Ends of the windows of one run of tokens."""
    at, cost = boundaries(ids, ends, sentence, window)
    cuts = at[best_cuts(at, cost, window)] if len(at) > 1 else np.zeros(0, np.int64)
    at_end, left = int(cuts[-1]) if len(cuts) else 0, []
    rest = len(ids) - at_end
    while rest:
        part = min(window, 1 << (rest.bit_length() - 1))
        at_end += part
        rest -= part
        left.append(at_end)
    return np.concatenate([cuts, np.array(left, np.int64)])


def byte_bpe(path: str) -> tuple[Callable[[str], np.ndarray], np.ndarray]:
    """The encoder of a byte-level BPE and the ids that end a sentence. path: its tokenizers file.

    The same merges run in tiktoken, which takes a fifth of the time; tests hold its ids against tokenizers' own.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    enc = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    ends = np.zeros(max([*ranks.values(), *special.values()]) + 1, bool)
    for piece, i in ranks.items():
        ends[i] = piece.rstrip(b" \"')")[-1:] in (b".", b"!", b"?", b"\n")
    some = tuple(special)

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in some):
            return enc.encode_to_numpy(text, allowed_special="all")
        return np.array(enc._core_bpe.encode_ordinary(text), np.uint32)

    return encode, ends


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 1, run: int = RUN, with_ids: bool = False) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids the piece's ids.

    The tokenizer file is opened where tasks run; its path is the same on all machines, like a library's.
    """
    fields = [(id_col, pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)

    def pieces(idents, streams, sequence, sentence_ends):
        """The rows of one run. streams: (ids, the document's ids before them, the document's number of ids)."""
        ends = np.cumsum([len(x) for x, _, _ in streams])
        ids = np.concatenate([x for x, _, _ in streams])
        cuts = pack_run(ids, ends, sentence_ends, window)
        marks = np.union1d(cuts, ends)
        lo = np.concatenate([[0], marks[:-1]])
        doc, seq = np.searchsorted(ends, lo, "right"), np.searchsorted(cuts, lo, "right")
        seq_start, doc_start = np.concatenate([[0], cuts])[seq], np.concatenate([[0], ends])[doc]
        before, total = np.array([s for _, s, _ in streams]), np.array([t for _, _, t in streams])
        raw = ids.astype("<u4").tobytes()
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), marks.tolist())]
        arrays = [pa.array([idents[d] for d in doc.tolist()], pa.int64()), lo - doc_start + before[doc], marks - lo, np.array(crc, np.int64), total[doc], sequence + seq, lo - seq_start]
        if with_ids:
            arrays.append(pa.array([ids[a:b].tolist() for a, b in zip(lo, marks)], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in arrays], schema=schema), len(cuts)

    def run_partition(batches):
        encode, sentence_ends = byte_bpe(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 40
        idents, streams, held = [], [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                for ident, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.append(encode(text or ""), np.uint32(end_id)).astype(np.uint32)
                    for at in range(0, len(ids), run):
                        idents.append(ident)
                        streams.append((ids[at : at + run], at, len(ids)))
                        held += len(streams[-1][0])
                        if held >= run:
                            out, n = pieces(idents, streams, sequence, sentence_ends)
                            sequence += n
                            idents, streams, held = [], [], 0
                            yield out
        if streams:
            yield pieces(idents, streams, sequence, sentence_ends)[0]

    own = columns(docs, id=id_col, text=text_col).select(F.col("id").cast("bigint"), "text")
    return own.mapInArrow(run_partition, ", ".join(f"`{n}` bigint" for n, _ in fields) + ", ids array<bigint>" * with_ids)
