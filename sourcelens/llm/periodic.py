"""Runs of words that repeat with a period, by matching aligned blocks.

A run is a stretch of words that are identical a period apart, has at least three periods and LEAST words, and can't be
extended. A run whose period lies in [s, 2s), for a power of two s, holds a block of s words at a multiple of s that
occurs a period earlier too. So for every scale an Aho-Corasick automaton over the words' numbers holds the aligned blocks
and searches the document before them; an occurrence at a distance of that scale is a seed, which is extended to
both sides word by word. The smallest scale also takes the distances below it, since LEAST words hold such a block for them.

Blocks are only taken from stretches in which every run of eight words has occurred before at most so far back as
the scale allows, which inside a run holds for all but its first period; and blocks well inside a run of a much smaller
period are left out, since they only occur at multiples of it. Seeds that prefix hashes show to be too short are not
extended. All of these tests let every true seed pass; hashes decide about no result.

Each document is judged by itself and whole, in the task that reads it; nothing is shuffled, and there is no group that
could be hot. Automata hold at most GROUP words at a time, or one block. Null text counts as empty, and has no words and no runs;
rows that repeat are judged one by one, further columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, mix

LEAST, TIMES, GRAM = 24, 3, 8
#: Words of blocks in one automaton.
GROUP = 1 << 16
#: Bytes of texts that a task gives back at a time.
PIECE = 1 << 22
_ODD = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def back_distances(ids: np.ndarray) -> np.ndarray:
    """For each run of GRAM words the distance to the last equal one before, or the number of words where there is none."""
    code = mix(ids.astype(np.uint64) + np.uint64(1))
    for step in (1, 2, 4):
        code = mix(code[:-step] * _ODD + code[step:])
    order = np.argsort(code, kind="stable")
    back = np.full(len(code), len(ids), np.int64)
    same = np.flatnonzero(code[order[1:]] == code[order[:-1]])
    back[order[same + 1]] = order[same + 1] - order[same]
    return back


def stretches(flags: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first, after the last) of the stretches of at least so many flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= least]


def seeds(ids: np.ndarray, blocks: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, b): aligned blocks b of the list, and where their words occur earlier at a distance that suits the scale."""
    xs, bs = [], []
    step = max(1, GROUP // scale)
    lo = 0
    while lo < len(blocks):
        # Neighbours share an automaton; a gap begins a new one, so nothing between stretches is searched.
        gaps = np.flatnonzero(np.diff(blocks[lo : lo + step]) > 4 * scale)
        hi = min(len(blocks), lo + (int(gaps[0]) + 1 if len(gaps) else step))
        group = blocks[lo:hi]
        lo = hi
        first, last = max(0, int(group[0]) - 2 * scale + 1), int(group[-1]) + scale
        window = tuple(ids[first:last].tolist())
        held = np.full((last - first) // scale + 2, -1, np.int64)
        base = int(group[0]) // scale
        found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for b in group.tolist():
            key = window[b - first : b - first + scale]
            number = found.get(key, None)
            if number is None:
                number = b
                found.add_word(key, b)
            held[b // scale - base] = number
        found.make_automaton()
        hits = np.array(list(found.iter(window)), np.int64).reshape(-1, 2)
        x, number = hits[:, 0] - scale + 1 + first, hits[:, 1]
        nearest = [x + scale] if scale > GRAM else [x + 1, x + 1 + scale]
        for at in nearest:
            b = -(-at // scale) * scale
            slot = b // scale - base
            good = (slot >= 0) & (slot < len(held)) & (b - x < 2 * scale)
            good[good] = held[slot[good]] == number[good]
            xs.append(x[good])
            bs.append(b[good])
    if not xs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(xs), np.concatenate(bs)


def agreeing(ids: np.ndarray, a: int, b: int) -> int:
    """How many words from a on equal those from b on, a < b."""
    done, size = 0, 64
    while b + done < len(ids):
        n = min(size, len(ids) - b - done)
        bad = np.flatnonzero(ids[a + done : a + done + n] != ids[b + done : b + done + n])
        if len(bad):
            return done + int(bad[0])
        done += n
        size = min(2 * size, 1 << 20)
    return done


def agreeing_back(ids: np.ndarray, a: int, b: int) -> int:
    """How many words before a equal those before b, a < b."""
    done, size = 0, 64
    while a - done > 0:
        n = min(size, a - done)
        bad = np.flatnonzero(ids[a - done - n : a - done] != ids[b - done - n : b - done])
        if len(bad):
            return done + n - 1 - int(bad[-1])
        done += n
        size = min(2 * size, 1 << 20)
    return done


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a document's words, given by numbers; sorted by start, then period."""
    n = len(ids)
    if n < LEAST:
        return []
    back = back_distances(ids)
    if int(back.min()) == n:
        return []
    power = np.full(n + 1, _ODD, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
    found: dict[tuple[int, int], int] = {}
    scale = GRAM
    while TIMES * scale <= n:
        skip = np.zeros(n // scale + 2, bool)
        for (start, end), period in found.items():
            if 2 * period <= scale and end - start >= 3 * scale:
                skip[-(-(start + 2 * scale) // scale) : (end - scale) // scale + 1] = True
        parts = [np.zeros(0, np.int64)]
        for a, b in stretches(back < 2 * scale, 2 * scale - GRAM + 1):
            mine = np.arange(-(-a // scale), (b + GRAM - 1 - scale) // scale + 1)
            parts.append(mine[~skip[mine]] * scale)
        x, b = seeds(ids, np.concatenate(parts), scale)
        d = b - x
        # Words that equal those a period on: two periods of them, half of what the block lacks on one of its sides.
        lacks = np.maximum(0, np.maximum(2 * d, LEAST - d) - scale)
        more = (lacks + 1) // 2
        after, before = x + scale, np.maximum(x - more, 0)
        right = b + scale + more <= n
        end = np.minimum(after + more, n - d)
        right &= (prefix[end] - prefix[after]) * power[d] == prefix[end + d] - prefix[after + d]
        left = x >= more
        left &= (prefix[x] - prefix[before]) * power[d] == prefix[b] - prefix[before + d]
        good = np.flatnonzero(left | right)
        order = good[np.lexsort((x[good], d[good]))]
        now, done = 0, 0
        for at, dist in zip(x[order].tolist(), d[order].tolist()):
            if dist == now and at < done:
                continue
            start = at - agreeing_back(ids, at, at + dist)
            done = at + agreeing(ids, at, at + dist)
            now, whole = dist, (start, done + dist)
            if done + dist - start >= max(LEAST, TIMES * dist) and whole not in found:
                found[whole] = dist
        scale *= 2
    return sorted((start, end - start, period) for (start, end), period in found.items())


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for the same bytes."""
    number = defaultdict(count().__next__)
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those after the first period of a run."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int32)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
        words = [words[k] for k in keep.tolist()]
    return b" ".join(words)


def _judged(batches):
    names = ["id", "n_words", "runs", "collapsed"]

    def packed(rows):
        ids, sizes, runs, texts = zip(*rows)
        flat = [r for part in runs for r in part]
        fields = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
        offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, fields=list(_RUN)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())], names=names)

    for batch in batches:
        rows, held = [], 0
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            # Python's bytes.split() parts at the same six bytes: space, and 9 to 13.
            words = (text.as_py() or b"").split()
            runs = find_runs(numbered(words)) if len(words) >= LEAST else []
            rows.append((ident, len(words), runs, collapsed(words, runs)))
            held += len(rows[-1][3])
            if held > PIECE:
                yield packed(rows)
                rows, held = [], 0
        if rows:
            yield packed(rows)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: id, n_words, its runs by start, then period, and collapsed, its text with one period of each run."""
    own = columns(docs, id=id_col, text=text_col).select(F.col("id").cast("bigint"), "text")
    return own.mapInArrow(_judged, SCHEMA)
