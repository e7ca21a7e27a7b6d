"""Runs against a plain search over all periods, and the query's digests against a restatement."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from sourcelens.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """Every period by itself: maximal stretches that agree a period apart and have no smaller period."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_collapsed(words, runs):
    gone = {k for start, length, q in runs for k in range(start + q, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def random_words(rng):
    kind = rng.integers(0, 5)
    n = int(rng.integers(0, 400))
    if kind == 0:
        return rng.integers(0, 2, n)
    if kind == 1:
        return rng.integers(0, 1000, n)
    out = []
    while len(out) < n:
        part = rng.integers(0, 3 if kind == 2 else 50, int(rng.integers(1, 40))).tolist()
        out += part * int(rng.integers(1, 7)) + part[: int(rng.integers(0, len(part) + 1))]
        if kind == 4 and out and rng.random() < 0.5:
            out[int(rng.integers(0, len(out)))] = -1
    return np.array(out)


def test_runs_of_random_words():
    rng, several = np.random.default_rng(5), 0
    for _ in range(1500):
        words = [b"w%d" % k for k in random_words(rng).tolist()]
        got = periodic.find_runs(periodic.numbered(words))
        assert got == plain_runs(words)
        several += len(got) > 2
    assert several > 200


@pytest.mark.parametrize("group", [8, 64])
def test_small_automata_find_the_same(monkeypatch, group):
    monkeypatch.setattr(periodic, "GROUP", group)
    rng = np.random.default_rng(6)
    for _ in range(150):
        words = random_words(rng).tolist()
        assert periodic.find_runs(np.array(words, np.int64) + 1 if words else np.zeros(0, np.int64)) == plain_runs(words)


def test_nested_and_edge_runs():
    a, b = ["a"], ["b"]
    cases = [a * 23, a * 24, a * 25, a * 5000, (a * 30 + b) * 40, (a * 30 + b) * 2 + a * 30, a * 100 + b + a * 100, [*"abcdefgh"] * 3, [*"abcdefgh"] * 2 + [*"abcdefg"],
             b + [*"abcdefghij"] * 3 + b, [f"w{k}" for k in range(400)] * 3, [f"w{k}" for k in range(400)] * 2 + [f"w{k}" for k in range(399)]]
    for words in cases:
        assert periodic.find_runs(periodic.numbered([w.encode() for w in words])) == plain_runs(words)


def test_very_long_documents_end():
    """Words that agree nearly everywhere make many seeds; two halves of one word and a repeated half of a million words."""
    n = 300_000
    ids = np.zeros(n, np.int64)
    ids[n // 2] = 1
    assert periodic.find_runs(ids) == [(0, n // 2, 1), (n // 2 + 1, n - n // 2 - 1, 1)]
    part = np.random.default_rng(1).integers(0, 10**6, 100_000)
    ids = np.concatenate([part, part, part, part[:7]])
    assert periodic.find_runs(ids) == [(0, len(ids), 100_000)]


def test_operator_on_odd_rows(spark):
    phrase = "to be or not to be that is the question"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "\x0b".join(["é"] * 30)), (5, f"so {phrase} " * 1 + f"{phrase}\n" * 4 + "end"), (5, f"so {phrase} " * 1 + f"{phrase}\n" * 4 + "end"), (None, "x " * 40), (7, "Word word " * 20), (8, "x y " * 24)]
    df = spark.createDataFrame([(i, t, 1, "a", 2) for i, t in rows], "doc_id long, text string, id int, runs string, n_words int").repartition(2)
    got = sorted(((r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(df).collect()), key=str)
    want = []
    for i, t in rows:
        words = WORD.findall(t or "")
        runs = plain_runs(words)
        want.append((i, len(words), runs, plain_collapsed(words, runs)))
    assert got == sorted(want, key=str)
    assert periodic.periodic_runs(df.where("id = 2")).count() == 0


def plain_row(ident, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(ident).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (ident, len(runs), *figures, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(plain_collapsed(words, runs)))


def test_query_against_restatement(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(k, None if k % 97 == 5 else " \n".join(f"w{x}" for x in random_words(rng).tolist())) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op11_periodic_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(r) for r in out.collect()) == sorted(plain_row(*r) for r in rows)
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows) > 20
