"""Removal of repeated substrings against a dictionary of all substrings."""

import collections
import hashlib

import numpy as np
import pytest

from sourcelens.llm import queries, suffix_cover


def plain(texts, length):
    """(n_bytes, spans, kept) of each text."""
    texts = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans, i = [], 0
        while i < len(t):
            j = i
            while j < len(t) and gone[j]:
                j += 1
            if j > i:
                spans.append((i, j - i))
            i = j + 1
        out.append((len(t), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def letters(rng, n, alphabet="abcdefghij é"):
    return "".join(alphabet[k] for k in rng.integers(0, len(alphabet), n))


def corpus(rng, length, docs=60):
    """Texts that share passages of lengths about the limit, whole copies, near copies, and repeats within themselves."""
    shared = [letters(rng, int(length * f)) for f in (0.7, 0.95, 1.0, 1.02, 1.3, 2.5, 6)]
    texts = []
    for k in range(docs):
        parts = [letters(rng, int(rng.integers(0, 3 * length)))]
        for _ in range(int(rng.integers(0, 4))):
            p = shared[int(rng.integers(0, len(shared)))]
            a = int(rng.integers(0, len(p) // 3 + 1))
            parts += [p[a:] if rng.random() < 0.5 else p, letters(rng, int(rng.integers(0, length)))]
        texts.append("".join(parts))
    base = letters(rng, 8 * length)
    texts += [base] * 4 + ["x" + base, base[: 5 * length] + "!" + base[5 * length :], base[: 3 * length] + base[3 * length + 7 :]]
    texts += ["ab" * length * 2, "z" * (length + 1), "z" * length, "z" * (length - 1), "q" * (length + 1), None, "", " "]
    for k in range(25):
        cut = int(rng.integers(0, len(base)))
        texts.append(base[:cut] + letters(rng, 2) + base[cut + 2 :])
    return [texts[k] for k in rng.permutation(len(texts))]


def rows_of(spark, texts, parts=5):
    data = [(k, t, 1, "a", b"", 2, 3) for k, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, id int, texts string, kept binary, chunk int, n_bytes int").repartition(parts)


def check(spark, texts, length):
    got = {r.id: (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffix_cover.remove_repeats(rows_of(spark, texts), length=length).collect()}
    want = dict(enumerate(plain(texts, length)))
    assert got == want
    return sum(bool(spans) for _, spans, _ in want.values())


def test_covers():
    for v, cover in suffix_cover.COVERS.items():
        found = collections.Counter((a - b) % v for a in cover for b in cover if a != b)
        assert found == {d: 1 for d in range(1, v)}


@pytest.mark.parametrize("length,piece", [(40, 1 << 20), (40, 300), (400, 1 << 20), (400, 5000), (10, 64), (110, 999)])
def test_against_all_substrings(spark, monkeypatch, length, piece):
    """Small pieces stand for documents that are longer than what is hashed at a time."""
    rng = np.random.default_rng(length + piece)
    texts = corpus(rng, length)
    monkeypatch.setattr(suffix_cover, "PIECE", piece)
    own = np.array([len((t or "").encode()) for t in texts])
    offs = np.concatenate([[0], np.cumsum(own)])
    assert plain_by_chunk(texts, offs, length) == plain(texts, length)
    if piece == 1 << 20:
        assert check(spark, texts, length) > 30


def plain_by_chunk(texts, offs, length):
    """The steps of the operator on three chunks, without Spark between them."""
    import pyarrow as pa

    def table(kind, rows):
        return pa.Table.from_batches([suffix_cover.record(rows, suffix_cover._KEYS)]) if rows else suffix_cover._KEYS.empty_table()

    n, found, asked, out = len(texts), [], [], {}
    parts = [range(0, n // 3), range(n // 3, n // 2), range(n // 2, n)]
    lefts = []
    for c, part in enumerate(parts):
        blobs = pa.array([[(texts[k] or "").encode() for k in part]], pa.list_(pa.binary()))
        lefts.append(pa.table({"chunk": pa.array([c], pa.int64()), "ids": pa.array([list(part)], pa.list_(pa.int64())), "texts": blobs}))
        batch = pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), blobs], names=["chunk", "texts"])
        for b in suffix_cover.sampled(length, 2)([batch]):
            found += zip(*(x.to_pylist() for x in b.columns))

    def bucketed(rows, step):
        back = []
        for k in range(4):
            mine = [r for r in rows if r[0] == k]
            if mine:
                for b in step([suffix_cover.record(mine, suffix_cover._KEYS)]):
                    back += zip(*(x.to_pylist() for x in b.columns))
        return back

    states = bucketed(found, suffix_cover.ranked)
    for c, left in enumerate(lefts):
        t = suffix_cover.settled(length, 2, 4)(left, table(0, [r for r in states if r[1] == c]))
        asked += zip(*(x.to_pylist() for x in t.columns)) if t.num_rows else []
    states = bucketed(asked, suffix_cover.sorted_buckets)
    for c, left in enumerate(lefts):
        for r in suffix_cover.removed(length)(left, table(0, [r for r in states if r[1] == c])).to_pylist():
            out[r["id"]] = (r["n_bytes"], [(s["start"], s["length"]) for s in r["spans"]], r["kept"])
    return [out[k] for k in range(n)]


def test_many_chunks(spark, monkeypatch):
    """Chunks of a document or two each; the chunk size is fixed on the driver."""
    monkeypatch.setattr(suffix_cover, "CHUNK", 2000)
    assert check(spark, corpus(np.random.default_rng(1), 60), 60) > 30


def test_odd_tables(spark):
    df = rows_of(spark, ["a" * 500, "b" * 300])
    assert suffix_cover.remove_repeats(df.where("doc_id < 0")).count() == 0
    assert [bytes(r.kept) for r in suffix_cover.remove_repeats(df.where("doc_id = 0")).collect()] == [b""]
    twice = spark.createDataFrame([(None, letters(np.random.default_rng(2), 450))] * 2 + [(3, None)], "doc_id long, text string")
    got = sorted((str(r.id), r.n_bytes > 0, bytes(r.kept)) for r in suffix_cover.remove_repeats(twice).collect())
    assert got == [("3", False, b""), ("None", True, b""), ("None", True, b"")]
    with pytest.raises(ValueError):
        suffix_cover.remove_repeats(df, length=9)


def test_query(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: x for r, x in zip(rows, plain([r.text for r in rows], 400))}
    out = queries.op13_suffix_cover(spark, small)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert got == {k: (n, sum(s[1] for s in spans), len(spans), hashlib.sha256(kept).hexdigest()) for k, (n, spans, kept) in want.items()}
    assert sum(x[1] > 0 for x in got.values()) > 0
