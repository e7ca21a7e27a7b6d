"""Each operator against a plain restatement, and on nulls, empty and long texts, ties, repeated rows, extra columns and empty tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sourcelens.llm import cap_filters, common, exact_dedup, katz, langid, mixing, ngram_join, packing, quality, substring_dedup, token_count

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans(common.UPPER, common.LOWER)
#: Columns beyond the ones that count, some with the names that operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, size int, sig int, w int, n int, h int, tokens int, part int"


def words(text):
    return WORD.findall((text or "").translate(LOW))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", 1, 1, 1, 1, 1, 1, 1) for i, t, lang, s in rows], DOCS)


def text(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def odd(spark):
    a, b = text(1, 120, 10**6), text(2, 90, 10**6)
    rows = [(1, a, "en", "s1"), (2, a.upper(), "en", "s1"), (3, a.replace(" w", "  w", 3), "en", "s1"), (4, a + " extra", "fr", "s2"), (5, None, None, None), (6, "", "en", None), (7, "", "fr", "s2"), (8, " \t\n", "en", "s3"), (9, "Two words", "en", "s1"),
            (10, "two  WORDS", "en", "s1"), (11, text(3, 3000), "fr", "s1"), (12, b + " " + text(4, 60, 10**6), "en", "s1"), (13, text(5, 60, 10**6) + " " + b, "fr", "s2"), (13, text(5, 60, 10**6) + " " + b, "fr", "s2"), (14, "É \U0001f600 <|endoftext|> ▁x.", "en", "s1"), (15, "Same " * 300, "en", "s1"), (16, "same " * 300, "en", "s2")]
    return docs(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("doc_id < 0")


@pytest.mark.parametrize("run", [
    exact_dedup.exact_dedup, ngram_join.ngram_jaccard_join, katz.katz_scores, langid.language_id, mixing.mix, substring_dedup.near_passages,
    lambda d: packing.pack(d, P.path("byte_bpe_50k.json")), lambda d: token_count.token_counts(d, P.path("piece_bpe_32k.model")),
    lambda d: quality.quality_scores(d, d.selectExpr("doc_id", "cast(1 as int) quality")),
])
def test_empty_table(none, run):
    assert run(none).count() == 0


def test_exact_dedup(odd):
    rows = odd.select("doc_id", "text").collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[(r["text"] or "").translate(LOW)].append(r["doc_id"])
    got = exact_dedup.exact_dedup(odd).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for t, ids in groups.items():
        for i in ids:
            assert (by_id[i]["keep_id"], by_id[i]["group_size"], by_id[i]["kept"]) == (max(ids), len(ids), i == max(ids))
            assert by_id[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("limit", [1 << 40, 3000, 900])
def test_trie_spills_and_finds_owners(limit):
    rng = np.random.default_rng(3)
    keys = [bytes(rng.integers(97, 100, int(n)).astype(np.uint8)) for n in rng.integers(0, 12, 600)]
    trie, want = exact_dedup.PatriciaTrie(max, limit), {}
    for k, key in enumerate(keys):
        trie.insert(key, k)
        want[key] = (k, want.get(key, (0, 0))[1] + 1)
    got = list(trie.items())
    assert len(got) == len(want) and {key: (i, n) for key, i, n in got} == want
    assert limit > 1 << 30 or trie.spilled


def test_trie_holds_no_more_than_its_limit():
    """8 MB of strings with a long common prefix, of which a subtree is larger than the limit too."""
    most = []

    class Watched(exact_dedup.PatriciaTrie):
        def insert(self, key, ident, rows=1):
            super().insert(key, ident, rows)
            most.append(self.held)

    rng = np.random.default_rng(8)
    prefix = bytes(rng.integers(97, 123, 2000).astype(np.uint8))
    keys = [prefix + b"%d" % (k % 3) + bytes(rng.integers(97, 123, 2000).astype(np.uint8)) for k in range(2000)]
    trie = Watched(max, 1 << 19)
    for k, key in enumerate(keys * 2):
        trie.insert(key, k)
    got = {key: (i, n) for key, i, n in trie.items()}
    assert got == {key: (k + len(keys), 2) for k, key in enumerate(keys)}
    assert max(most) < (1 << 19) + 10_000


def sets_of(rows):
    out = {}
    for r in rows:
        w = words(r["text"])
        out[r["doc_id"]] = set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def groups_of(sets):
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: top(i) for i in sets}


def test_ngram_join(odd):
    sets = sets_of(odd.select("doc_id", "text").collect())
    group = groups_of(sets)
    got = ngram_join.ngram_jaccard_join(odd).collect()
    assert len(got) == 17
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, len(s), group[i]) for i, s in sets.items()}


def test_ngram_join_of_a_loose_group_with_hot_tokens(spark, monkeypatch):
    """A chain of copies that drift apart, whose buckets hold all of them; hot buckets are dealt to several tasks."""
    monkeypatch.setattr(ngram_join, "HOT", 6)
    base, rows = text(9, 150, 10**6).split(), []
    for k in range(24):
        rows.append((100 + k, " ".join(base), "en", "s"))
        base[5 + k * 6 % 140] = f"new{k}"
    d = docs(spark, rows)
    group = groups_of(sets_of(d.collect()))
    assert {(r["doc_id"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(d).collect()} == set(group.items())


def test_ngram_join_of_noisy_copies(spark, monkeypatch):
    """Copies with edits of their own, most similar to few others, in buckets that are dealt in chunks."""
    monkeypatch.setattr(ngram_join, "DEAL", 16)
    rng, base, rows = np.random.default_rng(4), text(19, 150, 10**6).split(), []
    for k in range(90):
        own = list(base)
        for at in rng.choice(150, int(rng.integers(0, 9)), replace=False):
            own[at] = f"x{k}_{at}"
        rows.append((k, " ".join(own), "en", "s"))
    d = docs(spark, rows)
    group = groups_of(sets_of(d.collect()))
    assert len(set(group.values())) > 3
    for rounds in (0, 3):
        monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
        assert {(r["doc_id"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(d).collect()} == set(group.items())


def test_signature_and_prefix_filters():
    rng = np.random.default_rng(1)
    sketch = rng.integers(1, 50, 1 << 14).astype(np.uint64)
    for _ in range(60):
        n = int(rng.integers(5, 60))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: int(len(x) * rng.uniform(0.7, 1))], rng.integers(0, 1 << 63, int(rng.integers(0, 8)), dtype=np.uint64)]))
        same = len(np.intersect1d(x, y))
        want = 100 * same >= 80 * (len(x) + len(y) - same)
        assert ngram_join.similar(x, y, 80) == want
        if want:  # no order's filter loses a similar pair, nor do bitmaps
            assert ngram_join.may_link(np.array([len(x), len(y)]), [ngram_join.bitmap(x), ngram_join.bitmap(y)], np.array([0]), np.array([1]), 80).all()
            for order in range(ngram_join.ORDERS):
                assert np.intersect1d(ngram_join.prefix(x, sketch, order, 80), ngram_join.prefix(y, sketch, order, 80)).size


@pytest.mark.parametrize("local", [0, 1 << 18])
def test_components(spark, local):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(200 + k, 201 + k) for k in range(12)] + [(5, 5)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = common.components(spark.createDataFrame(edges, "a long, b long"), local).collect()
    assert {(r["node"], r["component"]) for r in got} == {(x, top(x)) for e in edges if e[0] != e[1] for x in e}


def good_turing(n):
    """Katz's discounts of counts 1 to 5 from counts of counts, or absolute ones, restated; nothing off larger counts."""
    d = {}
    if all(n.get(r) for r in range(1, 7)) and 6 * n[6] < n[1]:
        common = 6 * n[6] / n[1]
        d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, 6)}
    if not d or not all(0 < x < 1 for x in d.values()):
        less = n[1] / (n[1] + 2 * n[2]) if n.get(1) and n.get(2) else 0.5
        d = {r: 1 - less / r for r in range(1, 6)}
    return lambda r: d.get(r, 1.0)


@pytest.mark.parametrize("head", [katz.HEAD, 40, 12])
def test_katz(spark, odd, head):
    """Against a restatement, whatever the number of words that are broadcast."""
    rows = [(1000 + i, text(i, 40, 60), "en", "s") for i in range(40)]
    d = docs(spark, rows).unionByName(odd)
    got = {}
    for r in katz.katz_scores(d, part_tokens=500, head=head).collect():
        got[r["doc_id"]] = r
    texts = collections.defaultdict(list)
    for r in d.select("doc_id", "text").collect():
        texts[r["doc_id"]].append([*words(r["text"]), "\n"])
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    one, two, before = collections.Counter(), collections.Counter(), collections.Counter()
    for i, each in texts.items():
        for w in each if not out(i) else []:
            one.update(w)
            two.update(zip([None, *w], w))
            before.update([None, *w[:-1]])
    total, types = sum(one.values()), len(one)
    model = katz.Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), dict(collections.Counter(one.values())))
    p1 = lambda w: float(model.prob(np.array([one[w]]))[0])
    disc = good_turing(collections.Counter(two.values()))
    p2 = {k: disc(n) * n / before[k[0]] for k, n in two.items() if n >= 2}
    left = collections.defaultdict(lambda: [0.0, 0.0])
    for (v, w), p in p2.items():
        left[v][0] += p
        left[v][1] += p1(w)
    for k in p2:
        most = before[k[0]] / (before[k[0]] + 1)
        if left[k[0]][0] > most:
            p2[k] *= most / left[k[0]][0]
    for v in left:
        left[v][0] = sum(p for (a, _), p in p2.items() if a == v)
        seen = sum(p2.get((v, w), (1 - left[v][0]) / (1 - left[v][1]) * p1(w)) for w in one)
        unseen = (1 - left[v][0]) / (1 - left[v][1]) * (1 - sum(map(p1, one)))
        assert seen + unseen == pytest.approx(1)  # every context's probabilities add up
    for i, each in texts.items():
        w = each[0]
        base = sum(math.log10((one[x] + 1) / (total + types + 1)) for x in w)
        score = sum(math.log10(p2[v, x]) if (v, x) in p2 else math.log10((1 - left[v][0]) / (1 - left[v][1]) * p1(x)) for v, x in zip([None, *w], w))
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(i), len(w), sum(one[x] > 0 for x in w), total)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)


def test_language_id(spark, small, odd):
    d = spark.read.parquet(f"{small}/documents.parquet")
    got = langid.language_id(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    got = langid.language_id(odd)
    assert {r["lang_pred"] for r in got.where("doc_id in (5, 6, 8)").collect()} == {"und"} and got.count() == 17
    assert {r["lang_pred"] for r in langid.language_id(odd.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_quality(spark, small, odd):
    d, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    got = quality.quality_scores(d, labels).join(labels, "doc_id").toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.3).astype(int) == got.predicted).all()
    assert got[got.quality == 1].score.mean() > got[got.quality == 0].score.mean() + 0.3
    assert quality.quality_scores(odd, labels.where("false")).select("score").distinct().count() == 1


def test_cap_filters(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 32))
    x[200:260] = x[0] + 0.2 * rng.standard_normal((60, 32))
    x[260:300] = x[1]
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)] + [(900, None, 1), (901, [], 1), (902, [0.0] * 32, 1), (903, [1.0, None], 1), (904, [float("nan")] * 32, 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    schema = "vec_id long, embedding array<double>, label int"
    got = cap_filters.near_vectors(spark.createDataFrame(rows, schema), split=40).toPandas().set_index("vec_id")
    links = got.n_links.loc[range(400)].to_numpy()
    assert (links <= near.sum(1)).all() and links.sum() >= 0.9 * near.sum() and (links[[1, *range(260, 300)]] == 40).all()
    assert (got.loc[[900, 901, 902, 903, 904]].n_links == 0).all() and (got.loc[[905, 906]].component_id == 905).all()
    assert (got.kept == (got.index == got.component_id)).all() and cap_filters.near_vectors(spark.createDataFrame([], schema)).count() == 0


def test_mixing(odd):
    rows = odd.select("doc_id", "text", "source").collect()
    size = collections.Counter()
    for r in rows:
        size[r["source"]] += len(words(r["text"]))
    names = sorted([s for s in size if s is not None]) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, target, free = 1.5 * sum(size.values()), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * size[s]}
        for s in full or free:
            target[s] = float(2 * size[s]) if full else level * weight[s]
        left -= sum(target[s] for s in full)
        free = free - full if full else set()
    got = mixing.mix(odd).join(odd.select("doc_id", "source").distinct(), "doc_id").collect()
    taken = collections.Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]] and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= 3 * mixing.LEAST
    assert sorted((r["doc_id"], r["taken"]) for r in mixing.mix(odd).collect()) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_mixing_of_small_sources_beside_a_large_one(spark):
    rows = [(k, "w " * 10000, "en", "large") for k in range(300)] + [(1000 + k, "w " * 70, "en", "small") for k in range(10)] + [(2000, "w " * 9, "en", "tiny")]
    got = mixing.mix(docs(spark, rows), blocks=512).join(docs(spark, rows).select("doc_id", "source"), "doc_id").collect()
    for s in ("large", "small", "tiny"):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(4, 0.03 * own[0]["target"])


def test_token_counts(odd):
    pieces = {"▁": -9.0, "▁the": -3.0, "the": -4.0, "t": -6.0, "h": -6.0, "e": -5.0, "he": -5.5, "▁t": -4.0, "▁▁": -7.0, "a": -2.0, "aa": -4.0, "aaa": -6.0}
    c = token_count.Counter(pieces, True)

    def plain(s):
        best = [(0.0, 0)] + [None] * len(s)
        for j in range(1, len(s) + 1):
            for i in range(j):
                p = s[i:j]
                v = pieces.get(p) if p in pieces else (c.unknown if j - i == 1 else None)
                if v is not None and (best[j] is None or best[i][0] + v > best[j][0]):
                    best[j] = (best[i][0] + v, best[i][1] + (1 if p in pieces else len(p.encode())))
        return best[-1][1]

    rng = np.random.default_rng(8)
    for _ in range(400):
        t = "".join(rng.choice(list("thea  é\n"), int(rng.integers(1, 12))))
        assert c.text(t)[0] == plain("▁" + t.replace(" ", "▁")), t
    got = {r["doc_id"]: r["n_tokens"] for r in token_count.token_counts(odd, P.path("piece_bpe_32k.model")).collect()}
    assert got[5] == got[6] == 0 and got[15] > 300


def test_token_counts_equal_the_library():
    import sentencepiece
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    m.ParseFromString(open(P.path("piece_bpe_32k.model"), "rb").read())
    m.trainer_spec.model_type = 1
    kept = [p for p in m.pieces if p.score > -1e8]
    del m.pieces[:]
    m.pieces.extend(kept)
    library = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    c = token_count.Counter({p.piece: p.score for p in m.pieces if p.type == 1}, True)
    for k in range(60):
        t = " ".join(f"the {w} Ünder." for w in text(k, 4).split())
        assert c.text(t)[0] == len(library.encode(t)), t


def test_packing(odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encoded = collections.defaultdict(list)
    for r in odd.select("doc_id", "text").collect():
        encoded[r["doc_id"]].append([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    for run, window in ((packing.RUN, 2048), (256, 64)):
        got = packing.pack(odd, P.path("byte_bpe_50k.json"), window=window, run=run, with_ids=True).collect()
        pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
        for r in got:
            assert r["length"] == len(r["ids"]) > 0 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            pieces[r["doc_id"]].append(r)
            sequences[r["sequence_id"]].append(r)
        for i, want in encoded.items():
            assert sum(r["length"] for r in pieces[i]) == sum(map(len, want)) and all(r["doc_tokens"] == len(want[0]) for r in pieces[i])
            for r in pieces[i]:
                assert r["ids"] == want[0][r["start"] : r["start"] + r["length"]]
        for s in sequences.values():
            at = 0
            for r in sorted(s, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= window


def test_cuts_are_best():
    """Against all ways to cut, on small runs: the windows before the tail cost what the best ones cost."""
    rng = np.random.default_rng(6)
    for _ in range(30):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 14))])
        cost = rng.integers(0, 5, len(at))
        f = [0] + [None] * (len(at) - 1)
        for j in range(1, len(at)):
            f[j] = min(f[i] + cost[j] + 16 - (at[j] - at[i]) for i in range(j) if at[j] - at[i] <= 16)
        cuts = packing.best_cuts(at, cost, 16)
        spent, i = 0, 0
        for j in cuts:
            spent += cost[j] + 16 - (at[j] - at[i])
            assert at[j] - at[i] <= 16
            i = j
        assert not cuts or spent == f[cuts[-1]]


def test_compact_windows_cover_every_stretch():
    rng = np.random.default_rng(7)
    for _ in range(40):
        sizes = rng.integers(0, 30, 3)
        x = rng.integers(0, 25, int(sizes.sum())).astype(np.uint64)
        ends, size, salt = np.cumsum(sizes), 6, np.uint64(99)
        order = common.mix(x ^ salt)
        found = set()
        for d, l, c, r in zip(*(v.tolist() for v in substring_dedup.compact_windows(x, ends, size, salt))):
            assert r - l + 1 >= size and l <= c <= r
            b = int(np.concatenate([[0], ends])[d])
            assert order[b + c] == order[b + l : b + r + 1].min()
            found.add((d, int(order[b + c])))
        for d in range(3):
            b, e = int(np.concatenate([[0], ends])[d]), int(ends[d])
            for i in range(b, e - size + 1):
                assert (d, int(order[i : i + size].min())) in found


def test_near_passages(odd, spark):
    got = substring_dedup.near_passages(odd).toPandas()
    pairs = set(zip(got.doc_id, got.other_id))
    assert {(1, 2), (1, 3), (1, 4), (12, 13), (15, 16)} <= pairs | {(b, a) for a, b in pairs}
    assert {12, 13} <= set(got.doc_id) and not {5, 6, 7, 8, 9, 10, 11, 14} & set(got.doc_id) and (got.n_words >= 50).all() and (got.similarity >= 0.8).all()
    assert got[got.doc_id == 12].component_id.tolist() == got[got.doc_id == 13].component_id.tolist()[:1] * (got.doc_id == 12).sum()
    line, passage = text(50, 12, 10**6), text(51, 70, 10**6)
    rows = [(k, f"{text(100 + k, 60, 10**6)} {line} {text(200 + k, 60, 10**6)}" + (f" {passage}" if k % 5 == 0 else ""), "en", "s") for k in range(60)]
    got = substring_dedup.near_passages(docs(spark, rows)).toPandas()
    assert set(got.doc_id) == set(range(0, 60, 5)) and set(got.component_id) == {0}


def test_near_passages_whose_first_member_shares_too_little(spark):
    passage = text(60, 60, 10**6).split()
    around = lambda k, ws: (k, f"{text(300 + k, 60, 10**6)} {' '.join(ws)} {text(600 + k, 60, 10**6)}", "en", "s")
    rows = [around(k, passage[:42] if k % 2 else passage[18:]) for k in range(40)]  # shorter runs, and the smallest identifiers
    rows += [around(100 + k, [*passage[: 30 + k // 12], *(["edited"] if k % 4 == 1 else passage[30 + k // 12 : 31 + k // 12]), *passage[31 + k // 12 :]]) for k in range(24)]
    got = substring_dedup.near_passages(docs(spark, rows)).toPandas()
    assert set(got.doc_id) == {100 + k for k in range(24)} and set(got.component_id) == {100}


def shares_passage(x, y, least=50, width=5):
    """Whether two word lists hold passages as long as each other, of `least` words or more, that begin and end with
    common shingles and are 80 % alike; a text has each of its shingles once."""
    x, y = ([tuple(t[i : i + width]) for i in range(len(t) - width + 1)] for t in (x, y))
    at = {t: j for j, t in enumerate(y)}
    same = np.zeros((len(x), len(y)), np.int64)
    for i, t in enumerate(x):
        if t in at:
            same[i, at[t]] = 1
    total = np.pad(same.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    for size in range(least - width + 1, min(len(x), len(y)) + 1):
        inside = total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]
        ends = same[: len(x) - size + 1, : len(y) - size + 1] & same[size - 1 :, size - 1 :]
        if (ends & (180 * inside >= 80 * 2 * size)).any():
            return True
    return False


@pytest.mark.parametrize("line,edit", [(45, False), (36, True)])
def test_near_passages_in_large_groups_against_brute_force(spark, monkeypatch, line, edit):
    """80 documents share a line; each two of them a passage around it, word for word or with an edit."""
    monkeypatch.setattr(substring_dedup, "DEAL", 32)
    rows, common_line = [], text(70, line, 10**6).split()
    for k in range(80):
        pair = k // 2
        around = text(1000 + pair, 56 if edit else 52 - line, 10**6).split()
        left = pair % (len(around) + 1)
        middle = [*around[:left], *common_line, *around[left:]]
        if edit and k % 2:
            middle[(7 * pair) % len(middle)] = f"edit{k}"
        rows.append((k, " ".join([*text(2000 + k, 40, 10**6).split(), *middle, *text(3000 + k, 40, 10**6).split()]), "en", "s"))
    rows += [(100 + k, text(4000 + k, 150, 10**6) + " " + " ".join(common_line), "en", "s") for k in range(20)]
    d = docs(spark, rows)
    lists = {r[0]: words(r[1]) for r in rows}
    want = {(a, b) for a in lists for b in lists if a < b and shares_passage(lists[a], lists[b])}
    got = substring_dedup.near_passages(d).toPandas()
    component = dict(zip(got.doc_id, got.component_id))
    caught = [component.get(a, -1) == component.get(b, -2) for a, b in want]
    assert len(want) >= 40 and np.mean(caught) >= 0.9
    clean = set(lists) - {x for p in want for x in p}
    assert len(clean & set(got.doc_id)) <= 0.02 * len(lists)
    found = set(zip(got.doc_id, got.other_id))
    assert np.mean([(a, b) in want or (b, a) in want for a, b in found]) >= 0.98


@pytest.mark.parametrize("line,edit", [(30, False), (36, True)])
def test_near_passages_of_documents_that_one_component_has_already(spark, line, edit):
    """80 documents begin alike, so all are one component; each two share besides 30 words of their own before a line that
    all have, word for word or with an edit. The line is too short for other two to share a passage there."""
    head, common_line, rows = text(90, 60, 10**6), text(91, line, 10**6).split(), []
    for k in range(80):
        middle = [*text(5000 + k // 2, 30, 10**6).split(), *common_line]
        if edit and k % 2:
            middle[(7 * (k // 2)) % len(middle)] = f"edit{k}"
        rows.append((k, " ".join([head, text(6000 + k, 40, 10**6), *middle, text(7000 + k, 40, 10**6)]), "en", "s"))
    got = substring_dedup.near_passages(docs(spark, rows)).toPandas()
    far = got[got.start_word >= 95]
    lists = {r[0]: words(r[1])[100:] for r in rows}
    want = {k for k in range(0, 80, 2) if shares_passage(lists[k], lists[k + 1])}
    assert set(got.component_id) == {0} and (far.doc_id // 2 == far.other_id // 2).all()
    assert len(want) >= 30 and len(want & set(far.doc_id)) >= (0.95 if edit else 1) * len(want)


@pytest.mark.parametrize("deal", [16, 1024])
def test_pairs_across_components_grow_with_the_members(spark, monkeypatch, deal):
    """60 members of one key, each a component: 45 in three groups of 15, word for word but for one edit of each, and 15 unlike all others."""
    monkeypatch.setattr(substring_dedup, "DEAL", deal)
    rng, size, n = np.random.default_rng(11), 46, 60
    lists = rng.integers(1, 1 << 63, (n, 91), dtype=np.uint64)
    for d in range(45):
        lists[d] = lists[d % 3] if d >= 3 else lists[d]
        lists[d, 20:23] = rng.integers(1, 1 << 63, 3, dtype=np.uint64)
    sequences = spark.createDataFrame([(d, bytearray(lists[d].tobytes())) for d in range(n)], "node long, tokens binary")
    groups = spark.createDataFrame([(7, 0, d, 0, 45, 90, d) for d in range(n)], "key long, k int, node long, l int, c int, r int, part long")
    made = substring_dedup.across(groups, sequences, size, 80).collect()
    chunks = -(-n // deal)
    assert len(made) < n * chunks and all(r.a % 3 == r.b % 3 and r.b < 45 for r in made)
    label = substring_dedup.components(spark.createDataFrame([(r.a, r.b) for r in made], "a long, b long"))
    assert {r.node: r.component for r in label.collect()} == {d: d % 3 for d in range(45)}
    every = substring_dedup.across(groups, sequences, size, 80, every=True).collect()
    assert {(r.a, r.b) for r in made} <= {(r.a, r.b) for r in every} == {(a, b) for b in range(45) for a in range(b % 3, b, 3)}


def test_sure_pairs_are_passages():
    """Of rows that are alike those are sure whose stretch has a match as long and 80 % alike, by sets of marks."""
    rng = np.random.default_rng(12)
    x = rng.integers(1, 1 << 16, (600, 91)).astype(np.uint16)
    y = x.copy()
    for k in range(len(y)):
        kind, at = k % 4, 30 + k % 31
        if kind == 0:  # places changed
            y[k, rng.choice(91, k % 30, replace=False)] = 1
        elif kind == 1:  # one left out
            y[k] = np.append(np.delete(y[k], at), 1)
        elif kind == 2:  # one more
            y[k] = np.insert(y[k], at, 1)[:91]
        else:  # a short period on both sides: sets are small
            x[k] = y[k] = np.resize(x[k, :9], 91)
            y[k, rng.choice(91, k % 13, replace=False)] = rng.integers(1, 1 << 16, k % 13)
    got = substring_dedup.sure(x, y, 46, 80)

    def holds(u, v):
        for i in range(46):
            s = u[i : i + 46]
            for p in range(max(0, i - 2), min(i + 3, 46)):
                for q in range(p + 46, min(i + 49, 92)):
                    a, b = set(s.tolist()), set(v[p:q].tolist())
                    if 100 * len(a & b) >= 80 * len(a | b):
                        return True
        return False

    want = np.array([holds(u, v) for u, v in zip(x, y)])
    assert got.sum() >= 200 and not (got & ~want).any()
    assert (got & want).sum() >= 0.9 * (want & substring_dedup.alike(x, y, 46, 80)).sum()


def test_hashes_do_not_depend_on_slices(monkeypatch):
    data = np.frombuffer(b" aB\tc  dd eee  ffff g\nhh " * 30 + b"x" * 300 + b" y ", np.uint8)
    offs = np.array([0, 0, 5, 90, 300, len(data)])
    whole = common.word_hashes(data, offs)
    monkeypatch.setattr(common, "SLICE_WORDS", 3)
    for x, y in zip(whole, common.word_hashes(data, offs)):
        assert np.array_equal(x, y)


def test_the_mix_is_cut_in_pieces():
    import corpus_pipeline

    texts = [" ".join([f"a{k}", *["word"] * 120_000, "end"]) for k in range(3)] + ["x y z", None, ""]
    n = len(texts)
    starts, sizes, whole = [0, 1, 120_000, 1, 0, 0], [120_002, 120_000, 2, 2, 0, 0], [True, False, False, False, True, True]
    kinds = [[*range(n)], texts, ["en"] * n, ["s"] * n, [7] * n, [0] * n, starts, sizes, whole]
    names = [*corpus_pipeline.COLUMNS, "slot", "start", "words", "whole"]
    got = list(corpus_pipeline._cut([pa.RecordBatch.from_arrays([pa.array(x) for x in kinds], names=names)]))
    want = [texts[0], " ".join(["word"] * 120_000) + " ", "word end", "y z", "", ""]
    assert len(got) >= 2 and [x for b in got for x in b.column(1).to_pylist()] == want
    assert [x for b in got for x in b.column(0).to_pylist()] == [*range(n)]


def test_near_passages_of_rows_that_repeat_an_identifier(spark):
    rows = []
    for k in range(20):
        passage = text(80 + k, 70, 10**6)
        rows += [(2 * k, text(500 + k, 30, 10**6) + " " + passage, "en", "s"), (2 * k + 1, passage + " " + text(600 + k, 50, 10**6), "en", "s"), (2 * k + 1, text(700 + k, 90, 10**6), "en", "s")]
    got = substring_dedup.near_passages(docs(spark, rows)).toPandas()
    assert set(zip(got.doc_id, got.other_id)) == {p for k in range(20) for p in ((2 * k, 2 * k + 1), (2 * k + 1, 2 * k))}


def test_words_and_shingles():
    t = pa.array(["a  B\tc", None, "", "\n\n", "x" * 50 + " y", "é É"])
    out = []
    for _, _, data, offs in common.blocks(t, 4):
        h, first = common.word_hashes(data, offs)
        out += [h[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert [len(x) for x in out] == [3, 0, 0, 0, 2, 2] and out[5][0] != out[5][1]


def test_pipeline(spark, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = spark.read.parquet(f"{small}/documents.parquet")
    kept = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, common.written(stage(spark, kept, small))
        assert kept.columns == corpus_pipeline.COLUMNS and 0 < kept.count(), name
        if name == "quality":
            q = spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").join(before, "doc_id")
            assert q.join(kept, "doc_id", "left_anti").count() <= 0.02 * q.count()
        if name == "exact":
            rows = [(r["text"] or "").translate(LOW) for r in kept.collect()]
            assert len(rows) == len(set(rows)) == len({(r["text"] or "").translate(LOW) for r in before.collect()})
        if name == "near":
            sets = sets_of(kept.collect())
            assert len(set(groups_of(sets).values())) == len(sets)
    assert corpus_pipeline.STAGES[-1][1](spark, kept, small).count() > 0


def test_pipeline_stages_on_odd_rows(spark, small, odd, none):
    """Null identifiers and texts, repeated identifiers and rows, columns with clashing names, and an empty table."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(corpus_pipeline.STAGES)
    c = text(90, 80, 10**6)
    more = docs(spark, [(None, c, "en", "s1"), (None, c + " end", "en", "s1"), (4, text(91, 70, 10**6), None, "s2"), (4, text(91, 70, 10**6), None, "s2"), (4, text(92, 40, 10**6), "en", None)])
    d = odd.unionByName(more)
    rows = [tuple(r) for r in d.select(*corpus_pipeline.COLUMNS).collect()]
    got = {name: [tuple(r) for r in stages[name](spark, d, small).collect()] for name in list(stages)[:-1]}
    assert set(got["quality"]) <= set(rows) and all(got["quality"].count(r) == rows.count(r) for r in got["quality"])
    kept = got["exact"]
    assert len(kept) == len({(r[1] or "").translate(LOW) for r in rows}) and set(kept) <= set(rows)
    for r in kept:
        assert r[0] == max((x[0] for x in rows if (x[1] or "").translate(LOW) == (r[1] or "").translate(LOW) and x[0] is not None), default=None)
    near = got["near"]
    assert sum(r[0] is None and r[1] is not None and r[1].startswith(c) for r in near) == 1 and {r for r in near if r[0] == 4} == {r for r in rows if r[0] == 4 and not r[1].endswith(" extra")}
    assert {r[0] for r in near} >= {5, 6, 7, 8, 9, 11, 12, 13, 14, 15} and not {2, 3, 10, 16} & {r[0] for r in near}
    whole = {r for r in got["mix"] if r in rows}
    assert whole and all(len(words(r[1])) <= max(len(words(x[1])) for x in rows if x[0] == r[0]) for r in got["mix"])
    assert stages["pack"](spark, d, small).where("doc_id is null").count() > 0
    for name in stages:
        assert stages[name](spark, none, small).count() == 0, name


def test_pipeline_tells_rows_apart_by_where_a_null_stands(spark, small):
    import corpus_pipeline as C

    t = text(71, 40)
    rows = [(1, t, "en", None, 5), (1, t, None, "en", 5), (1, t, "en", None, None), (1, t, None, "en", None), (None, t, "en", "en", 1), (1, None, t, "en", 1), (1, t, None, "en", 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert C.keyed(odd).select("row_key").distinct().count() == len(rows)
    mixed = C.mix_sources(spark, odd, small)
    taken = {(r.lang, r.source) for r in mixed.collect()}
    assert {("en", None), (None, "en")} <= taken
    assert C.once(C.keyed(odd.union(odd))).count() == len(rows)
