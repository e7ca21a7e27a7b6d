"""N-gram Jaccard self-join by prefix filters under several global token orders.

A document's set is its distinct word shingles. Two sets with Jaccard similarity of at least t share a token among the
first n - ceil(t n) + 1 tokens of each, whatever global order the tokens are in. Three orders are used: by document
frequency, by its magnitude with another tie-break, and by hash. The inverted index of the first finds who meets; the
prefixes under the others are kept beside each set as compact arrays, and a pair of which any two do not intersect is
dropped before a set is fetched. So is one whose bitmaps, of the parity of hashed tokens, differ in more places than
the threshold lets sets differ. Frequencies come from a count sketch over all documents. A sketch may be wrong about a
token without harm: any fixed order is exact, and its errors only cost candidates.

Equal sets form classes before the join. In an index bucket of up to SMALL sets every pair that the position bound
admits is a candidate. Only components are asked for, so those of larger buckets come in rounds. In each of ROUNDS
rounds such a bucket that lies in several components offers one pivot from its largest, the member that meets
others most, and each class outside tries the best of its buckets' pivots: at most one candidate a class and round.
A noisy copy has a prefix of tokens that nobody shares, so the pivot of a group of copies is its cleanest member, to
which most link at once. At last, or as soon as they are few, every pair of a bucket's members across components is
compared by position bound and bitmap inside the bucket, in chunks dealt to several tasks; only pairs that pass leave
it. No link between different components is lost, and no pair inside one is needed.

The rows of a bucket that the sketch knows to be hot are dealt to several tasks.

Null and empty texts have an empty set and link with nothing. Fewer words than a shingle make one shingle. Rows that
repeat an identifier, whatever their texts, are documents of their own that share its component. Further columns are
not read, and an empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, columns, components, mix, release, shingle_sets, written

WIDTH, PERCENT = 5, 80
#: The sketch's counters are 16 for each document, within these bounds (as powers of two); slices of it are summed apart.
LEAST_BITS, MOST_BITS, SLICE = 14, 24, 1 << 16
#: Rows of an index bucket that one task may get.
HOT = 20_000
ORDERS = 3
#: Sets of an index bucket of which all pairs are tried at once.
SMALL = 8
#: Rounds of pivots before every pair across components, and members of a bucket that one chunk may hold then.
ROUNDS, DEAL = 3, 1 << 10
#: Pairs that a task compares at a time.
SLICE_PAIRS = 1 << 19
#: Pairs across components for each member up to which they are tried at once.
FEW_PAIRS = 4
CEILING = np.uint64((1 << 28) - 1)
#: Up to so many identifiers may be broadcast to pick documents; beyond it the tables are shuffled.
FEW = 1 << 20
KINDS = {"bigint": pa.int64(), "int": pa.int32()}
_SALT = np.random.default_rng(5).integers(1, 1 << 63, 8, dtype=np.uint64)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def order_keys(tokens: np.ndarray, sketch: np.ndarray, order: int) -> np.ndarray:
    """Keys that put tokens in one of the global orders; equal keys are settled by the token itself."""
    if order == ORDERS - 1:
        return mix(tokens ^ _SALT[order])
    count = sketch[tokens >> np.uint64(64 - (len(sketch).bit_length() - 1))].astype(np.uint64)
    if order:
        count = np.frexp(count.astype(float))[1].astype(np.uint64)
    return np.minimum(count, CEILING) << np.uint64(36) | mix(tokens ^ _SALT[order]) >> np.uint64(28)


def prefix(tokens: np.ndarray, sketch: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first tokens of a sorted set in an order."""
    return tokens[np.argsort(order_keys(tokens, sketch, order), kind="stable")[: prefix_size(len(tokens), percent)]]


def signature(tokens: np.ndarray) -> tuple[int, int]:
    return tuple(np.array([mix(tokens ^ _SALT[k]).sum(dtype=np.uint64) for k in (4, 5)], np.uint64).view(np.int64).tolist())


def profile(docs: DataFrame, bits: int, width: int) -> DataFrame:
    """docs(id, text) -> a row per document (id, n, sig, sig2), and per task the sketch's slices (slice, salt, counts)."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("sig2", pa.int64()), ("slice", pa.int32()), ("salt", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        counts = np.zeros(1 << bits, np.uint32)
        shift = np.uint64(64 - bits)
        for batch in batches:
            n, sigs = [], []
            for _, _, data, offs in blocks(batch.column(1)):
                sets = list(shingle_sets(data, offs, width))
                for s in sets:
                    n.append(len(s))
                    sigs.append(signature(s))
                every = np.concatenate(sets) >> shift
                counts += np.bincount(every.astype(np.int64), minlength=1 << bits).astype(np.uint32)
            a, b = zip(*sigs) if sigs else ((), ())
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        salt = TaskContext.get().partitionId() % 64
        size = min(SLICE, 1 << bits)
        for k in range(0, 1 << bits, size):
            if counts[k : k + size].any():
                yield pa.RecordBatch.from_pylist([{"slice": k // size, "salt": salt, "counts": squeezed(counts[k : k + size])}], schema=schema)

    return docs.mapInArrow(run, "id bigint, n bigint, sig bigint, sig2 bigint, slice int, salt int, counts binary")


def squeezed(counts: np.ndarray) -> bytes:
    """Counts as compressed bytes, the low bytes of all first."""
    planes = np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(counts).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def opened(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.uint64)


def summed(slices: DataFrame) -> DataFrame:
    """Adds up the counts of each (slice, salt) or slice; a task holds one sum for each of its slices."""

    def run(batches):
        total: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                key, more = (row["slice"], row["salt"]), opened(row["counts"])
                total[key] = more if key not in total else np.minimum(total[key] + more, CEILING)
        yield pa.RecordBatch.from_pylist([{"slice": s, "salt": t, "counts": squeezed(c)} for (s, t), c in total.items()], schema=pa.schema([("slice", pa.int32()), ("salt", pa.int32()), ("counts", pa.binary())]))

    return slices.mapInArrow(run, "slice int, salt int, counts binary")


def collected_sketch(slices: DataFrame, bits: int) -> np.ndarray:
    """The whole sketch, of at most 2**MOST_BITS counters, on the driver."""
    once = summed(slices.repartition("slice", "salt")).withColumn("salt", F.lit(0))
    sketch = np.zeros(1 << bits, np.uint32)
    size = min(SLICE, 1 << bits)
    for row in summed(once.repartition("slice")).collect():
        sketch[row["slice"] * size : (row["slice"] + 1) * size] = opened(row["counts"])
    return sketch


def index(docs: DataFrame, sketch, width: int, percent: int) -> DataFrame:
    """docs(id, text) -> (token, salt, sig, n, pos): the prefix tokens in the first order. Equal sets of a task give rows once."""
    names = ["token", "salt", "sig", "n", "pos"]

    def run(batches):
        counts, seen = sketch.value, set()
        shift = np.uint64(64 - (len(counts).bit_length() - 1))
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            size = 0
            for _, _, data, offs in blocks(batch.column(1)):
                for s in shingle_sets(data, offs, width):
                    if not len(s):
                        continue
                    sig = signature(s)
                    if sig in seen:
                        continue
                    if len(seen) < 1 << 18:  # meeting here is only to save work
                        seen.add(sig)
                    first = prefix(s, counts, 0, percent)
                    seen_in = counts[first >> shift]
                    pos = np.flatnonzero(seen_in > 1)  # a count of one is exact: nobody to meet
                    first, parts = first[pos], seen_in[pos].astype(np.int64) // HOT
                    salts = np.where(parts > 0, (sig[0] & (1 << 62) - 1) % (parts + 1), -1)
                    for held, x in zip(out, (first.view(np.int64), salts, np.full(len(pos), sig[0]), np.full(len(pos), len(s)), pos)):
                        held.append(x)
                    size += len(pos)
                if size > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], names=names)
                    out, size = [[] for _ in names], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], names=names)

    return docs.mapInArrow(run, ", ".join(f"{n} bigint" for n in names)).selectExpr("token", "cast(salt as int) salt", "sig", "cast(n as int) n", "cast(pos as int) pos")


def met(entries: DataFrame, percent: int) -> DataFrame:
    """(token, sig, n, pos, other): the entries of large buckets, once for each set, and of others the pairs (sig, other)."""
    fields = [("token", pa.int64()), ("sig", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("other", pa.int64())]

    def batch_of(token, sig, n, pos, other):
        cols = [pa.nulls(len(sig), t) if x is None else pa.array(x, t) for x, (_, t) in zip((token, sig, n, pos, other), fields)]
        return pa.RecordBatch.from_arrays(cols, names=[f for f, _ in fields])

    def settle(cols: list[np.ndarray], new: np.ndarray):
        token, salt, sig, n, pos = cols
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(new)))
        big = np.repeat(size > SMALL, size) | (salt >= 0)
        rest = np.where(big, 0, np.repeat(at + size, size) - np.arange(len(new)) - 1)
        for gap in range(1, SMALL):
            a = np.flatnonzero(rest >= gap)
            b = a + gap
            most = np.minimum(n[a] - pos[a], n[b] - pos[b]).astype(np.int64)
            ok = 100 * most >= percent * (n[a].astype(np.int64) + n[b] - most)
            if ok.any():
                yield batch_of(None, sig[a[ok]], None, None, sig[b[ok]])
        if big.any():
            yield batch_of(token[big], sig[big], n[big], pos[big], None)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy() for k in range(5)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            new = np.ones(len(cols[0]), bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            fresh = new.copy()  # equal sets of several tasks count once
            fresh[1:] |= cols[2][1:] != cols[2][:-1]
            cols, new = [x[fresh] for x in cols], new[fresh]
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield from settle([x[:last] for x in cols], new[:last])
            held = [x[last:] for x in cols]
            if len(held[0]) > 1 << 16:  # surely a large bucket: all but some rows, the last for its copies, can go
                token, _, sig, n, pos = (x[SMALL:-1] for x in held)
                yield batch_of(token, sig, n, pos, None)
                held = [np.concatenate([x[:SMALL], x[-1:]]) for x in held]
        if held is not None:
            yield from settle(held, np.arange(len(held[0])) == 0)

    rows = entries.repartition("token", "salt").sortWithinPartitions("token", "salt", "sig")
    return rows.mapInArrow(run, "token bigint, sig bigint, n int, pos int, other bigint")


def admitted(a_n: str, a_pos: str, b_n: str, b_pos: str, percent: int) -> str:
    """SQL: sets of these sizes that first meet at these positions can still be similar enough."""
    most = f"least({a_n} - {a_pos}, {b_n} - {b_pos})"
    return f"100 * {most} >= {percent} * ({a_n} + {b_n} - {most})"


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """The parity of the tokens that fall on each of 64 or n to 2 n bits; the lower half of a bitmap folds onto the upper."""
    bits = 1 << max(6, (len(tokens) - 1).bit_length())
    at = (mix(tokens ^ _SALT[6]) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.uint64)


def may_link(n: np.ndarray, bits: list[np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Of the pairs (a, b) of positions those whose bitmaps differ in no more places than similar sets can."""
    ok = np.zeros(len(a), bool)
    wide = np.array([len(x) for x in bits])
    a, b = np.where(wide[a] <= wide[b], a, b), np.where(wide[a] <= wide[b], b, a)
    shape = np.stack([wide[a], wide[b]])
    for s, t in np.unique(shape, axis=1).T.tolist():
        here = np.flatnonzero((shape[0] == s) & (shape[1] == t))
        x, y = (np.unique(v[here], return_inverse=True) for v in (a, b))
        left, right = np.stack([bits[k] for k in x[0]]), np.stack([bits[k] for k in y[0]])
        while right.shape[1] > s:
            right = right[:, : right.shape[1] // 2] ^ right[:, right.shape[1] // 2 :]
        for lo in range(0, len(here), step := max(1, (1 << 22) // s)):
            part = slice(lo, lo + step)
            differ = np.bitwise_count(left[x[1][part]] ^ right[y[1][part]]).sum(axis=1, dtype=np.int64)
            total = n[a[here[part]]] + n[b[here[part]]]
            ok[here[part]] = (200 + 2 * percent) * ((total - differ) // 2) >= 2 * percent * total
    return ok


def compared(pairs: DataFrame, sets: DataFrame, payload: list[str], test) -> DataFrame:
    """The pairs(p, q) that pass test(what sets hold of p, and of q).

    What is held of each q goes to its p, whose own goes there once; the pairs of a p with many go to several tasks.
    """
    many = pairs.groupBy("p").agg(F.ceil(F.count("*") / DEAL).alias("parts"))
    dealt = written(pairs.join(many, "p").select("p", "q", F.pmod(F.xxhash64("q"), "parts").alias("part")))
    few = dealt.count() <= FEW
    leads = dealt.select("p", "part").distinct().select("p", F.lit(None).cast("bigint").alias("q"), "part", F.col("p").alias("id"))
    both = [F.broadcast(x) if few else x for x in (leads, dealt.withColumn("id", F.col("q")))]
    held = [sets.select("id", *payload).join(x, "id").select("p", "part", "q", *payload) for x in both]

    def run(batches):
        lead, of = None, None
        for batch in batches:
            ps, parts, qs, *cols = (batch.column(k) for k in range(batch.num_columns))
            keep = []
            for k, (p, q) in enumerate(zip(ps.to_pylist(), qs.to_pylist())):
                own = [c[k].as_buffer() for c in cols]
                if q is None:
                    lead, of = own, p
                elif p == of and test(lead, own):
                    keep.append((p, q))
            if keep:
                p, q = zip(*keep)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(q, pa.int64())], names=["p", "q"])

    ordered = held[0].union(held[1]).repartition("p", "part").sortWithinPartitions("p", "part", F.col("q").asc_nulls_first())
    return ordered.mapInArrow(run, "p bigint, q bigint")


def intersected(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs(p, q) whose prefixes intersect under all further orders and whose bitmaps allow a link."""

    def test(x, y):
        n = [np.frombuffer(v[0], np.int64)[0] for v in (x, y)]
        bits = [np.frombuffer(v[1], np.uint64) for v in (x, y)]
        if not may_link(np.array(n), bits, np.array([0]), np.array([1]), percent)[0]:
            return False
        firsts = zip(*(np.split(np.frombuffer(v[2], np.uint16), ORDERS - 1) for v in (x, y)))
        return all(np.isin(p, q, kind="sort").any() for p, q in firsts)

    return compared(pairs, sets, ["size", "bits", "prefixes"], test)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs(p, q) of ids in sets(id, tokens) that are similar."""
    return compared(pairs, sets, ["tokens"], lambda x, y: similar(np.frombuffer(x[0], np.uint64), np.frombuffer(y[0], np.uint64), percent))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    same = int((y[at] == x).sum())
    return 100 * same >= percent * (len(x) + len(y) - same)


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """A row per row of docs: id, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    spark: SparkSession = docs.sparkSession
    own = columns(docs, id=id_col, text=text_col).select(F.col("id").cast("bigint"), "text")
    bits = min(MOST_BITS, max(LEAST_BITS, ceil(np.log2(16 * own.count() + 1))))
    seen = written(profile(own, bits, width))
    docs_of = seen.where("slice is null").select("id", "n", "sig", "sig2")
    sketch = spark.sparkContext.broadcast(collected_sketch(seen.where("slice is not null").select("slice", "salt", "counts"), bits))
    classes = written(docs_of.where("n > 0 and id is not null").groupBy("sig", "sig2", "n").agg(F.min("id").alias("rep")))

    seen_in = written(met(index(own.where("id is not null"), sketch, width, percent), percent))
    of_sig = classes.select("sig", "rep")
    of_sig = F.broadcast(of_sig) if of_sig.count() <= FEW else of_sig
    clash = classes.groupBy("sig").agg(F.min("rep").alias("p"), F.collect_set("rep").alias("all")).where(F.size("all") > 1)
    clash = clash.select("p", F.explode("all").alias("q")).where("p <> q")
    first = seen_in.where("other is not null").select("sig", "other").distinct()
    first = first.join(of_sig.withColumnRenamed("rep", "p"), "sig").join(of_sig.select(F.col("sig").alias("other"), F.col("rep").alias("q")), "other")
    first = written(first.select("p", "q").union(clash))
    members = seen_in.where("other is null").select("token", "sig", "n", "pos")
    share = members.groupBy("sig").agg((F.count("*") / F.max("n")).alias("w")).join(of_sig, "sig")
    share = written(share)
    few = F.broadcast(share) if share.count() <= FEW else share
    named = written(members.join(few, "sig").select("token", "rep", "n", "pos", "w", F.col("rep").alias("c")))
    wanted = share.select("rep").union(first.select("p")).union(first.select("q")).distinct()
    sets = written(sets_of(own, classes, wanted, sketch, width, percent))

    tried, label = None, None
    for step in range(ROUNDS + 1):
        release(spark)
        named = apart(named) if step else named
        count, most = named.count(), cross_pairs(named)
        last = step == ROUNDS or most <= FEW_PAIRS * count
        pairs = across(named, sets, percent) if last else pivoted(named, step, percent)
        pairs = pairs.union(first) if label is None else pairs
        pairs = pairs.withColumns({"a": F.least("p", "q"), "b": F.greatest("p", "q")})
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b"))
        links = verified(intersected(pairs.select("p", "q"), sets, percent), sets, percent).select(F.col("p").alias("a"), F.col("q").alias("b"))
        if label is not None:
            links = relabelled(relabelled(links, label, "a"), label, "b")
        merged = components(links)
        label = merged if label is None else written(relabelled(label, merged, "component").union(merged.join(label.select("node"), "node", "left_anti")))
        if last:
            break
        named = written(relabelled(named, merged, "c"))

    named = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("sig", "sig2", "n", F.coalesce("component", "rep").alias("component"))
    same = docs_of.join(named, ["sig", "sig2", "n"], "left")
    return same.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"))


def relabelled(rows: DataFrame, label: DataFrame, column: str) -> DataFrame:
    """rows with the column's nodes replaced by their components."""
    names = rows.columns
    found = rows.join(label.select(F.col("node").alias(column), F.col("component").alias("_to")), column, "left")
    return found.withColumn(column, F.coalesce("_to", column)).select(*names)


def apart(named: DataFrame) -> DataFrame:
    """The members of buckets that lie in several components."""
    several = named.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token")
    return written(named.join(several, "token", "left_semi"))


def cross_pairs(named: DataFrame) -> int:
    """How many pairs of a bucket's members lie in different components, over all buckets."""
    each = named.groupBy("token", "c").agg(F.count("*").alias("n"))
    total = each.groupBy("token").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    return total.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()[0] or 0


def pivoted(named: DataFrame, step: int, percent: int) -> DataFrame:
    """For each member outside its buckets' largest components the best of the pivots inside; later steps draw others."""
    drawn = F.lit(True) if not step else F.pmod(F.xxhash64(F.lit(step), "rep"), F.lit(4)) == 0
    inside = F.struct(drawn.alias("drawn"), F.col("w").alias("pw"), F.col("rep").alias("p"), F.col("n").alias("pn"), F.col("pos").alias("pp"))
    each = named.groupBy("token", "c").agg(F.count("*").alias("size"), F.max(inside).alias("s"))
    chosen = each.groupBy("token").agg(F.max_by(F.struct(F.col("c").alias("pc"), "s"), F.struct("size", "s")).alias("b")).select("token", "b.pc", "b.s.*")
    rows = named.join(chosen, "token").where("c <> pc").where(admitted("n", "pos", "pn", "pp", percent))
    return rows.groupBy("rep").agg(F.max(F.struct("drawn", "pw", "p")).alias("s")).select("s.p", F.col("rep").alias("q"))


def across(named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of a bucket's members in different components that position bound and bitmaps admit.

    Large buckets are dealt as pairs of chunks, so that a task holds two chunks at most.
    """
    size = named.groupBy("token").agg(F.ceil(F.count("*") / DEAL).alias("chunks"))
    dealt = named.join(size, "token").withColumn("own", F.pmod(F.xxhash64("rep"), "chunks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    dealt = dealt.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("rep").alias("id"), F.col("n").cast("bigint"), F.col("pos").cast("bigint"), "c", "own")
    rows = dealt.join(sets.select("id", "bits"), "id").select("token", "i", "j", "id", "n", "pos", "c", "own", "bits")

    def settle(cols: list[np.ndarray], bits: list[np.ndarray]):
        token, i, j, ident, n, pos, c, own = cols
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        ends = np.append(np.flatnonzero(new), len(new))[1:]
        rest = np.repeat(ends, np.diff(np.append(np.flatnonzero(new), len(new)))) - np.arange(len(new)) - 1
        total = np.concatenate([[0], np.cumsum(rest)])
        lo = 0
        while lo < len(new):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + SLICE_PAIRS, "right")) - 1)
            a = np.repeat(np.arange(lo, hi), rest[lo:hi])
            b = a + 1 + np.arange(len(a)) - np.repeat(total[lo:hi] - total[lo], rest[lo:hi])
            most = np.minimum(n[a] - pos[a], n[b] - pos[b])
            keep = (c[a] != c[b]) & ((i[a] == j[a]) | (own[a] != own[b])) & (100 * most >= percent * (n[a] + n[b] - most))
            a, b = a[keep], b[keep]
            if len(a):
                keep = may_link(n, bits, a, b, percent)
                x, y = ident[a[keep]], ident[b[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["p", "q"])
            lo = hi

    def run(batches):
        held: list[np.ndarray] = []
        bits: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy() for k in range(8)]
            held = [np.concatenate(x) for x in zip(held, cols)] if held else cols
            bits += [np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(8)]
            same = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[2] == held[2][-1])
            at = len(same) - int(same[::-1].argmin()) if not same.all() else 0
            if at:
                yield from settle([x[:at] for x in held], bits[:at])
                held, bits = [x[at:] for x in held], bits[at:]
        if held:
            yield from settle(held, bits)

    ordered = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return ordered.mapInArrow(run, "p bigint, q bigint").distinct()


def sets_of(own: DataFrame, classes: DataFrame, reps: DataFrame, sketch, width: int, percent: int) -> DataFrame:
    """(id, size, bits, prefixes, tokens) of the representatives in reps(rep), all but id as bytes.

    size: the number of tokens; tokens: the sorted hashes; bits: their bitmap; prefixes: 16 bits of the first tokens
    under each further order.
    """
    want = written(classes.join(reps, "rep").select(F.col("rep").alias("id"), "sig", "sig2"))
    want = F.broadcast(want) if want.count() <= FEW else want

    def run(batches):
        counts = sketch.value
        for batch in batches:
            idents, sigs, sigs2 = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for lo, _, data, offs in blocks(batch.column(1)):
                rows = []
                for k, s in enumerate(shingle_sets(data, offs, width)):
                    if signature(s) == (sigs[lo + k], sigs2[lo + k]):
                        first = [(prefix(s, counts, o, percent) >> np.uint64(48)).astype(np.uint16) for o in range(1, ORDERS)]
                        rows.append((idents[lo + k], len(s).to_bytes(8, "little"), bitmap(s).tobytes(), np.concatenate(first).tobytes(), s.tobytes()))
                if rows:
                    a, *rest = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), *(pa.array(c, pa.binary()) for c in rest)], names=["id", "size", "bits", "prefixes", "tokens"])

    found = own.join(want, "id").select("id", "text", "sig", "sig2").mapInArrow(run, "id bigint, size binary, bits binary, prefixes binary, tokens binary")
    repeated = not own.groupBy("id").count().where("count > 1 and id is not null").isEmpty()
    return found.dropDuplicates(["id"]) if repeated else found
