"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of one to three characters of the lower-cased text are hashed to DIM features; ASCII characters that are not
letters count as blanks. Document frequencies are counted over all training documents. Weights are fitted by
follow-the-regularised-leader with an elastic net, on a sample of about SAMPLE documents, as many for each language as
there are, up to its share; it is drawn by hash over all training documents. One part of the sample is kept back to
choose the temperature by which scores are divided, so that they are probabilities.

Null texts and texts without a letter are `und` with score 0; so is every text if no training document has a language.
Rows that repeat an identifier are judged each. Further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns

DIM, ORDERS = 1 << 16, 3
SAMPLE, KEPT_BACK, EPOCHS = 3000, 5, 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-4, 1e-5
FOLDS, HELD_OUT = 5, 0
_MUL = np.random.default_rng(9).integers(1 << 20, 1 << 31, 8, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_CHAR = np.arange(128, dtype=np.uint32)
_CHAR[[c for c in range(128) if not chr(c).isalpha()]] = 32


def held_out(ident: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % folds == fold, F.lit(False))


def counts(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The features of a text and how often it has them; None without a letter."""
    if not any(map(str.isalpha, text)):
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(c < 128, _CHAR[np.minimum(c, 127)], c)
    grams, h = [], c * _MUL[0]
    grams.append((h ^ h >> np.uint32(15)) * _MUL[1] >> np.uint32(16))
    for n in range(2, ORDERS + 1):
        h = (h[:-1] ^ h[:-1] >> np.uint32(13)) * _MUL[2] + c[n - 1 :] * _MUL[n + 1]
        grams.append((h ^ h >> np.uint32(15)) * _MUL[1] >> np.uint32(16))
    n = np.bincount(np.concatenate(grams), minlength=DIM)
    at = np.flatnonzero(n)
    return at, n[at]


def weigh(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[at]
    return x / max(1e-12, np.sqrt(x @ x))


def frequencies(train: DataFrame) -> np.ndarray:
    """train(text) -> each feature's document frequency and, last, the number of documents with a letter."""
    size = 1 << 12

    def run(batches):
        df = np.zeros(DIM + size, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(i, 256).to_pylist():
                    if text and (got := counts(text)):
                        df[got[0]] += 1
                        df[DIM] += 1
        for k in range(0, len(df), size):
            if df[k : k + size].any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k // size], pa.int32()), "n": [df[k : k + size].tolist()]}, schema=pa.schema([("slice", pa.int32()), ("n", pa.list_(pa.int64()))]))

    rows = train.mapInArrow(run, "slice int, n array<bigint>").select("slice", F.posexplode("n").alias("k", "n"))
    df = np.zeros(DIM + size, np.int64)
    for r in rows.groupBy("slice", "k").agg(F.sum("n").alias("n")).where("n > 0").select((F.col("slice") * size + F.col("k")).alias("k"), "n").toPandas().itertuples():
        df[r.k] = r.n
    return df[: DIM + 1]


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for a softmax over classes."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((classes, DIM)), np.zeros((classes, DIM))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = softmax(w @ x)
        g[y] -= 1
        g = g[:, None] * x
        n = self.n[:, at]
        self.z[:, at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[:, at] = n + g * g


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=0))
    return e / e.sum(axis=0)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor, of a grid, at which the kept-back documents' languages are likeliest."""
    grid = np.geomspace(0.05, 4, 60)
    return float(min(grid, key=lambda t: -np.log(np.maximum(softmax(logits / t)[y, np.arange(len(y))], 1e-300)).sum())) if len(y) else 1.0


def fit(train: DataFrame, sample: int) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """train(id, text, lang) -> languages, idf, weights, temperature."""
    df = frequencies(train.select("text"))
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], idf, np.zeros((0, DIM)), 1.0
    share = sample / len(langs)
    part = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, share / n)))])
    place = F.pmod(F.xxhash64(F.lit(3), "id", "text"), F.lit(1 << 40)) / float(1 << 40)
    drawn = train.withColumn("p", place).where(F.col("p") < F.element_at(part, F.col("lang")))

    def run(batches):
        for batch in batches:
            for text, lang, p in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if text and (got := counts(text)):
                    yield pa.RecordBatch.from_pydict({"lang": [lang], "p": [p], "at": [got[0].astype(np.uint16).tobytes()], "n": [got[1].astype(np.uint32).tobytes()]}, schema=pa.schema([("lang", pa.string()), ("p", pa.float64()), ("at", pa.binary()), ("n", pa.binary())]))

    rows = drawn.select("text", "lang", "p").mapInArrow(run, "lang string, p double, at binary, n binary").collect()
    rows.sort(key=lambda r: (r["p"], r["lang"], r["at"]))
    seen = []
    for r in rows:
        at = np.frombuffer(r["at"], np.uint16).astype(np.int64)
        seen.append((at, weigh(at, np.frombuffer(r["n"], np.uint32), idf), langs.index(r["lang"])))
    order = np.random.default_rng(1).permutation(len(seen))
    back, rest = order[: len(order) // KEPT_BACK], order[len(order) // KEPT_BACK :]
    model = Ftrl(len(langs))
    for _ in range(EPOCHS):
        for k in rest:
            model.learn(*seen[k])
    w = model.weights()
    logits = np.array([w[:, seen[k][0]] @ seen[k][1] for k in back]).reshape(-1, len(langs)).T
    return langs, idf, w, temperature(logits, np.array([seen[k][2] for k in back], int))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """A row per row of docs: id, held_out, lang_pred, score."""
    own = columns(docs, id=id_col, text=text_col, lang=lang_col).select(F.col("id").cast("bigint"), "text", "lang")
    langs, idf, w, heat = fit(own.where(~held_out(F.col("id")) & F.col("text").isNotNull() & F.col("lang").isNotNull()), sample)
    w = np.ascontiguousarray((w * idf).T.astype(np.float32))
    squares, names = (idf**2).astype(np.float32), [*langs, "und"]

    def run(batches):
        for batch in batches:
            pred, score = [], []
            for i in range(0, batch.num_rows, 256):
                for text in batch.column(1).slice(i, 256).to_pylist():
                    got = counts(text) if text and langs else None
                    if got is None:
                        pred.append(len(langs))
                        score.append(0.0)
                        continue
                    x = (1 + np.log(got[1])).astype(np.float32)
                    s = (x @ w[got[0]]).astype(float) / np.sqrt(float((x * x) @ squares[got[0]])) / heat
                    p = softmax(s)
                    pred.append(int(p.argmax()))
                    score.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[k] for k in pred], pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    out = own.select("id", "text").mapInArrow(run, "id bigint, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
