"""Quality scores by positive-unlabelled learning.

Trusted positives are training documents that labels mark 1; the unlabelled sample is drawn from all training documents.
With class prior p, loss l and score g, the minimised risk is the non-negative unbiased one,

    p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)]),

for a logistic model on quadratic features of shape: shares of character and word kinds, repetition of words, word
pairs and lines, and lengths. Nothing but the text enters. The prior is the smoothed share of positives among labelled
training rows; those labelled 0 serve for nothing else. Shape features are computed over every whole text, once, into a
table in the scratch folder; their means and deviations cover all documents; the fit takes at most SAMPLE rows of each
kind, those with the least hashes. Scoring is arithmetic on that table.

Null and empty texts have features of zero and get a score like any text. Without a labelled positive every score is
the prior. Rows that repeat an identifier are scored each; an identifier's labels count once for each label row.
Further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, columns, shingle_hashes, word_hashes, word_spans, written

SAMPLE = 4096
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
STEPS, RATE, RIDGE = 400, 0.05, 1e-4

_KIND = np.full(256, 7, np.uint8)  # other symbols
for _k, _s in enumerate((b" \t\v\f\r", b"\n", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".!?", b",;:'\"()-")):
    _KIND[np.frombuffer(_s, np.uint8)] = _k
_KIND[128:] = 8
KINDS = 9
NAMES = [f"kind{k}" for k in range(KINDS)] + ["mean_word", "sd_word", "caps_words", "title_words", "symbol_words", "digit_words", "stops", "distinct", "top_word", "pairs", "triples", "twice", "lines", "same_lines", "short_words", "long_words", "log_words", "words_a_stop"]


def held_out(ident: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _per(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values over each document's words (or bytes)."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def shape(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of features for each document of a block."""
    n = len(offs) - 1
    out = np.zeros((n, len(NAMES)))
    if not len(data):
        return out
    kind = _KIND[data]
    size = np.maximum(np.diff(offs), 1)
    for k in range(KINDS):
        out[:, k] = _per(offs, kind == k) / size
    hashes, first = word_hashes(data, offs)
    words = np.diff(first)
    some = np.maximum(words, 1)
    if len(hashes):
        starts, _ = word_spans(data, offs)
        blank = kind <= 1
        gaps = np.add.reduceat(blank, starts)
        length = np.diff(np.append(starts, len(data))) - gaps
        upper, lower, digit, symbol, stop = (np.add.reduceat(kind == k, starts) for k in (3, 2, 4, 7, 5))
        mean = _per(first, length) / some
        caps = (upper >= 2) & (lower == 0)
        for j, v in enumerate((None, None, caps, (upper == 1) & (lower > 0), symbol > 0, digit > 0, stop > 0)):
            if v is not None:
                out[:, KINDS + j] = _per(first, v) / some
        out[:, KINDS] = mean
        out[:, KINDS + 1] = np.sqrt(np.maximum(_per(first, length.astype(float) ** 2) / some - mean**2, 0))
        again = np.zeros(len(hashes), bool)
        again[1:] = hashes[1:] == hashes[:-1]
        again[first[:-1][first[:-1] < len(again)]] = False
        out[:, KINDS + 10] = 0
        pairs, triples = shingle_hashes(hashes, 2), shingle_hashes(hashes, 3)
        lines_at = np.flatnonzero(data == 10)
        for d in range(n):
            a, b = first[d], first[d + 1]
            if b == a:
                continue
            _, counts = np.unique(hashes[a:b], return_counts=True)
            out[d, KINDS + 7 : KINDS + 11] = (
                len(counts) / (b - a), counts.max() / (b - a),
                1 if b - a < 3 else len(np.unique(pairs[a : b - 1])) / (b - a - 1), 1 if b - a < 4 else len(np.unique(triples[a : b - 2])) / (b - a - 2),
            )
            marks = lines_at[np.searchsorted(lines_at, offs[d]) : np.searchsorted(lines_at, offs[d + 1])]
            if len(marks):
                edges = np.concatenate([[offs[d]], marks + 1, [offs[d + 1]]])
                edges = np.searchsorted(starts, edges)
                sums = np.concatenate([[0], np.cumsum(hashes[a:b], dtype=np.uint64)])[np.clip(edges - a, 0, b - a)]
                each = (sums[1:] - sums[:-1])[np.diff(edges) > 0]
                out[d, KINDS + 13] = 1 - len(np.unique(each)) / max(1, len(each))
        out[:, KINDS + 11] = _per(first, again) / some
        out[:, KINDS + 12] = np.log1p(_per(offs, data == 10)) / 8
        out[:, KINDS + 14] = _per(first, length <= 2) / some
        out[:, KINDS + 15] = _per(first, length >= 20) / some
        out[:, KINDS + 16] = np.log1p(words) / 8
        out[:, KINDS + 17] = np.log1p(words / (1 + _per(first, stop > 0))) / 4
    return out


def features(docs: DataFrame) -> DataFrame:
    """docs(id, text, row) -> (id, row, f)."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in blocks(batch.column(1)):
                f = shape(data, offs)
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, f.shape[1]), pa.int32()), pa.array(f.ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in (0, 2)), values], names=["id", "row", "f"])

    return docs.mapInArrow(run, "id bigint, row bigint, f array<float>")


def quadratic(f: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((f - mean) / scale, -4, 4)
    a, b = np.triu_indices(z.shape[1])
    return np.hstack([np.ones((len(z), 1)), z, z[:, a] * z[:, b] / 4])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Weights that minimise the non-negative risk, by Adam on the whole sample; below zero the negative part climbs back."""
    w, m, v = (np.zeros(positive.shape[1]) for _ in range(3))
    w[0] = np.log(prior / (1 - prior))
    mean = np.zeros_like(w)
    for t in range(1, STEPS + 1):
        gp, gu = positive @ w, unlabelled @ w
        as_negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        down = unlabelled.T @ su / len(su) - prior * (positive.T @ sp) / len(sp)
        grad = -down if as_negative < 0 else prior * (positive.T @ (sp - 1)) / len(sp) + down
        grad = grad + RIDGE * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - RATE * (1 - t / (STEPS + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        mean += w * (t > STEPS * 3 // 4)
    return mean / (STEPS - STEPS * 3 // 4)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD, row_col: str | None = None) -> DataFrame:
    """A row per row of docs: id, held_out, score, predicted, and the column row_col if one is named."""
    own = columns(docs, id=id_col, text=text_col, **({"row": row_col} if row_col else {}))
    own = own.select(F.col("id").cast("bigint"), "text", F.col("row") if row_col else F.lit(None).cast("bigint").alias("row"))
    seen = written(features(own))
    marks = columns(labels, id=id_col, y=label_col).select(F.col("id").cast("bigint"), F.col("y").cast("int")).where("id is not null and y is not null")
    marks = marks.where(~held_out(F.col("id")))
    known = marks.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("y") == 1).cast("int")), F.lit(0)).alias("k")).first()
    prior = min(0.99, max(0.01, (known["k"] + 1) / (known["n"] + 2)))
    place = F.xxhash64(F.lit(4), "id", F.col("f").cast("string"))
    train = seen.where(~held_out(F.col("id")))
    trusted = train.join(marks.where("y = 1"), "id", "left_semi").orderBy(place).limit(sample).select("f")
    some = train.orderBy(place).limit(sample).select("f")
    positive, unlabelled = (np.array([r["f"] for r in x.collect()], float) for x in (trusted, some))
    width = len(NAMES)
    stats = seen.select(*[F.element_at("f", k + 1).cast("double").alias(f"f{k}") for k in range(width)])
    stats = stats.agg(*[F.avg(f"f{k}").alias(f"m{k}") for k in range(width)], *[F.stddev_pop(f"f{k}").alias(f"s{k}") for k in range(width)]).first()
    mean = np.array([stats[f"m{k}"] or 0.0 for k in range(width)])
    scale = np.maximum([stats[f"s{k}"] or 0.0 for k in range(width)], 1e-3)
    if len(positive) and len(unlabelled):
        w = fit(quadratic(positive, mean, scale), quadratic(unlabelled, mean, scale), prior)
    else:
        w = np.append(np.log(prior / (1 - prior)), np.zeros(width + width * (width + 1) // 2))

    def score(batches):
        for batch in batches:
            f = batch.column(2)
            f = f.flatten().to_numpy().reshape(len(f), width).astype(float)
            s = 1 / (1 + np.exp(-np.clip(quadratic(f, mean, scale) @ w, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], names=["id", "row", "score"])

    scored = seen.mapInArrow(score, "id bigint, row bigint, score double")
    more = [F.col("row").alias(row_col)] if row_col else []
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *more)
