"""Token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton over the vocabulary enumerates the pieces that end at each character; dynamic programming
carries the best score and its number of pieces, and nothing of the path. Ties go as in the tokenizer library: of equal
scores the segmentation whose last piece starts first wins. A character that is no piece costs the least score less ten
and counts as its bytes where the vocabulary has byte pieces, else as one; neighbouring unknowns then make one.

No piece crosses the place where white space begins, nor a line end if no longer piece holds one, so a text's best
segmentation is that of its words one after the other, and words already counted by a task come from a bounded store.
Scores are summed in double precision. The library sums in single precision over a whole text, so beyond a total of
2**24 its choices drift; word by word, and in exact arithmetic over whole texts, counts are equal.

Null and empty texts have no tokens. Rows are counted each, further columns are not read, and an empty table gives an
empty result. A word of any length takes memory in proportion to its length only.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns

SPACE, UNKNOWN_PENALTY = "▁", 10.0
STORE = 1 << 19
_loaded: dict[str, "Counter"] = {}


class Counter:
    """Piece counts and best scores of words, for a sentencepiece vocabulary taken as a unigram one."""

    def __init__(self, pieces: dict[str, float], byte_fallback: bool, store: int = STORE):
        import ahocorasick

        self.match = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.match.add_word(piece, (len(piece), score))
        self.match.make_automaton()
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.bytes, self.store = byte_fallback, store
        self.single = {p for p in pieces if len(p) == 1}
        self.lines = not any("\n" in p and len(p) > 1 for p in pieces)
        self.known: dict[str, tuple[int, float]] = {}

    @classmethod
    def load(cls, path: str) -> Counter:
        if path not in _loaded:
            import sentencepiece

            m = sentencepiece.SentencePieceProcessor(model_file=path)
            ids = range(m.get_piece_size())
            pieces = {m.id_to_piece(i): m.get_score(i) for i in ids if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i))}
            _loaded[path] = cls(pieces, any(m.is_byte(i) for i in ids))
        return _loaded[path]

    def word(self, s: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation."""
        n = len(s)
        found: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, piece in self.match.iter(s):
            found[end].append(piece)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(n):
            best, start, many, odd = None, 0, 0, False
            if s[end] not in self.single:
                best, start, odd = score[end] + self.unknown, end, True
                many = len(s[end].encode("utf-8", "surrogatepass")) if self.bytes else 0 if unknown[end] else 1
                many += count[end]
            for size, value in found[end]:
                at = end + 1 - size
                value += score[at]
                if best is None or value > best or (value == best and at < start):
                    best, start, many, odd = value, at, count[at] + 1, False
            score[end + 1], count[end + 1], unknown[end + 1] = best, many, odd
        return count[n], score[n]

    def text(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a whole text, which gets a leading space as the library gives it."""
        total, best, known = 0, 0.0, self.known
        if not text:
            return 0, 0.0
        lines = text.split("\n") if self.lines else [text]
        for k, line in enumerate(lines):
            run = 1
            if k:
                n, b = self._of("\n")
                total, best, run = total + n, best + b, 0
            for w in line.split(" "):
                if not w:
                    run += 1
                    continue
                key = SPACE + w if run == 1 else SPACE * run + w
                run = 1
                got = known.get(key)
                if got is None:
                    got = self._of(key)
                total += got[0]
                best += got[1]
            if run > 1:
                n, b = self._of(SPACE * (run - 1))
                total, best = total + n, best + b
        return total, best

    def _of(self, key: str) -> tuple[int, float]:
        got = self.known.get(key)
        if got is None:
            if len(self.known) >= self.store:
                self.known.clear()
            got = self.known[key] = self.word(key)
        return got


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id, n_tokens, best_score (of the segmentation). The model file lies where tasks run."""

    def run(batches):
        counter = Counter.load(model_path)
        for batch in batches:
            n, score = [], []
            for i in range(0, batch.num_rows, 256):
                for text in batch.column(1).slice(i, 256).to_pylist():
                    got = counter.text(text or "")
                    n.append(got[0])
                    score.append(got[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(score, pa.float64())], names=["id", "n_tokens", "best_score"])

    own = columns(docs, id=id_col, text=text_col).select(F.col("id").cast("bigint"), "text")
    return own.mapInArrow(run, "id bigint, n_tokens bigint, best_score double").withColumnRenamed("id", id_col)
