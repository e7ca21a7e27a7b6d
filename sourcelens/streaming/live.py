"""The live path: keyed state over a tagged union of frames, transcripts and captions.

Input rows: session_id, kind (frame, transcript, caption, mark), seq, t (seconds), value (a frame's mean), text, lang.
Batch functions with the same rules replay a finished session; both are the same fold, so results agree.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from sourcelens.operators.runs import Fold, fold_runs

INPUT = StructType([StructField("session_id", LongType()), StructField("kind", StringType()), StructField("seq", LongType()), StructField("t", DoubleType()), StructField("value", DoubleType()), StructField("text", StringType()), StructField("lang", StringType())])
STEPS = StructType([StructField("session_id", LongType()), StructField("ordinal", LongType()), StructField("trigger", StringType()), StructField("start_s", DoubleType()), StructField("end_s", DoubleType()), StructField("diff", DoubleType()), StructField("text", StringType())])
#: A fold's state as it is kept.
FOLD = StructType([StructField("last", DoubleType()), StructField("end", DoubleType()), StructField("n", LongType()), StructField("begin", DoubleType()), StructField("waiting", StringType())])
#: A keyframe's difference, the least gap between steps, and the quiet period, in seconds.
THRESHOLD, MIN_STEP, QUIET, RING = 12.0, 0.5, 8.0, 60


class StepFold:
    """One session's state: the last keyframe, the last step's end, texts that wait, and the newest of each stream."""

    def __init__(self, threshold: float = THRESHOLD, min_step: float = MIN_STEP, quiet: float = QUIET):
        self.threshold, self.min_step, self.quiet = threshold, min_step, quiet
        self.last = self.end = None
        self.n, self.begin, self.waiting = 0, None, ""

    def state(self) -> tuple:
        return (self.last, self.end, self.n, self.begin, self.waiting)

    def restore(self, s: tuple) -> StepFold:
        self.last, self.end, self.n, self.begin, self.waiting = s
        return self

    def _emit(self, trigger: str, t: float, diff: float | None) -> tuple:
        self.n += 1
        row = (self.n, trigger, self.end if self.end is not None else self.begin, t, diff, self.waiting.strip())
        self.end, self.waiting = t, ""
        return row

    def due(self) -> float | None:
        """When the texts that wait make a quiet step, if no frame does before."""
        if self.last is None or self.quiet <= 0 or not self.waiting.strip():
            return None
        return (self.end if self.end is not None else self.begin) + self.quiet

    def tick(self, t: float, since: float = float("-inf")) -> list[tuple]:
        """The quiet step that is due by t; texts that came later, at since, make it then."""
        due = self.due()
        return [] if due is None or due > t else [self._emit("quiet_period", max(due, since), 0.0)]

    def feed(self, kind: str, t: float, value: float | None, text: str | None) -> list[tuple]:
        """Steps that a row completes, and the quiet step that was due before it.

        A row that comes after a timer has ended a step later than the row's own time counts at that step's end.
        """
        self.begin = t if self.begin is None else self.begin
        t = t if self.end is None else max(t, self.end)
        out = self.tick(t)
        if kind == "frame":
            diff = None if self.last is None else abs(value - self.last)
            if diff is None or diff >= self.threshold:
                self.last = value
                if self.end is None or t - self.end >= self.min_step:
                    out.append(self._emit("keyframe", t, diff))
        elif kind in ("transcript", "caption") and text:
            self.waiting += ("\n" if self.waiting else "") + text
            out += self.tick(t, t)
        return out


def in_order(rows: Iterator[Row]) -> list[Row]:
    """A micro-batch's rows of one session by time, null last."""
    return sorted(rows, key=lambda r: tuple((x is None, x) if x is not None else (True, 0) for x in (r.t, r.seq, r.kind)))


def nan_of(x: float | None) -> float:
    """A frame without a value is unlike no other."""
    return float("nan") if x is None else x


def as_rows(kind: StructType, out: list[tuple]) -> Iterator[Row]:
    """Rows of a result; a number that is none is null."""
    named = Row(*kind.names)
    for r in out:
        yield named(*(None if isinstance(x, float) and x != x else x for x in r))


class StepProcessor(StatefulProcessor):
    """Steps from a session's rows; state is a few values, whatever a session's length.

    A timer runs while texts wait, so a quiet step comes when it is due, whether or not another row does.
    """

    def __init__(self, quiet: float = QUIET, threshold: float = THRESHOLD, min_step: float = MIN_STEP):
        self.limits = {"quiet": quiet, "threshold": threshold, "min_step": min_step}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", FOLD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fold, every = self.begun(), in_order(rows)
        out = [(key[0], *step) for r in every for step in fold.feed(r.kind, r.t, nan_of(r.value), r.text)]
        self.ended(fold, every[-1].t, timerValues)
        yield from as_rows(STEPS, out)

    def begun(self) -> StepFold:
        """The session's fold as its last rows left it."""
        fold, stored = StepFold(**self.limits), self.fold.get()
        return fold.restore(tuple(stored)) if stored else fold

    def keep(self, fold: StepFold) -> None:
        self.fold.update(fold.state())

    def ended(self, fold: StepFold, latest: float, timerValues) -> None:
        """Keeps the fold, and sets the timer of the quiet step that is due after the latest row."""
        self.keep(fold)
        if self.limits["quiet"] <= 0:
            return
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if (due := fold.due()) is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * max(0.0, due - latest)) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        fold = self.begun()
        out = [(key[0], *step) for step in fold.tick(float("inf"))]
        self.fold.update(fold.state())
        yield from as_rows(STEPS, out)

    def close(self) -> None:
        pass


def live_steps(rows: DataFrame, quiet: float = QUIET) -> DataFrame:
    """A streaming frame of INPUT rows -> steps, by keyed state and timers."""
    return rows.groupBy("session_id").transformWithState(statefulProcessor=StepProcessor(quiet), outputStructType=STEPS, outputMode="Append", timeMode="ProcessingTime")


class Replay(Fold):
    """A finished session's steps; a quiet step that is due after the last row comes too."""

    def __init__(self):
        self.steps = StepFold()

    def feed(self, kind, t, value, text) -> list[tuple]:
        return self.steps.feed(kind, t, value, text)

    def end(self) -> list[tuple]:
        return self.steps.tick(float("inf"))


def replay(rows: DataFrame) -> DataFrame:
    """The same steps from a finished table, each session read in order with the same state as the stream keeps."""
    return fold_runs(rows, "session_id", ["t", "seq", "kind"], ["kind", "t", "value", "text"], Replay, StructType(STEPS.fields[1:]))


def poll_dedup(cues: DataFrame, watermark: str | None = None) -> DataFrame:
    """Cues seen for the first time over polls. With a watermark on `fetched`, state is dropped behind it."""
    keys = ["session_id", "lang", "start", "end", "text"]
    return cues.withWatermark("fetched", watermark).dropDuplicatesWithinWatermark(keys) if watermark else cues.dropDuplicates(keys)


def vod_gate(cues: DataFrame, age: DataFrame) -> DataFrame:
    """Timed cues that a session's age has reached; later ones come with a later snapshot. Untimed cues go."""
    return cues.where("start is not null").join(age, "session_id").where("start <= age_s").drop("age_s")


def sampled(frames: DataFrame, fps: float) -> DataFrame:
    """The first frame of each interval of 1 / fps seconds."""
    rest = [c for c in frames.columns if c != "session_id"]
    first = frames.groupBy("session_id", F.floor(F.col("t") * fps).alias("_k")).agg(F.min_by(F.struct(*rest), F.struct("t", "seq")).alias("_r"))
    return first.select("session_id", "_r.*")


def audio_chunks(samples: DataFrame, seconds: float, rate: int = 16000, width: int = 2) -> DataFrame:
    """samples(session_id, at, n): bytes from at on -> bytes of each whole chunk that they reach into."""
    size = int(seconds * rate * width)
    cut = samples.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size))))
    part = F.least(F.col("at") + F.col("n"), (F.col("chunk") + 1) * size) - F.greatest(F.col("at"), F.col("chunk") * size)
    return cut.groupBy("session_id", "chunk").agg(F.sum(part).alias("bytes")).withColumn("whole", F.col("bytes") == size)


def poll(rows: DataFrame, since: int, newest: int) -> DataFrame:
    """Of each session the newest rows after a cursor; older ones in between are skipped."""
    w = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    return rows.where(F.col("seq") > since).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= newest).drop("_r")


def status(rows: DataFrame) -> DataFrame:
    """Counters and last-seen times of each session and stream."""
    return rows.groupBy("session_id", "kind").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"), F.max("t").alias("last_seen"))
