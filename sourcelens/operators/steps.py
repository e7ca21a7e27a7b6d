"""Steps and sections: folds over ordered frames and fragments, gaps and islands, distillation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from sourcelens.functions import text as T
from sourcelens.functions.pieces import by_row
from sourcelens.operators.runs import Fold, fold_runs

#: A hard cut's difference, a keyframe's, the longest overlap and the shortest, in words.
SECTION_DIFF, KEYFRAME_DIFF = 60.0, 12.0
MOST_OVERLAP, LEAST_OVERLAP = 40, 3


def absorb(last: str, piece: str) -> tuple[str, str | None]:
    """(the last entry as it becomes, a new entry if the piece makes one)."""
    if last == piece or last.endswith(piece):
        return last, None
    if piece.startswith(last):
        return piece, None
    a, b = last.split(), piece.split()
    for n in range(min(len(a), len(b), MOST_OVERLAP), LEAST_OVERLAP - 1, -1):
        if a[-n:] == b[:n]:
            rest = " ".join(b[n:])
            return (f"{last} {rest}" if rest else last), None
    return last, piece


def merged(pieces) -> str:
    out: list[str] = []
    for piece in pieces:
        piece = (piece or "").strip()
        if not piece:
            continue
        if not out:
            out.append(piece)
            continue
        out[-1], new = absorb(out[-1], piece)
        if new:
            out.append(new)
    return " ".join(out)


@by_row(StringType())
def overlap_merge(pieces: list[str] | None) -> str | None:
    """Fragments that roll over each other as one text."""
    return None if pieces is None else merged(pieces)


def clean_caption(x: Column) -> Column:
    return overlap_merge(T.split_fragments(x))


def persisted(steps: DataFrame) -> DataFrame:
    """Captured steps as a playbook keeps them: numbered from 1 by sequence, texts never null, a path for each keyframe that has bytes.

    steps: playbook_id, sequence, started_at, ended_at, trigger, diff_score, since_previous, video_start_s, video_end_s,
    keyframe, width, height, transcript, caption_text, visual_action.
    """
    number = F.row_number().over(Window.partitionBy("playbook_id").orderBy("sequence"))
    size = F.coalesce(F.octet_length("keyframe"), F.lit(0))
    name = F.concat(F.lit("keyframes/"), F.when(F.col("ordinal") < 1000, F.lpad(F.col("ordinal").cast("string"), 3, "0")).otherwise(F.col("ordinal").cast("string")), F.lit(".jpg"))
    blank = F.lit("")
    return steps.withColumn("ordinal", number).select(
        "playbook_id", "ordinal", "sequence", "started_at", "ended_at", "trigger", "diff_score", "since_previous", "video_start_s", "video_end_s", F.when(size > 0, name).alias("keyframe_path"), "width", "height",
        size.alias("keyframe_bytes"), F.coalesce("transcript", blank).alias("transcript"), F.coalesce("caption_text", blank).alias("caption_text"), "visual_action",
    )


def section_ids(steps: DataFrame, threshold: float = SECTION_DIFF) -> DataFrame:
    """steps with section: a new one at the first step, a quiet period or a hard cut."""
    order = Window.partitionBy("playbook_id").orderBy("ordinal")
    cut = (F.row_number().over(order) == 1) | (F.col("trigger") == "quiet_period") | F.coalesce(F.col("diff_score") >= threshold, F.lit(False))
    return steps.withColumn("_cut", cut.cast("int")).withColumn("section", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_cut")


def sections(steps: DataFrame, threshold: float = SECTION_DIFF, merge: bool = True) -> DataFrame:
    """A row per section with its steps' ordinals, times and text; steps may carry start_s, end_s and keyframe_path."""
    marked = section_ids(steps, threshold)
    times = {c: F.col(c) if c in steps.columns else F.lit(None) for c in ("start_s", "end_s", "keyframe_path")}
    rows = marked.select("playbook_id", "section", F.struct("ordinal", "trigger", "caption_text", times["start_s"].cast("double").alias("start_s"), times["end_s"].cast("double").alias("end_s"), times["keyframe_path"].cast("string").alias("path")).alias("s"))
    grouped = rows.groupBy("playbook_id", "section").agg(F.array_sort(F.collect_list("s")).alias("s"))
    pieces = F.filter(F.flatten(F.transform("s", lambda s: T.split_fragments(F.coalesce(s["caption_text"], F.lit(""))))), lambda p: p != "")
    text = overlap_merge(pieces) if merge else F.array_join(pieces, " ")
    last_end = F.aggregate("s", F.lit(None).cast("double"), lambda a, s: F.when(F.coalesce(s["end_s"], F.lit(0.0)) != 0, s["end_s"]).otherwise(a))
    out = grouped.select(
        "playbook_id", F.col("section").alias("ordinal"), F.get("s", F.lit(0))["trigger"].alias("trigger"), F.get("s", F.lit(0))["start_s"].alias("start_s"), last_end.alias("end_s"),
        F.get(F.transform(F.filter("s", lambda s: s["path"].isNotNull()), lambda s: s["path"]), F.lit(0)).alias("anchor_path"), F.transform("s", lambda s: s["ordinal"]).alias("step_ordinals"), text.alias("text"),
    )
    return out.withColumn("word_count", T.word_count(F.col("text")))


def distill(steps: DataFrame, threshold: float = SECTION_DIFF) -> DataFrame:
    return sections(steps, threshold)


KEYFRAMES = StructType([StructField("t", DoubleType()), StructField("seq", LongType()), StructField("value", DoubleType()), StructField("diff", DoubleType()), StructField("step", BooleanType())])


class KeyframeFold(Fold):
    """The last keyframe's value and the last emitted step's time; a frame without a value has no difference."""

    def __init__(self, threshold: float, min_gap: float):
        self.threshold, self.min_gap, self.last, self.emitted = threshold, min_gap, None, None

    def feed(self, t, seq, value) -> list[tuple]:
        diff = None if value is None or self.last is None else abs(value - self.last)
        if self.last is not None and (diff is None or diff < self.threshold):
            return []
        step = self.emitted is None or (t is not None and t - self.emitted >= self.min_gap)
        self.last = value
        if step:
            self.emitted = t
        return [(t, seq, value, diff, step)]


def keyframes(frames: DataFrame, threshold: float = KEYFRAME_DIFF, min_gap: float = 0.0) -> DataFrame:
    """frames(session_id, seq, t, value) -> frames that are keyframes, with diff and whether a step is emitted.

    The reference value advances at every keyframe, the throttle's clock at every emitted step. A session's frames are
    folded in order with these two numbers as state, whatever their number.
    """
    own = frames.select("session_id", F.col("t").cast("double").alias("t"), F.col("seq").cast("bigint").alias("seq"), F.col("value").cast("double").alias("value"))
    return fold_runs(own, "session_id", ["t", "seq"], ["t", "seq", "value"], lambda: KeyframeFold(threshold, min_gap), KEYFRAMES)


def intervals(emitted: DataFrame) -> DataFrame:
    """emitted(session_id, seq, t) -> with ordinal, start_s (the end of the step before, 0 at first) and end_s."""
    order = Window.partitionBy("session_id").orderBy("t", "seq")
    out = emitted.withColumn("ordinal", F.row_number().over(order)).withColumn("start_s", F.coalesce(F.lag("t").over(order), F.lit(0.0))).withColumn("end_s", F.col("t"))
    return out.withColumn("since_previous", F.col("end_s") - F.col("start_s"))


def bind_captions(steps: DataFrame, cues: DataFrame, width: float = 30.0) -> DataFrame:
    """Text of the cues that start in [start_s, end_s) of each step, by language, then cue.

    Steps are dealt to time buckets that they touch and cues to their own, so the join has an equality on both.
    """
    first, last = F.floor(F.col("start_s") / width), F.floor(F.greatest(F.col("start_s"), F.col("end_s")) / width)
    touched = steps.withColumn("_b", F.explode(F.sequence(first, last)))
    timed = cues.where("cue_start is not null").withColumn("_b", F.floor(F.col("cue_start") / width)).withColumnRenamed("session_id", "_s")
    met = touched.join(timed, (F.col("session_id") == F.col("_s")) & (touched["_b"] == timed["_b"]) & (F.col("cue_start") >= F.col("start_s")) & (F.col("cue_start") < F.col("end_s")))
    text = met.groupBy("session_id", "ordinal").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lang", "cue_idx", "cue_text"))), lambda c: c["cue_text"]), "\n").alias("caption_text"))
    return steps.join(text, ["session_id", "ordinal"], "left").withColumn("caption_text", F.coalesce("caption_text", F.lit("")))


def trailing_steps(steps: DataFrame, frames: DataFrame, cues: DataFrame) -> DataFrame:
    """One quiet step per session that has cues after its last step: from there to the end of the frames or of the cues.

    frames(session_id, t), or with frame_end, the number of frames by their rate; else the last frame's time counts.
    Captions count that start up to 0.001 after the step's end.
    """
    last = steps.groupBy("session_id").agg(F.max("end_s").alias("start_s"), F.max("ordinal").alias("n"))
    ends = frames.groupBy("session_id").agg(F.max("frame_end" if "frame_end" in frames.columns else "t").alias("frame_end")).join(cues.groupBy("session_id").agg(F.max("cue_end").alias("cue_end")), "session_id", "left")
    spans = last.join(ends, "session_id").select("session_id", (F.col("n") + 1).alias("ordinal"), "start_s", F.greatest("start_s", "frame_end", F.coalesce("cue_end", F.lit(0.0))).alias("until")).where("until > start_s")
    spans = spans.withColumn("end_s", F.col("until") + 0.001)
    return bind_captions(spans, cues).where("caption_text <> ''").withColumns({"trigger": F.lit("quiet_period"), "end_s": F.col("until")}).drop("until")


def process_video(frames: DataFrame, cues: DataFrame, threshold: float = KEYFRAME_DIFF, min_gap: float = 0.5) -> DataFrame:
    """Frames and cues as steps: keyframes, throttle, intervals, captions, and the trailing quiet step."""
    base = intervals(keyframes(frames, threshold, min_gap).where("step").select("session_id", "seq", "t", "diff"))
    steps = bind_captions(base, cues).withColumn("trigger", F.lit("keyframe"))
    names = ["session_id", "ordinal", "trigger", "start_s", "end_s", "caption_text"]
    return steps.select(*names, F.col("diff").alias("diff_score")).unionByName(trailing_steps(base, frames, cues).select(*names, F.lit(0.0).alias("diff_score")))
