"""Queries of steps, sections and ordered folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcelens.catalog import query
from sourcelens.functions import text as T
from sourcelens.operators import steps as S
from sourcelens.plans.text_queries import sql_words
from sourcelens.sources.tables import STEPS_SQL, steps, table

MARKED_SQL = f"""WITH {STEPS_SQL}, marked AS (
  SELECT *, CAST(sum(CASE WHEN ordinal = 1 OR trigger = 'quiet_period' OR diff_score >= 60 THEN 1 ELSE 0 END) OVER (PARTITION BY playbook_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS INT) AS section FROM steps)
"""
SECTIONS_SQL = MARKED_SQL + """, sections AS (
  SELECT playbook_id, section AS ordinal, arg_min(trigger, ordinal) AS trigger, list(ordinal ORDER BY ordinal) AS step_ordinals, string_agg(caption_text, ' ' ORDER BY ordinal) AS text
  FROM marked GROUP BY playbook_id, section)
"""


@query(MARKED_SQL + "SELECT playbook_id, ordinal, section FROM marked")
def win_section_id(spark, sf_dir):
    return S.section_ids(steps(spark, sf_dir)).select("playbook_id", "ordinal", "section")


@query(SECTIONS_SQL + f"SELECT playbook_id, ordinal, trigger, array_to_string(step_ordinals, ',') AS steps, text, CAST(len({sql_words('text')}) AS INT) AS word_count FROM sections")
def agg_section_build(spark, sf_dir):
    s = S.sections(steps(spark, sf_dir), merge=False)
    return s.select("playbook_id", "ordinal", "trigger", F.array_join(F.transform("step_ordinals", lambda o: o.cast("string")), ",").alias("steps"), "text", "word_count")


@query(SECTIONS_SQL + f"SELECT playbook_id, count(*) AS sections, CAST(sum(len({sql_words('text')})) AS BIGINT) AS words FROM sections GROUP BY playbook_id")
def agg_word_count(spark, sf_dir):
    return S.sections(steps(spark, sf_dir), merge=False).groupBy("playbook_id").agg(F.count("*").alias("sections"), F.sum("word_count").alias("words"))


@query()
def op_distill(spark, sf_dir):
    """Sections with rolling captions merged; the merge has no SQL form and is tested against its plain restatement."""
    return S.distill(steps(spark, sf_dir)).select("playbook_id", "ordinal", "trigger", F.array_join(F.transform("step_ordinals", lambda o: o.cast("string")), ",").alias("steps"), "text", "word_count")


FRAMES_SQL = "frames AS (SELECT user_id AS session_id, event_id AS seq, epoch_us(ts) / 1e6 AS t, value FROM events)"


def frames(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value")


FOLD_SQL = f"""WITH RECURSIVE {FRAMES_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, seq) AS k FROM frames),
fold AS (
  SELECT session_id, k, seq, t, value AS last, t AS emitted, true AS key, true AS step, CAST(NULL AS DOUBLE) AS diff FROM numbered WHERE k = 1
  UNION ALL
  SELECT n.session_id, n.k, n.seq, n.t, CASE WHEN abs(n.value - f.last) >= 12 THEN n.value ELSE f.last END, CASE WHEN abs(n.value - f.last) >= 12 AND n.t - f.emitted >= 3600 THEN n.t ELSE f.emitted END,
         abs(n.value - f.last) >= 12, abs(n.value - f.last) >= 12 AND n.t - f.emitted >= 3600, abs(n.value - f.last)
  FROM fold f JOIN numbered n ON n.session_id = f.session_id AND n.k = f.k + 1)
"""


@query(FOLD_SQL + "SELECT session_id, seq, round(diff, 6) AS diff FROM fold WHERE key")
def win_keyframe_fold(spark, sf_dir):
    return S.keyframes(frames(spark, sf_dir), 12.0).select("session_id", "seq", F.round("diff", 6).alias("diff"))


@query(FOLD_SQL + "SELECT session_id, seq FROM fold WHERE step")
def win_min_step_throttle(spark, sf_dir):
    return S.keyframes(frames(spark, sf_dir), 12.0, 3600.0).where("step").select("session_id", "seq")


INTERVAL_SQL = FOLD_SQL + ", spans AS (SELECT session_id, seq, CAST(row_number() OVER w AS INT) AS ordinal, coalesce(lag(t) OVER w, 0) AS start_s, t AS end_s FROM fold WHERE step WINDOW w AS (PARTITION BY session_id ORDER BY t, seq))"


def spans(spark, sf_dir) -> DataFrame:
    return S.intervals(S.keyframes(frames(spark, sf_dir), 12.0, 3600.0).where("step").select("session_id", "seq", "t"))


@query(INTERVAL_SQL + " SELECT session_id, ordinal, start_s, end_s FROM spans")
def win_step_interval(spark, sf_dir):
    return spans(spark, sf_dir).select("session_id", "ordinal", "start_s", "end_s")


@query(INTERVAL_SQL + " SELECT session_id, ordinal, round(end_s - start_s, 3) AS seconds FROM spans")
def win_seconds_since_prev(spark, sf_dir):
    return spans(spark, sf_dir).select("session_id", "ordinal", F.round("since_previous", 3).alias("seconds"))


@query(INTERVAL_SQL + " SELECT session_id, ordinal, seq, lag(seq) OVER (PARTITION BY session_id ORDER BY ordinal) AS previous FROM spans")
def win_prev_keyframe_pair(spark, sf_dir):
    return spans(spark, sf_dir).select("session_id", "ordinal", "seq", F.lag("seq").over(Window.partitionBy("session_id").orderBy("ordinal")).alias("previous"))


def cues(spark, sf_dir) -> DataFrame:
    """Turns as cues; a conversation is a session, its role the language."""
    c = table(spark, sf_dir, "conversations")
    start = F.col("turn") * F.lit(3.7)
    return c.select(F.col("conv_id").alias("session_id"), F.col("role").alias("lang"), F.col("turn").alias("cue_idx"), start.alias("cue_start"), (start + F.lit(2.5)).alias("cue_end"), F.coalesce("text", F.lit("")).alias("cue_text"))


def windows(spark, sf_dir) -> DataFrame:
    """Windows of five seconds over each conversation."""
    last = cues(spark, sf_dir).groupBy("session_id").agg(F.max("cue_end").alias("e"))
    w = last.select("session_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("e") / 5).cast("int"))).alias("k"))
    return w.select("session_id", (F.col("k") + 1).alias("ordinal"), (F.col("k") * F.lit(5.0)).alias("start_s"), (F.col("k") * F.lit(5.0) + F.lit(5.0)).alias("end_s"))


CUES_SQL = "cues AS (SELECT conv_id AS session_id, role AS lang, turn AS cue_idx, turn * CAST(3.7 AS DOUBLE) AS cue_start, turn * CAST(3.7 AS DOUBLE) + CAST(2.5 AS DOUBLE) AS cue_end, coalesce(text, '') AS cue_text FROM conversations)"
WINDOWS_SQL = "windows AS (SELECT session_id, k + 1 AS ordinal, k * 5.0 AS start_s, k * 5.0 + 5.0 AS end_s FROM (SELECT session_id, unnest(range(CAST(floor(max(cue_end) / 5) AS BIGINT) + 1)) AS k FROM cues GROUP BY session_id))"


@query(f"WITH {CUES_SQL}, {WINDOWS_SQL} SELECT w.session_id, CAST(w.ordinal AS INT) AS ordinal, coalesce(string_agg(c.cue_text, chr(10) ORDER BY lang, cue_idx, cue_text), '') AS caption_text FROM windows w LEFT JOIN cues c ON c.session_id = w.session_id AND cue_start >= start_s AND cue_start < end_s GROUP BY ALL")
def join_cue_interval(spark, sf_dir):
    return S.bind_captions(windows(spark, sf_dir), cues(spark, sf_dir)).select("session_id", "ordinal", "caption_text")


@query(f"WITH {CUES_SQL}, last AS (SELECT session_id, max(cue_end) / 2 AS start_s, max(cue_end) AS e FROM cues GROUP BY session_id) SELECT l.session_id, round(start_s, 6) AS start_s, round(e, 6) AS end_s, string_agg(c.cue_text, chr(10) ORDER BY lang, cue_idx, cue_text) AS caption_text FROM last l JOIN cues c ON c.session_id = l.session_id AND cue_start >= start_s AND cue_start < e + 0.001 GROUP BY ALL HAVING string_agg(c.cue_text, chr(10) ORDER BY lang, cue_idx, cue_text) <> ''")
def win_trailing_flush(spark, sf_dir):
    c = cues(spark, sf_dir)
    ends = c.groupBy("session_id").agg(F.max("cue_end").alias("e"))
    done = ends.select("session_id", (F.col("e") / 2).alias("end_s"), F.lit(1).alias("ordinal"))
    out = S.trailing_steps(done, ends.select("session_id", F.col("e").alias("t")), c)
    return out.select("session_id", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), "caption_text")


@query(f"WITH {CUES_SQL} SELECT session_id, coalesce(max(cue_end), 0) AS seconds FROM cues GROUP BY session_id")
def agg_max_caption_end(spark, sf_dir):
    return cues(spark, sf_dir).groupBy("session_id").agg(F.coalesce(F.max("cue_end"), F.lit(0.0)).alias("seconds"))


@query()
def op_process_video(spark, sf_dir):
    """Frames of a session from its cues' times and lengths, as steps; tested against a plain restatement."""
    c = cues(spark, sf_dir)
    f = c.select("session_id", F.col("cue_idx").alias("seq"), F.col("cue_start").alias("t"), (F.length("cue_text") % 97).cast("double").alias("value"))
    return S.process_video(f, c)


@query()
def win_overlap_merge(spark, sf_dir):
    """Lines of documents with the last words of the line before repeated, as rolling captions have them."""
    lines = F.split("text", "\n")
    rolled = F.transform(lines, lambda x, i: F.when(i == 0, x).otherwise(F.concat_ws(" ", F.array_join(F.slice(F.reverse(T.words(F.get(lines, i - 1))), 1, 4), " "), x)))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.overlap_merge(rolled)).alias("h"))


@query()
def fn_clean_caption(spark, sf_dir):
    marked = F.regexp_replace("text", r" (\w+)", "<00:00:01.200><c> $1</c>")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.clean_caption(marked)).alias("h"))


@query(f"WITH {STEPS_SQL} SELECT playbook_id, sequence, CAST(row_number() OVER (PARTITION BY playbook_id ORDER BY ordinal) AS INT) AS ordinal FROM steps WHERE trigger <> 'quiet_period'")
def win_ordinal(spark, sf_dir):
    kept = steps(spark, sf_dir).where("trigger <> 'quiet_period'")
    return kept.select("playbook_id", "sequence", F.row_number().over(Window.partitionBy("playbook_id").orderBy("ordinal")).alias("ordinal"))


@query("SELECT conv_id, turn, t, lead(t) OVER (PARTITION BY conv_id ORDER BY turn, k) AS next FROM (SELECT conv_id, turn, unnest(w) AS t, unnest(range(len(w))) AS k FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z][a-z0-9\\-]{2,}') AS w FROM conversations))")
def win_bigram(spark, sf_dir):
    """Neighbouring tokens over a conversation, across the seams of its turns."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z][a-z0-9\-]{2,}"), F.lit(0))).alias("k", "t"))
    return c.select("conv_id", "turn", "t", F.lead("t").over(Window.partitionBy("conv_id").orderBy("turn", "k")).alias("next"))


@query(f"WITH {STEPS_SQL} SELECT playbook_id, sequence FROM steps WHERE ordinal > 5 QUALIFY row_number() OVER (PARTITION BY playbook_id ORDER BY ordinal DESC) <= 12")
def lim_last_n_steps(spark, sf_dir):
    s = steps(spark, sf_dir).where("ordinal > 5").withColumn("r", F.row_number().over(Window.partitionBy("playbook_id").orderBy(F.desc("ordinal"))))
    return s.where("r <= 12").select("playbook_id", "sequence")


@query(f"WITH {FRAMES_SQL} SELECT session_id, seq FROM frames WHERE seq > 100 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 60")
def lim_last_n_frames(spark, sf_dir):
    f = frames(spark, sf_dir).where("seq > 100").withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq"))))
    return f.where("r <= 60").select("session_id", "seq")


@query(f"WITH {FRAMES_SQL} SELECT session_id, seq FROM frames QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY t DESC, seq DESC) <= 60")
def lim_ring_buffer(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("t"), F.desc("seq"))))
    return f.where("r <= 60").select("session_id", "seq")


@query("SELECT event_id FROM events WHERE event_id > 500")
def flt_since_sequence(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_id > 500").select("event_id")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN NULL ELSE turn * 3.7 END AS s FROM conversations) WHERE s IS NOT NULL")
def flt_untimed_cue(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("s", F.when(F.col("turn") % 3 != 1, F.col("turn") * 3.7))
    return c.where("s is not null").select("conv_id", "turn")


@query(f"""WITH {STEPS_SQL}, own AS (SELECT *, lag(us) OVER (PARTITION BY playbook_id ORDER BY ordinal) AS before, row_number() OVER (PARTITION BY playbook_id ORDER BY sequence) AS n FROM steps)
SELECT playbook_id, n AS ordinal, sequence, before AS started_at, us AS ended_at, trigger, diff_score, round((us - before) / CAST(1000000 AS DOUBLE), 3) AS since_previous, CAST(ordinal * 2 AS DOUBLE) AS video_start_s, CASE WHEN ordinal % 4 <> 0 THEN CAST(ordinal * 2 + 1 AS DOUBLE) END AS video_end_s,
  CASE WHEN sequence % 3 <> 0 THEN 'keyframes/' || printf('%03d', n) || '.jpg' END AS keyframe_path, 640 AS width, 360 AS height, CAST(CASE sequence % 3 WHEN 0 THEN 0 ELSE strlen(caption_text) END AS INT) AS keyframe_bytes,
  CASE WHEN ordinal % 5 = 0 THEN 'said ' || sequence ELSE '' END AS transcript, CASE WHEN ordinal % 7 = 0 THEN '' ELSE caption_text END AS caption_text, CASE WHEN sequence % 2 = 0 THEN trigger END AS visual_action FROM own""")
def proj_step_normalise(spark, sf_dir):
    """Steps as a playbook keeps them, with all fields; some without a keyframe, with an empty one, or without texts."""
    s, o, q = steps(spark, sf_dir), F.col("ordinal"), F.col("sequence")
    before = F.lag("us").over(Window.partitionBy("playbook_id").orderBy("ordinal"))
    captured = s.withColumn("started_at", before).select(
        "playbook_id", "sequence", "started_at", F.col("us").alias("ended_at"), "trigger", "diff_score", F.round((F.col("us") - F.col("started_at")) / 1e6, 3).alias("since_previous"), (o * 2).cast("double").alias("video_start_s"),
        F.when(o % 4 != 0, (o * 2 + 1).cast("double")).alias("video_end_s"), F.when(q % 3 == 1, F.col("caption_text").cast("binary")).when(q % 3 == 2, F.col("caption_text").cast("binary")).when(q % 6 == 0, F.lit("").cast("binary")).alias("keyframe"),
        F.lit(640).alias("width"), F.lit(360).alias("height"), F.when(o % 5 == 0, F.concat(F.lit("said "), q.cast("string"))).alias("transcript"), F.when(o % 7 != 0, F.col("caption_text")).alias("caption_text"), F.when(q % 2 == 0, F.col("trigger")).alias("visual_action"),
    )
    return S.persisted(captured)


@query("SELECT doc_id, CAST(100 AS DOUBLE) AS diff_score, 'document_section' AS trigger, concat_ws(chr(10) || chr(10), concat_ws(' / ', source, 'page ' || CAST(CASE WHEN doc_id % 2 = 0 THEN doc_id END AS VARCHAR), nullif(lang, 'en')), nullif(trim(text), '')) AS caption_text FROM documents")
def proj_doc_step(spark, sf_dir):
    head = F.concat_ws(" / ", "source", F.concat(F.lit("page "), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).cast("string")), F.nullif(F.col("lang"), F.lit("en")))
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(100.0).alias("diff_score"), F.lit("document_section").alias("trigger"), F.concat_ws("\n\n", head, F.nullif(F.trim("text"), F.lit(""))).alias("caption_text"))


@query(f"WITH {STEPS_SQL}, last AS (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY playbook_id ORDER BY ordinal DESC) <= 20) SELECT playbook_id, sequence, CAST(row_number() OVER (PARTITION BY playbook_id ORDER BY ordinal) AS INT) AS ordinal FROM last")
def sink_playbook(spark, sf_dir):
    """Every playbook saved with its last steps and read back; a save of each second one again is refused, a rename of each third carried out."""
    from sourcelens.operators.playbook_store import PlaybookStore
    from sourcelens.sources.scratch import shared_folder

    none = F.lit(None).cast("string")
    s = steps(spark, sf_dir).withColumns({"start_s": none.cast("double"), "end_s": none.cast("double"), "keyframe": F.col("caption_text").cast("binary"), "request": F.col("playbook_id")})
    who = s.select("playbook_id").distinct()
    k, name = F.col("playbook_id"), F.concat(F.lit("Watch "), F.col("playbook_id").cast("string"))
    ask = lambda op, shift, new=none: who.select((k + shift).alias("request"), F.lit(op).alias("op"), name.alias("name"), new.alias("new_name"), F.lit(False).alias("overwrite"), none.alias("source_url"), name.alias("summary"), "playbook_id")
    base = 1 << 40
    again = s.where(k % 2 == 0).withColumn("request", k + base)
    asked = ask("save", 0).union(ask("save", base).where(k % 2 == 0)).union(ask("rename", 2 * base, F.concat(F.lit("Topic "), name)).where(k % 3 == 0)).drop("playbook_id")
    store = PlaybookStore(spark, shared_folder(spark))
    columns = ["request", "sequence", "trigger", "diff_score", "start_s", "end_s", "caption_text", "keyframe"]
    store.apply(asked, s.select(*columns).unionByName(again.select(*columns)), 20)
    return store.steps().select(F.regexp_extract("name", r"(\d+)$", 1).cast("long").alias("playbook_id"), "sequence", "ordinal")


@query(f"WITH {STEPS_SQL} SELECT playbook_id, sequence FROM steps WHERE ordinal = 3")
def src_keyframe_point(spark, sf_dir):
    return steps(spark, sf_dir).where("ordinal = 3").select("playbook_id", "sequence")


@query(f"WITH {STEPS_SQL} SELECT playbook_id, ordinal, CASE WHEN row_number() OVER (PARTITION BY playbook_id ORDER BY ordinal DESC) <= 3 THEN base64(encode(caption_text)) END AS keyframe FROM steps")
def src_playbook_read(spark, sf_dir):
    r = F.row_number().over(Window.partitionBy("playbook_id").orderBy(F.desc("ordinal")))
    return steps(spark, sf_dir).select("playbook_id", "ordinal", F.when(r <= 3, F.base64(F.col("caption_text").cast("binary"))).alias("keyframe"))


@query(f"WITH {STEPS_SQL} SELECT playbook_id, count(*) AS step_count, max(us) AS updated FROM steps GROUP BY playbook_id")
def src_playbook_list(spark, sf_dir):
    return steps(spark, sf_dir).groupBy("playbook_id").agg(F.count("*").alias("step_count"), F.max("us").alias("updated"))


@query(f"WITH {STEPS_SQL} SELECT playbook_id, string_agg('- [' || CAST(ordinal AS VARCHAR) || '] ' || trigger || ': ' || caption_text, chr(10) ORDER BY ordinal) AS transcript FROM steps GROUP BY playbook_id")
def sink_transcript_md(spark, sf_dir):
    line = F.concat(F.lit("- ["), F.col("ordinal").cast("string"), F.lit("] "), "trigger", F.lit(": "), "caption_text")
    g = steps(spark, sf_dir).groupBy("playbook_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("l"))
    return g.select("playbook_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("transcript"))


@query(SECTIONS_SQL + "SELECT playbook_id, string_agg('## Section ' || CAST(ordinal AS VARCHAR) || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY ordinal) AS lessons FROM sections GROUP BY playbook_id")
def sink_lessons(spark, sf_dir):
    line = F.concat(F.lit("## Section "), F.col("ordinal").cast("string"), F.lit("\n\n"), "text")
    g = S.sections(steps(spark, sf_dir), merge=False).groupBy("playbook_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("l"))
    return g.select("playbook_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("lessons"))
