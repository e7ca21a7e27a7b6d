from pyspark.sql import functions as F

from sourcelens.operators import steps as S

STEPS = "playbook_id int, ordinal int, trigger string, diff_score double, start_s double, end_s double, caption_text string, keyframe_path string"


def test_sections_break_at_quiet_periods_and_hard_cuts(spark):
    rows = [(1, 1, "keyframe", None, 0.0, 5.0, "Intro talk", None), (1, 2, "keyframe", 15.0, 5.0, 10.0, "Intro continues", None), (1, 3, "quiet_period", 0.0, 10.0, 20.0, "New topic after pause", None), (1, 4, "keyframe", 90.0, 20.0, 25.0, "Hard cut to chart", "keyframes/004.jpg")]
    out = S.distill(spark.createDataFrame(rows, STEPS)).orderBy("ordinal").collect()
    assert [r["step_ordinals"] for r in out] == [[1, 2], [3], [4]]
    assert out[2]["anchor_path"] == "keyframes/004.jpg" and out[0]["text"] == "Intro talk Intro continues" and out[0]["end_s"] == 10.0


def test_a_zero_end_does_not_count(spark):
    rows = [(1, 1, "keyframe", None, 0.0, 5.0, "a b", None), (1, 2, "keyframe", 1.0, 5.0, 0.0, "c", None)]
    assert S.distill(spark.createDataFrame(rows, STEPS)).first()["end_s"] == 5.0


def test_overlap_merge():
    assert S.merged(["and in this video", "in this video we are going", "video we are going to know everything"]) == "and in this video we are going to know everything"
    assert S.merged(["visa", "a"]) == "visa"  # a suffix by characters is absorbed
    assert S.merged(["a b", "x y"]) == "a b x y"
    assert S.merged([]) == ""


def test_caption_without_karaoke_marks(spark):
    df = spark.createDataFrame([("By<00:00:00.120><c> the</c><00:00:00.200><c> end</c><00:00:00.300><c> of</c>",), (None,)], "x string")
    assert [r[0] for r in df.select(S.clean_caption(F.col("x"))).collect()] == ["By the end of", None]


def frames(spark, values, fps):
    return spark.createDataFrame([(1, k, k / fps, float(v)) for k, v in enumerate(values)], "session_id int, seq int, t double, value double")


def test_keyframes_and_trailing_step(spark):
    cues = spark.createDataFrame([(1, "en", 0, 0.5, 0.9, "one"), (1, "en", 1, 3.2, 3.8, "late")], "session_id int, lang string, cue_idx int, cue_start double, cue_end double, cue_text string")
    out = S.process_video(frames(spark, [0, 100, 200, 200, 200], 1), cues, 5.0, 0.5).orderBy("ordinal").collect()
    assert [r["trigger"] for r in out] == ["keyframe"] * 3 + ["quiet_period"]
    assert out[3]["start_s"] == 2.0 and out[3]["end_s"] >= 3.8 and out[1]["caption_text"] == "one" and out[3]["caption_text"] == "late"
    none = S.process_video(frames(spark, [0, 100, 100], 1), cues.where("false"), 5.0, 0.5)
    assert none.count() == 2


def test_throttled_keyframes_move_the_reference(spark):
    k = S.keyframes(frames(spark, [0, 100, 200, 100], 2), 5.0, 2.0)
    assert [r["step"] for r in k.orderBy("seq").collect()] == [True, False, False, False]


def test_interval_join(spark):
    cues = spark.createDataFrame([(1, "en", 0, 0.5, 1.0, "alpha"), (1, "en", 1, 2.0, 2.5, "beta"), (1, "en", 2, 5.0, 5.5, "gamma"), (1, "en", 3, None, None, "never")], "session_id int, lang string, cue_idx int, cue_start double, cue_end double, cue_text string")
    spans = spark.createDataFrame([(1, 1, 0.0, 3.0), (1, 2, 3.0, 6.0), (1, 3, 6.0, 9.0)], "session_id int, ordinal int, start_s double, end_s double")
    assert [r["caption_text"] for r in S.bind_captions(spans, cues).orderBy("ordinal").collect()] == ["alpha\nbeta", "gamma", ""]
