"""Queries of frames, media formats and visual actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcelens.catalog import query
from sourcelens.functions import media as M
from sourcelens.functions import text as T
from sourcelens.plans.text_queries import sql_words
from sourcelens.sources.tables import table

MAD_SQL = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) / len(a.embedding)"


@query(f"WITH e AS (SELECT vec_id, CASE WHEN vec_id % 13 = 5 THEN embedding[1:8] WHEN vec_id % 13 = 9 THEN [] ELSE embedding END AS embedding FROM embeddings) SELECT a.vec_id, CASE WHEN len(a.embedding) = len(b.embedding) AND len(a.embedding) > 0 THEN round({MAD_SQL}, 6) ELSE CAST('inf' AS DOUBLE) END AS mad FROM e a JOIN e b ON b.vec_id = a.vec_id - 1")
def agg_thumb_mad(spark, sf_dir):
    """Some vectors are shortened or emptied, as frames of another size are."""
    k, v = F.col("vec_id") % 13, F.col("embedding")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.when(k == 5, F.slice(v, 1, 8)).when(k == 9, F.slice(v, 1, 0)).otherwise(v).alias("embedding"))
    before = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(before, "vec_id").select("vec_id", F.round(M.mean_abs_diff(F.col("embedding"), F.col("b")), 6).alias("mad"))


def boxes(spark, sf_dir) -> DataFrame:
    """Boxes on a frame of 640 by 360 from order lines."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    left, top = (F.col("l_partkey") * 7 % 600).cast("int"), (F.col("l_suppkey") * 11 % 330).cast("int")
    right, bottom = F.least(left + 1 + (F.col("l_quantity") * 13).cast("int"), F.lit(640)), F.least(top + 1 + (F.col("l_quantity") * 7).cast("int"), F.lit(360))
    return l.select("l_orderkey", "l_linenumber", F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")).alias("box"), (F.col("l_partkey") % 2 == 0).alias("text_changed"), (F.col("l_quantity") * 3).alias("diff"))


BOX_SQL = """boxes AS (SELECT l_orderkey, l_linenumber, x, y, least(x + 1 + CAST(floor(l_quantity * 13) AS INT), 640) AS r, least(y + 1 + CAST(floor(l_quantity * 7) AS INT), 360) AS b, l_partkey % 2 = 0 AS text_changed, l_quantity * 3 AS diff
  FROM (SELECT *, CAST(l_partkey * 7 % 600 AS INT) AS x, CAST(l_suppkey * 11 % 330 AS INT) AS y FROM lineitem)),
zoned AS (SELECT *, floor(CAST((r - x) * (b - y) AS DOUBLE) / 230400 * 10000 + 0.5) / 10000 AS ratio, list_sort(list_distinct(list_filter([
  CASE WHEN (y + b) / 2 < 120 THEN 'top' WHEN (y + b) / 2 > 240 THEN 'bottom' ELSE 'middle' END || '_' || CASE WHEN (x + r) / 2 < 640 / 3 THEN 'left' WHEN (x + r) / 2 > 1280 / 3 THEN 'right' ELSE 'center' END,
  CASE WHEN y <= 360 * 0.18 THEN 'top_bar' END, CASE WHEN b >= 360 * 0.82 THEN 'bottom_bar' END, CASE WHEN x <= 640 * 0.18 THEN 'left_rail' END, CASE WHEN r >= 640 * 0.82 THEN 'right_rail' END], lambda z: z IS NOT NULL))) AS zones FROM boxes)"""
ACTION_SQL = """CASE WHEN ratio >= 0.45 THEN 'screen_transition' WHEN list_contains(zones, 'top_bar') OR list_contains(zones, 'left_rail') THEN 'navigation_or_tool_change' WHEN text_changed AND ratio <= 0.12 THEN 'text_entry_or_selection'
  WHEN text_changed THEN 'content_update' WHEN ratio <= 0.03 THEN 'pointer_or_selection_change' WHEN diff >= 60 THEN 'visual_cut' ELSE 'layout_change' END"""


@query(f"WITH {BOX_SQL} SELECT l_orderkey, l_linenumber, ratio FROM zoned")
def fn_bbox_ratio(spark, sf_dir):
    return boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", M.bbox_ratio(F.col("box"), F.lit(640), F.lit(360)).alias("ratio"))


@query(f"WITH {BOX_SQL} SELECT l_orderkey, l_linenumber, array_to_string(zones, ',') AS zones FROM zoned")
def fn_zones(spark, sf_dir):
    return boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array_join(M.zones(F.col("box"), F.lit(640), F.lit(360)), ",").alias("zones"))


@query(f"WITH {BOX_SQL} SELECT l_orderkey, l_linenumber, CAST(len(zones) AS INT) AS n FROM zoned")
def agg_distinct_tags(spark, sf_dir):
    return boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", F.size(M.zones(F.col("box"), F.lit(640), F.lit(360))).alias("n"))


@query(f"WITH {BOX_SQL} SELECT l_orderkey, l_linenumber, {ACTION_SQL} AS action FROM zoned")
def fn_classify_action(spark, sf_dir):
    b = boxes(spark, sf_dir)
    a = M.classify_action(M.bbox_ratio(F.col("box"), F.lit(640), F.lit(360)), M.zones(F.col("box"), F.lit(640), F.lit(360)), F.col("text_changed"), F.col("diff"))
    return b.select("l_orderkey", "l_linenumber", a["action"].alias("action"))


@query(f"WITH {BOX_SQL} SELECT {ACTION_SQL} AS action, count(*) AS n FROM zoned GROUP BY 1")
def rules_actions(spark, sf_dir):
    return fn_classify_action(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
pairs AS (SELECT a.vec_id, list_filter(range(64), lambda i: abs(a.e[CAST(i + 1 AS INT)] - b.e[CAST(i + 1 AS INT)]) > 0.2) AS ch FROM v a JOIN v b ON b.vec_id = a.vec_id - 1)
SELECT vec_id, CAST(list_min(list_transform(ch, lambda i: i % 8)) AS INT) AS l, CAST(list_min(list_transform(ch, lambda i: i // 8)) AS INT) AS t, CAST(list_max(list_transform(ch, lambda i: i % 8)) + 1 AS INT) AS r, CAST(list_max(list_transform(ch, lambda i: i // 8)) + 1 AS INT) AS b FROM pairs WHERE len(ch) > 0""")
def fn_visual_action(spark, sf_dir):
    """The box of changed cells of neighbouring vectors taken as frames of 8 by 8; frames of another size have no box."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    before = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("b"))
    changed = F.zip_with("embedding", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double")) > 0.2)
    box = e.join(before, "vec_id").select("vec_id", F.when(F.size("embedding") == F.size("b"), M.bbox(changed, 8)).alias("x")).where("x is not null")
    return box.select("vec_id", F.col("x.left").alias("l"), F.col("x.top").alias("t"), F.col("x.right").alias("r"), F.col("x.bottom").alias("b"))


@query("SELECT event_id, least(greatest(value / 10, 0.1), 30.0) AS fps, least(greatest(CAST(value AS INT), 4), 600) AS ring FROM (SELECT event_id, floor(value) AS value FROM events)")
def fn_clamp(spark, sf_dir):
    v = F.floor("value")
    return table(spark, sf_dir, "events").select("event_id", M.clamp(v / 10, "fps").alias("fps"), M.clamp(v.cast("int"), "ring_size").alias("ring"))


@query("SELECT event_id, (event_id - 1) / CAST(2.0 AS DOUBLE) AS t FROM events")
def fn_video_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") - 1) / F.lit(2.0)).alias("t"))


FORMAT_SQL = "formats AS (SELECT o_orderkey AS video, l_linenumber AS idx, CASE l_partkey % 3 WHEN 0 THEN 'm3u8_native' WHEN 1 THEN 'https' ELSE 'rtmp' END AS protocol, CAST(l_suppkey % 5 * 360 AS INT) AS height, CAST(l_quantity * 100 AS INT) AS tbr, l_returnflag = 'R' AS audio_only FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def formats(spark, sf_dir) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    k = F.col("l_partkey") % 3
    return l.join(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(
        F.col("l_orderkey").alias("video"), F.col("l_linenumber").alias("idx"), F.when(k == 0, "m3u8_native").when(k == 1, "https").otherwise("rtmp").alias("protocol"), (F.col("l_suppkey") % 5 * 360).cast("int").alias("height"),
        (F.col("l_quantity") * 100).cast("int").alias("tbr"), (F.col("l_returnflag") == "R").alias("audio_only"),
    )


def preference():
    protocol = F.lower(F.coalesce("protocol", F.lit("")))
    return F.when(F.contains(protocol, F.lit("m3u8")), 2).when(F.contains(protocol, F.lit("http")), 1).otherwise(0)


PREF_SQL = "CASE WHEN contains(lower(protocol), 'm3u8') THEN 2 WHEN contains(lower(protocol), 'http') THEN 1 ELSE 0 END"


@query(f"""WITH {FORMAT_SQL}, f AS (SELECT * FROM formats WHERE NOT audio_only AND tbr % 1100 <> 0),
best AS (SELECT video, idx FROM f QUALIFY row_number() OVER (PARTITION BY video ORDER BY {PREF_SQL} DESC, height DESC, tbr DESC, idx) = 1),
low AS (SELECT video, idx AS low FROM f QUALIFY row_number() OVER (PARTITION BY video ORDER BY {PREF_SQL} DESC, CASE WHEN height = 0 THEN 9999 ELSE height END, CASE WHEN tbr = 0 THEN 9999 ELSE tbr END, idx) = 1),
videos AS (SELECT DISTINCT video FROM formats)
SELECT video, idx, low, CASE WHEN idx IS NULL THEN 'https://v.example/' || video END AS url FROM videos LEFT JOIN best USING (video) LEFT JOIN low USING (video) WHERE idx IS NOT NULL OR video % 2 = 0""")
def topk_video_format(spark, sf_dir):
    """The best by protocol, height and bit rate, and for low latency the smallest of the best protocol, the first of equals; formats
    without an address do not count, and a video without any has its own address, if it has one. One aggregation, no sort."""
    able = ~F.col("audio_only") & (F.col("tbr") % 1100 != 0)
    large = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, 9999).otherwise(F.col(c))
    first = -F.col("idx")
    best = F.max_by("idx", F.when(able, F.struct(preference().alias("p"), F.coalesce("height", F.lit(0)).alias("h"), F.coalesce("tbr", F.lit(0)).alias("t"), first.alias("i"))))
    low = F.max_by("idx", F.when(able, F.struct(preference().alias("p"), (-large("height")).alias("h"), (-large("tbr")).alias("t"), first.alias("i"))))
    v = formats(spark, sf_dir).groupBy("video").agg(best.alias("idx"), low.alias("low"))
    own = F.when(F.col("video") % 2 == 0, F.concat(F.lit("https://v.example/"), F.col("video").cast("string")))
    return v.withColumn("url", F.when(F.col("idx").isNull(), own)).where("idx is not null or url is not null")


@query(f"WITH {FORMAT_SQL} SELECT video, idx FROM formats WHERE audio_only QUALIFY row_number() OVER (PARTITION BY video ORDER BY tbr DESC, idx) = 1")
def topk_audio_format(spark, sf_dir):
    f = formats(spark, sf_dir).where("audio_only")
    return f.groupBy("video").agg(F.max_by("idx", F.struct("tbr", -F.col("idx"))).alias("idx"))


TRACK_SQL = "tracks AS (SELECT conv_id AS video, role AS lang, turn AS idx, CASE turn % 4 WHEN 0 THEN 'srv3' WHEN 1 THEN 'ttml' WHEN 2 THEN 'vtt' ELSE 'json3' END AS ext, turn % 2 = 0 AS own FROM conversations)"


@query(f"WITH {TRACK_SQL} SELECT video, lang, idx, ext FROM tracks QUALIFY row_number() OVER (PARTITION BY video, lang ORDER BY own DESC, CASE WHEN ext = 'vtt' THEN 2 WHEN ext IN ('srv3', 'json3') THEN 1 ELSE 0 END DESC, CASE WHEN ext IN ('srv3', 'json3') THEN -idx ELSE idx END) = 1")
def topk_caption_track(spark, sf_dir):
    """Per language: own tracks before automatic ones, vtt before the last of srv3 and json3 before the first other."""
    k = F.col("turn") % 4
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video"), F.col("role").alias("lang"), F.col("turn").alias("idx"), F.when(k == 0, "srv3").when(k == 1, "ttml").when(k == 2, "vtt").otherwise("json3").alias("ext"), (F.col("turn") % 2 == 0).alias("own"))
    late = F.col("ext").isin("srv3", "json3")
    best = F.max_by(F.struct("idx", "ext"), F.struct("own", F.when(F.col("ext") == "vtt", 2).when(late, 1).otherwise(0), F.when(late, F.col("idx")).otherwise(-F.col("idx"))))
    return t.groupBy("video", "lang").agg(best.alias("b")).select("video", "lang", "b.*")


@query("SELECT source, arg_max(doc_id, struct_pack(n := n_chars, d := -doc_id)) AS doc_id FROM documents GROUP BY source")
def topk_largest_file(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"))


TURNS_SQL = "pairs AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-zA-Z0-9][a-zA-Z0-9_\\-]{2,}') AS c, regexp_extract_all(lower(lag(text, 1, '') OVER (PARTITION BY conv_id ORDER BY turn)), '[a-zA-Z0-9][a-zA-Z0-9_\\-]{2,}') AS p FROM conversations)"


def turn_tokens(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("c"), T.tokens(F.lag("text", 1, "").over(w)).alias("p"))


@query(f"WITH {TURNS_SQL} SELECT conv_id, turn, CAST(len(list_distinct(list_filter(c, lambda t: NOT list_contains(p, t)))) AS INT) AS added, CAST(len(list_distinct(list_filter(p, lambda t: NOT list_contains(c, t)))) AS INT) AS removed FROM pairs")
def set_token_except(spark, sf_dir):
    return turn_tokens(spark, sf_dir).select("conv_id", "turn", F.size(F.array_except("c", "p")).alias("added"), F.size(F.array_except("p", "c")).alias("removed"))


@query(f"WITH {TURNS_SQL} SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(c, lambda t: NOT list_contains(p, t))))[1:20], ' ') AS added FROM pairs")
def sort_tokens(spark, sf_dir):
    return turn_tokens(spark, sf_dir).select("conv_id", "turn", F.array_join(F.slice(F.array_sort(F.array_except("c", "p")), 1, 20), " ").alias("added"))


@query("SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS langs FROM conversations GROUP BY conv_id")
def set_lang_union(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    sides = c.groupBy("conv_id").agg(F.collect_set(F.when(F.col("turn") % 2 == 0, F.col("role"))).alias("a"), F.collect_set(F.when(F.col("turn") % 2 == 1, F.col("role"))).alias("b"))
    return sides.select("conv_id", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("langs"))


@query("SELECT role AS lang, turn AS start, text, count(DISTINCT 1) AS n FROM conversations GROUP BY ALL")
def set_cue_distinct(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("role").alias("lang"), F.col("turn").alias("start"), "text")
    return c.union(c).dropDuplicates(["lang", "start", "text"]).withColumn("n", F.lit(1).cast("bigint"))


@query("SELECT conv_id, role AS lang, CAST(count(*) > 2 AS BOOLEAN) AS truncated, CAST(least(count(*), 2) AS BIGINT) AS cues FROM conversations GROUP BY ALL")
def src_captions_oneshot(spark, sf_dir):
    """Per language the first two cues, and whether there are more."""
    g = table(spark, sf_dir, "conversations").groupBy("conv_id", F.col("role").alias("lang")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("c"))
    return g.select("conv_id", "lang", (F.size("c") > 2).alias("truncated"), F.size(F.slice("c", 1, 2)).cast("bigint").alias("cues"))


@query("SELECT conv_id, count(*) AS tracks, bool_or(role = 'user') AS playable, string_agg(DISTINCT role, ',' ORDER BY role) AS languages FROM conversations GROUP BY conv_id")
def src_video_info(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id")
    return c.agg(F.count("*").alias("tracks"), F.bool_or(F.col("role") == "user").alias("playable"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("languages"))


@query("""WITH asked AS (SELECT user_id, min(ts) + to_hours(CAST(user_id % 300 AS INT)) AS asked_at FROM events GROUP BY user_id)
SELECT e.user_id, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id, least(greatest(e.user_id * 7, 64), 1920) AS width, least(greatest(e.user_id % 40, 2), 31) AS quality, least(greatest(e.user_id - 5, 1), 300) AS timeout
FROM events e JOIN asked a ON a.user_id = e.user_id WHERE ts <= asked_at GROUP BY e.user_id""")
def src_frame_snapshot(spark, sf_dir):
    """A user's last frame as of a time some hours after the first, with the request's clamped options."""
    e, u = table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), F.col("user_id")
    asked = e.groupBy("user_id").agg((F.min("ts") + F.make_dt_interval(hours=u % 300)).alias("at"))
    last = e.join(asked, "user_id").where("ts <= at").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    options = {"width": ("frame_width", u * 7), "quality": ("jpeg_quality", u % 40), "timeout": ("snapshot_timeout", u - 5)}
    return last.select("user_id", "event_id", *[M.clamp(x, limit).cast("bigint").alias(n) for n, (limit, x) in options.items()])
