"""Queries of the live path's operators, replayed over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelens.catalog import query
from sourcelens.plans.steps_queries import FOLD_SQL, FRAMES_SQL
from sourcelens.sources.tables import table
from sourcelens.sources.scratch import shared_folder
from sourcelens.streaming import live as L
from sourcelens.streaming import session as V


def rows(spark, sf_dir) -> DataFrame:
    """events as live rows: purchases and sign-ups are captions, the rest frames."""
    e = table(spark, sf_dir, "events")
    text = F.col("event_type").isin("purchase", "signup")
    return e.select(
        F.col("user_id").alias("session_id"), F.when(text, "caption").otherwise("frame").alias("kind"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value",
        F.when(text, F.concat_ws(" ", "event_type", F.col("event_id").cast("string"))).alias("text"), F.lit("en").alias("lang"),
    )


@query()
def st_keyframe_step(spark, sf_dir):
    """Steps with texts attached and quiet periods, as a stream of the whole table gives them; equal to the replay in tests."""
    return L.replay(rows(spark, sf_dir))


@query()
def st_quiet_step(spark, sf_dir):
    return L.replay(rows(spark, sf_dir)).where("trigger = 'quiet_period'")


@query()
def st_text_attach(spark, sf_dir):
    return L.replay(rows(spark, sf_dir)).where("text <> ''").select("session_id", "ordinal", "text")


join_since_last_step = query(name="join_since_last_step")(lambda spark, sf_dir: st_text_attach(spark, sf_dir))


@query(f"WITH {FRAMES_SQL} SELECT session_id, seq FROM frames QUALIFY row_number() OVER (PARTITION BY session_id, floor(t * (1.0::DOUBLE / 3600)) ORDER BY t, seq) = 1")
def st_frame_sample(spark, sf_dir):
    return L.sampled(rows(spark, sf_dir), 1.0 / 3600).select("session_id", "seq")


def streamed(spark, parts: list[DataFrame], run) -> None:
    """Runs a stream over parts that arrive one after another, started anew for each. run(stream input, trigger) starts it."""
    folder = shared_folder(spark)
    with V.stateful(spark):
        for part in parts:
            part.write.mode("append").parquet(f"{folder}/in")
            run(spark.readStream.schema(part.schema).option("maxBytesPerTrigger", 1 << 30).parquet(f"{folder}/in")).awaitTermination()


def frame_rows(spark, sf_dir) -> list[DataFrame]:
    """All events as frames, in two parts: up to the thousandth, and the rest."""
    every = rows(spark, sf_dir).withColumns({"kind": F.lit("frame"), "text": F.lit(None).cast("string")}).select(*L.INPUT.names)
    return [every.where("seq <= 1000"), every.where("seq > 1000")]


def watched(spark, sf_dir, read=None, **limits) -> V.SessionStore:
    """A store into which both parts are streamed; read(store) is called between them."""
    store, (first, rest) = V.SessionStore(spark, shared_folder(spark)), frame_rows(spark, sf_dir)
    run = lambda source: store.start(V.records(source, **limits), availableNow=True)

    def parts():
        yield first
        if read:
            read(store)
        yield rest

    streamed(spark, parts(), run)
    return store


@query(f"WITH {FRAMES_SQL} SELECT session_id, seq FROM frames WHERE seq > 1000 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 60")
def st_poll(spark, sf_dir):
    """The second poll of a reader: the stream stops after the thousandth event, is polled, goes on and is polled again."""
    store = watched(spark, sf_dir, lambda s: s.poll("reader", 60), quiet=0.0)
    return store.poll("reader", 60).where("stream = 'frame'").select("session_id", "seq")


@query(FOLD_SQL + "SELECT session_id, seq FROM fold WHERE step AND seq > 1000 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 12")
def st_follow(spark, sf_dir):
    """Steps behind a follower's cursor, of a stream that was started twice."""
    store = watched(spark, sf_dir, lambda s: s.follow("reader", 12), quiet=0.0, threshold=12.0, min_step=3600.0)
    return store.follow("reader", 12).select("session_id", "seq")


@query(f"WITH {FRAMES_SQL} SELECT session_id, seq FROM frames QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 60")
def st_ring_buffer(spark, sf_dir):
    """What the frames' rings hold after a stream that was started twice."""
    return watched(spark, sf_dir, quiet=0.0).ring().where("stream = 'frame'").select("session_id", "seq")


@query("""WITH c AS (SELECT DISTINCT conv_id, role, turn * 3.7::DOUBLE AS start, text FROM conversations WHERE turn % 4 <> 3 AND text <> '')
SELECT conv_id AS session_id, role AS lang, start, text, CASE WHEN start <= 4 THEN 4.0::DOUBLE ELSE 15.0::DOUBLE END AS age_s FROM c WHERE start <= 15""")
def st_held_cues(spark, sf_dir):
    """Cues of a track that is polled whole at the ages of 4 and 15 seconds, each once, when playback has reached it."""
    folder = shared_folder(spark)
    at = lambda age: cues(spark, sf_dir).select("session_id", F.lit(False).alias("live"), F.lit(100.0).alias("started_at"), F.lit(100.0 + age).alias("t"), "lang", "start", "end", "text")
    sink = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    run = lambda source: V.given_cues(source, timers=False).writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    streamed(spark, [at(4.0), at(15.0)], run)
    return spark.read.schema(V.GIVEN).parquet(f"{folder}/out").select("session_id", "lang", "start", "text", "age_s")


@query("SELECT user_id AS session_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'caption' ELSE 'frame' END AS kind, count(*) AS n, max(event_id) AS last_seq FROM events GROUP BY ALL")
def st_status(spark, sf_dir):
    return L.status(rows(spark, sf_dir)).drop("last_seen")


@query("SELECT DISTINCT user_id AS session_id FROM events")
def st_list(spark, sf_dir):
    return L.status(rows(spark, sf_dir)).select("session_id").distinct()


@query("SELECT user_id AS session_id, max(event_id) AS stopped_at FROM events GROUP BY user_id")
def st_stop(spark, sf_dir):
    return L.status(rows(spark, sf_dir)).groupBy("session_id").agg(F.max("last_seq").alias("stopped_at"))


def cues(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    start = F.when(F.col("turn") % 4 != 3, F.col("turn") * 3.7)
    return c.select(F.col("conv_id").alias("session_id"), F.col("role").alias("lang"), start.alias("start"), (start + 2.5).alias("end"), "text")


@query("SELECT DISTINCT conv_id AS session_id, role AS lang, CASE WHEN turn % 4 <> 3 THEN turn * 3.7::DOUBLE END AS start, text FROM conversations")
def st_caption_poll_dedup(spark, sf_dir):
    c = cues(spark, sf_dir)
    return L.poll_dedup(c.union(c)).select("session_id", "lang", "start", "text")


GATE_SQL = "SELECT conv_id AS session_id, turn * 3.7::DOUBLE AS start FROM conversations WHERE turn % 4 <> 3 AND turn * 3.7::DOUBLE <= conv_id % 12"


@query(GATE_SQL)
def st_vod_gate(spark, sf_dir):
    c = cues(spark, sf_dir)
    age = c.select("session_id", (F.col("session_id") % 12).alias("age_s")).distinct()
    return L.vod_gate(c, age).select("session_id", "start")


join_caption_asof = query(GATE_SQL, name="join_caption_asof")(lambda spark, sf_dir: st_vod_gate(spark, sf_dir))


@query("SELECT conv_id AS session_id, role AS lang, turn * 3.7::DOUBLE AS start FROM conversations WHERE turn % 4 <> 3")
def st_untimed_drop(spark, sf_dir):
    return cues(spark, sf_dir).where("start is not null").select("session_id", "lang", "start")


@query("""WITH s AS (SELECT user_id AS session_id, event_id * 1000 AS a, CAST(floor(value * 100) + 1 AS BIGINT) AS n FROM events),
cut AS (SELECT session_id, a, n, unnest(range(a // 128000, (a + n - 1) // 128000 + 1)) AS chunk FROM s)
SELECT session_id, chunk, CAST(sum(least(a + n, (chunk + 1) * 128000) - greatest(a, chunk * 128000)) AS BIGINT) AS bytes FROM cut GROUP BY ALL""")
def st_audio_chunk(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), (F.col("event_id") * 1000).alias("at"), (F.floor(F.col("value") * 100) + 1).alias("n"))
    return L.audio_chunks(e, 4.0).select("session_id", "chunk", "bytes")


@query(FOLD_SQL + "SELECT session_id, count(*) FILTER (step) AS steps, max(seq) AS last_seq FROM fold GROUP BY session_id")
def st_step_snapshot(spark, sf_dir):
    from sourcelens.operators import steps as S
    from sourcelens.plans.steps_queries import frames

    f = frames(spark, sf_dir)
    k = S.keyframes(f, 12.0, 3600.0).where("step").groupBy("session_id").agg(F.count("*").alias("steps"))
    return f.groupBy("session_id").agg(F.max("seq").alias("last_seq")).join(k, "session_id").select("session_id", "steps", "last_seq")


@query("""WITH asked AS (SELECT user_id AS session_id, max(value) / 10 AS fps, CAST(max(event_id) % 1000 AS INT) AS ring, CAST(min(value) AS DOUBLE) AS chunk FROM events GROUP BY user_id)
SELECT session_id, least(greatest(fps, 0.1), 30.0) AS fps, least(greatest(ring, 4), 600) AS ring, least(greatest(chunk, 1.5), 30.0) AS chunk,
  fps BETWEEN 0.1 AND 30.0 AND ring BETWEEN 4 AND 600 AND chunk BETWEEN 1.5 AND 30.0 AS as_asked FROM asked""")
def st_readiness(spark, sf_dir):
    """The settings that sessions ask for within their limits, and whether none had to be changed."""
    from sourcelens.functions.media import clamp

    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session_id")).agg((F.max("value") / 10).alias("fps"), (F.max("event_id") % 1000).cast("int").alias("ring"), F.min("value").cast("double").alias("chunk"))
    held = {"fps": clamp(F.col("fps"), "fps"), "ring": clamp(F.col("ring"), "ring_size"), "chunk": clamp(F.col("chunk"), "audio_chunk")}
    same = (held["fps"] == F.col("fps")) & (held["ring"] == F.col("ring")) & (held["chunk"] == F.col("chunk"))
    return e.select("session_id", *[c.alias(k) for k, c in held.items()], same.alias("as_asked"))
