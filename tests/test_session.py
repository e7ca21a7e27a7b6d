"""Live sessions: rings, cursors and restarts against plain restatements; cues that are held back."""

import time

import pytest

from sourcelens.streaming import live as L
from sourcelens.streaming import session as V


@pytest.fixture(scope="module", autouse=True)
def keyed_state(spark):
    with V.stateful(spark):
        yield


def rows(*items):
    """(session, kind, t, value, text) as INPUT rows."""
    return [(s, kind, n, float(t), value, text, "en") for n, (s, kind, t, value, text) in enumerate(items)]


PARTS = [
    rows(*[(1, "frame", k, 30.0 * (k % 3), None) for k in range(7)], (1, "caption", 3.5, None, "a"), (1, "caption", 5.5, None, " "), (1, "transcript", 6.0, None, " said "), (2, "frame", 1, 5.0, None)),
    rows(*[(1, "frame", k, 7.0 * (k % 4), None) for k in range(10, 13)], (1, "caption", 10.5, None, "b"), (2, "caption", 12, None, "c"), (3, "frame", 20, 1.0, None)),
]
PARTS[1] = [(s, kind, 100 + n, *rest) for s, kind, n, *rest in PARTS[1]]


def plain(parts, ring):
    """All records by (session, stream), each with its number, and the steps of a plain fold without quiet periods."""
    out, folds = {}, {}
    for part in parts:
        for s, kind, n, t, value, text, _ in sorted(part, key=lambda r: (r[3], r[2], r[1])):
            text = (text or "").strip()
            fold = folds.setdefault(s, L.StepFold(quiet=0.0))
            for _, trigger, _, end, _, said in fold.feed(kind, t, value, text):
                out.setdefault((s, "step"), []).append((n, end, said))
            if kind == "frame" or text:
                out.setdefault((s, kind), []).append((n, t, text))
    return {k: [(i, *r) for i, r in enumerate(v, 1)] for k, v in out.items()}


def found(df):
    out = {}
    for r in df.orderBy("sequence").collect():
        out.setdefault((r.session_id, r.stream), []).append((r.sequence, r.seq, r.t, r.text or ""))
    return out


def test_rings_cursors_and_restarts(spark, tmp_path):
    ring, store = 4, V.SessionStore(spark, str(tmp_path / "store"))
    assert store.poll("early").count() == 0

    def arrive(part):
        spark.createDataFrame(part, L.INPUT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = V.records(spark.readStream.schema(L.INPUT).parquet(str(tmp_path / "in")), ring=ring, quiet=0.0)
        store.start(stream, availableNow=True).awaitTermination()

    arrive(PARTS[0])
    first = plain(PARTS[:1], ring)
    assert found(store.ring()) == {k: v[-ring:] for k, v in first.items()}
    assert found(store.poll("a", most_frames=2)) == {k: v[-2:] if k[1] == "frame" else v[-ring:] for k, v in first.items() if k[1] != "step"}
    assert store.poll("a").count() == 0  # nothing is new
    assert found(store.follow("a", 12)) == {k: v[-ring:] for k, v in first.items() if k[1] == "step"}

    arrive(PARTS[1])
    every = plain(PARTS, ring)
    assert found(store.everything()) == every  # a restart gives nothing twice and numbers on
    assert found(store.ring()) == {k: v[-ring:] for k, v in every.items()}
    behind = {k: [r for r in v[-ring:] if r[0] > len(first.get(k, []))] for k, v in every.items()}
    assert found(store.poll("a", most_frames=60)) == {k: v for k, v in behind.items() if v and k[1] != "step"}
    assert found(store.follow("a", 1)) == {k: v[-1:] for k, v in behind.items() if v and k[1] == "step"}
    assert found(store.poll("b", most_frames=60)) == {k: v[-ring:] for k, v in every.items() if k[1] != "step"}  # another reader has its own cursor

    last = store.spark.read.schema(V.RECORDS).parquet(f"{store.path}/records/batch=1")
    store.write(spark.createDataFrame(last.collect(), V.RECORDS), 1)  # the batch comes again
    assert found(store.everything()) == every
    status = {(r.session_id, r.stream): (r.n, r.in_ring) for r in store.status().collect()}
    assert status == {k: (len(v), min(len(v), ring)) for k, v in every.items()}


def test_a_poll_waits_for_what_is_new(spark, tmp_path):
    store = V.SessionStore(spark, str(tmp_path / "store"))
    began = time.time()
    assert store.poll("a", wait=1.0).count() == 0 and time.time() - began >= 1.0
    store.write(spark.createDataFrame([(1, "frame", 1, 1, 7, None, 0.0, 1.0, None, None, None)], V.RECORDS), 0)
    began = time.time()
    assert store.poll("a", wait=30.0).count() == 1 and time.time() - began < 20


def test_a_row_that_comes_after_the_timer():
    """The quiet step has ended at 8; a frame of second 5 that comes later counts there, so no step ends before it starts."""
    fold = L.StepFold()
    fold.feed("frame", 0.0, 0.0, None)
    fold.feed("caption", 1.0, None, "a")
    assert fold.tick(float("inf")) == [(2, "quiet_period", 0.0, 8.0, 0.0, "a")]
    late = fold.feed("frame", 5.0, 90.0, None)
    assert late == [] and fold.last == 90.0  # within the least gap of the step before
    assert fold.feed("frame", 9.0, 0.0, None) == [(3, "keyframe", 8.0, 9.0, 90.0, "")]


CUES = [("en", 0.0, 1.0, "zero"), ("en", 2.5, None, "two"), ("fr", 2.5, 4.0, "deux"), ("en", 6.9, 8.0, "seven"), ("en", 7.0, 9.0, "at seven"), ("en", 30.0, 31.0, "never"), ("en", None, None, "untimed"), ("en", 1.0, 2.0, None), ("en", 1.0, 2.0, ""), (None, 3.0, 3.5, "no language")]


def polled(age, cues=CUES, sessions=((1, False), (2, True))):
    return [(s, live, 1000.0, 1000.0 + age, *c) for s, live in sessions for c in cues]


def cue_stream(spark, tmp_path, timers):
    sink = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    source = spark.readStream.schema(V.POLLED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    return V.given_cues(source, timers=timers).writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/checkpoint")


def given(spark, tmp_path):
    return sorted((tuple(r)[:5] for r in spark.read.schema(V.GIVEN).parquet(f"{tmp_path}/out").collect()), key=str)


def test_held_cues_equal_the_batch_gate_at_every_age(spark, tmp_path):
    track = spark.createDataFrame([(1, *c) for c in CUES], "session_id long, lang string, start double, end double, text string").where("text <> ''")
    live = sorted([(2, *c) for c in CUES if c[3]], key=str)
    for age in (2.0, 2.5, 7.0, 8.0):
        spark.createDataFrame(polled(age), V.POLLED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        cue_stream(spark, tmp_path, False).trigger(availableNow=True).start().awaitTermination()
        gate = L.vod_gate(track, spark.createDataFrame([(1, age)], "session_id long, age_s double"))
        want = sorted([*(tuple(r) for r in gate.collect()), *live], key=str)
        assert given(spark, tmp_path) == want
    assert len(given(spark, tmp_path)) == len(set(given(spark, tmp_path))) == 6 + len(live)


def test_held_cues_come_without_another_poll(spark, tmp_path):
    spark.createDataFrame(polled(2.0, [("en", 1.0, None, "now"), ("en", 4.0, None, "soon"), ("en", 5.0, None, "next"), ("en", 900.0, None, "never")], [(1, False)]), V.POLLED).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = cue_stream(spark, tmp_path, True).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 90
        while time.time() < until:
            time.sleep(1)
            try:
                if len(given(spark, tmp_path)) == 3:
                    break
            except Exception:  # the first batch has not been written
                pass
        assert [r[4] for r in given(spark, tmp_path)] == ["now", "soon", "next"]
    finally:
        q.stop()


class Value:
    """Keyed state that counts its round trips."""

    def __init__(self, calls):
        self.calls, self.value = calls, None

    def get(self):
        self.calls.append("get")
        return self.value

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def update(self, value):
        self.calls.append("update")
        self.value = value


def test_state_is_read_and_written_once_a_batch():
    """Whatever a micro-batch holds, a session's state takes two round trips; rings begin where their size says."""
    from pyspark.sql import Row

    calls = []

    class Handle:
        def getValueState(self, name, schema):
            return Value(calls)

        def __getattr__(self, name):
            raise AssertionError(f"state of another kind: {name}")

    p = V.SessionProcessor(ring=3, quiet=0.0, threshold=12.0, min_step=0.0)
    p.init(Handle())
    row = Row("kind", "seq", "t", "value", "text", "lang")
    batch = lambda k: [row("frame", i, float(i), 20.0 * i, None, None) for i in range(k, k + 5)] + [row("caption", 90 + k, k + 0.5, None, "x", "en")]
    first, second = (list(p.handleInputRows((7,), iter(batch(k)), None)) for k in (1, 6))
    assert calls == ["get", "update"] * 2
    frames = [r for r in second if r["stream"] == "frame"]
    assert [(r["oldest"], r["sequence"], r["seq"]) for r in frames] == [(8, k, k) for k in range(6, 11)]
    assert [(r["oldest"], r["sequence"], r["value"]) for r in first + second if r["stream"] == "caption"] == [(1, 1, None), (1, 2, None)]
