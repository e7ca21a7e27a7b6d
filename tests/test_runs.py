"""Folds over sorted runs: long chains, appends at stored heads, and hashes of canonical JSON."""

import hashlib
import json

from pyspark.sql import functions as F

from sourcelens.operators import evidence as E
from sourcelens.operators import steps as S


def plain_chain(entries, before=""):
    for seq, payload in entries:
        before = hashlib.sha256(f"{before}|{seq}|{payload}".encode()).hexdigest()
    return before


def test_a_chain_of_a_million_entries_beside_short_ones(spark):
    n = 1_000_000
    long = spark.range(n).select(F.lit("long").alias("chain"), "id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("payload"))
    short = spark.range(300).select(F.concat(F.lit("s"), (F.col("id") % 100).cast("string")).alias("chain"), "id", F.lit("x").alias("payload"))
    out = E.ledger(long.union(short).withColumnRenamed("id", "seq"))
    heads = {r.chain: r.event_hash for r in E.ledger_heads(out).collect()}
    assert len(heads) == 101 and heads["long"] == plain_chain((k, f"p{k}") for k in range(n))
    assert heads["s7"] == plain_chain((k, "x") for k in (7, 107, 207))


def test_an_append_begins_at_the_stored_head(spark):
    rows = [(c, k, f"p{k}") for c in ("a", None, "b") for k in range(6)]
    every = spark.createDataFrame(rows, "chain string, seq int, payload string")
    whole = {(r.chain, r.seq): r.event_hash for r in E.ledger(every).collect()}
    heads = E.ledger_heads(E.ledger(every.where("seq < 3 and (chain is null or chain = 'a')")))
    rest = E.ledger(every.where("seq >= 3 or chain = 'b'"), heads=heads)
    got = {(r.chain, r.seq): r.event_hash for r in rest.collect()}
    assert got == {k: v for k, v in whole.items() if k[1] >= 3 or k[0] == "b"} and len(got) == 12
    assert E.ledger(every.where("seq < 0")).count() == 0


def test_ledger_of_null_payloads_and_repeated_numbers(spark):
    out = E.ledger(spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 2, "w")], "chain string, seq int, payload string"))
    got = [(r.payload, r.event_hash) for r in out.orderBy("seq", "payload").collect()]
    first = hashlib.sha256(b"|1").hexdigest()
    assert got[0] == (None, first) and got[1] == ("w", plain_chain([(2, "w")], first)) and got[2] == ("x", plain_chain([(2, "w"), (2, "x")], first))
    assert E.verify_ledger(out.where("seq = 1")).first().valid


def test_keyframes_of_odd_frames(spark):
    rows = [(1, 0, 0.0, None), (1, 1, 1.0, 5.0), (1, 2, 2.0, None), (1, 3, 3.0, 99.0), (None, 4, 0.0, 1.0), (None, 5, 0.5, 40.0), (None, 6, 9.0, 80.0)]
    out = S.keyframes(spark.createDataFrame(rows, "session_id long, seq long, t double, value double").repartition(3), 12.0, 2.0)
    got = {(r.session_id, r.seq): (r.diff, r.step) for r in out.collect()}
    assert got == {(1, 0): (None, True), (1, 1): (None, False), (1, 3): (94.0, True), (None, 4): (None, True), (None, 5): (39.0, False), (None, 6): (40.0, True)}


def test_signature_and_artifacts_against_json(spark):
    kind = "playbook_id long, status string, confidence double, dimensions map<string, double>, critical_failures array<string>, note string"
    rows = [(1, "certified", 0.925, {"b": 1.0, "a": 0.333}, [], "é \"x\""), (2, "draft", 0.1, {}, ["late", "early"], None)]
    df = spark.createDataFrame(rows, kind)
    signed = E.signature(df)
    for r in signed.collect():
        own = r.asDict(recursive=True)
        assert own.pop("signature") == hashlib.sha256(json.dumps(own, sort_keys=True).encode()).hexdigest()
    assert {r.signature for r in E.signature(signed).collect()} == {r.signature for r in signed.collect()}  # a signature signs no signature
    made = df.select("playbook_id", F.struct("dimensions", "status").alias("ir"), F.col("note").alias("asset"))
    got = {r.playbook_id: (r.capability, r.asset) for r in E.artifact_hashes(made, "playbook_id", capability="ir", asset="asset").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {1: (sha(json.dumps({"dimensions": {"a": 0.333, "b": 1.0}, "status": "certified"}, sort_keys=True)), sha("é \"x\"")), 2: (sha('{"dimensions": {}, "status": "draft"}'), None)}
