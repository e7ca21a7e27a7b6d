from pyspark.sql import functions as F

from sourcelens.operators import evidence as E
from sourcelens.operators import keywords as K
from sourcelens.operators import render as R

CONTEXT = "playbook_id int, source_kind string, words int, sections int, nodes int, nodes_with_actions int, nodes_with_keyframes int, bound_sections int, textful_sections int, codified boolean, exported boolean, captured boolean, validated boolean, passed int, failed int, inputs boolean, outputs boolean, basis string, export_allowed string, scanned boolean, blocked boolean, risk_level string, blob string"


def certified(spark, validated, strict=False, words=2, **change):
    row = dict(zip([c.split()[0] for c in CONTEXT.split(", ")], (1, "web_page", words, 1, 1, 0, 0, 1, 1, True, True, True, validated, 2 if validated else 0, 0, True, True, "owned", "allowed", True, False, "low", "do it")))
    c = spark.createDataFrame([tuple((row | change).values())], CONTEXT)
    return E.certification(c, E.validator_rows(c), strict).first()


def test_certification(spark):
    r = certified(spark, True)
    assert r["status"] == "certified" and r["confidence"] >= 0.75 and r["dimensions"]["rightsGovernance"] == 1.0 and r["dimensions"]["sourceSecurity"] == 1.0 and r["dimensions"]["capabilityIr"] == 1.0
    r = certified(spark, None, strict=True)
    assert r["status"] == "rejected" and r["critical_failures"] == ["execution_validation_passed"]
    assert certified(spark, True, blocked=True)["status"] == "draft"


def test_ledger_chain_breaks_where_it_is_changed(spark):
    l = E.ledger(spark.createDataFrame([("a", k, f"p{k}") for k in range(4)], "chain string, seq int, payload string"))
    assert E.verify_ledger(l).where("not valid").count() == 0
    bad = l.withColumn("payload", F.when(F.col("seq") == 2, "x").otherwise(F.col("payload")))
    assert [r["seq"] for r in E.verify_ledger(bad).where("not valid").collect()] == [2]


def test_registry_keeps_the_latest(spark):
    r = E.registry(spark.createDataFrame([("a", 1, 1, "x"), ("a", 3, 2, "y"), ("b", 2, 3, "z")], "slug string, updated_at int, seq int, v string"))
    assert {x["slug"]: x["v"] for x in r.collect()} == {"a": "y", "b": "z"}


def test_escaping_paths_are_refused(spark):
    n = spark.createDataFrame([("p", 1, "e1", ["a/1.jpg", "/etc/x", "../y", "a/../z", "C:\\w"])], "playbook_id string, section int, evidence_id string, keyframe_paths array<string>")
    assert [r["path"] for r in E.retained_artifacts(n).collect()] == ["a/1.jpg"]


def test_keywords(spark):
    assert K.accept(["data data", "power bi", "bi desktop", "query", "power"]) == ["power bi", "query"]
    texts = [(1, "Power query and power query with refresh https://x.com/en-us"), (2, "refresh gateway")]
    sections = lambda kind, rows: spark.createDataFrame([("p", n, t, kind) for n, t in rows], "playbook_id string, ordinal int, text string, source_kind string")
    assert K.keywords(sections("youtube_video", texts)).first()["keywords"][:2] == ["power query", "refresh"]
    pages = [(n, f"Docs — Heading alpha{n} / https://x.com/{n} / {body}") for n, body in ((1, "gateway beta beta. Rest"), (5000, "gateway beta"), (9000, "delta"))]
    got = {r["phrase"]: r["n"] for r in K.counts(K.section_parts(sections("web_page", pages))).collect()}
    stream = 2 * ["heading", "alpha1", "heading", "alpha5000", "heading", "alpha9000"] + ["gateway", "beta", "beta", "gateway", "beta", "delta"]
    want = {w: stream.count(w) for w in stream} | {f"{a} {b}": sum((a, b) == p for p in zip(stream, stream[1:])) for a, b in zip(stream, stream[1:])}
    assert got == want


def test_reports_and_exports(spark):
    checks = F.array(F.lit("a"), F.lit("b"))
    one = lambda text: spark.range(1).select(R.criteria_report(checks, F.lit(text)).alias("r")).first()["r"]
    assert [x["passed"] for x in one("1. PASS - fine\n2. FAIL: bad")] == [True, False] and one("nothing")[1]["evidence"] == "not reported by executor"
    assert [x["passed"] for x in one('```json\n{"criteria": [{"passed": true}, {"passed": false, "evidence": "e"}]}\n```')] == [True, False]
    text = "---\nname: demo\ndescription: Say \"hi\"\n---\n# Demo\n"
    row = spark.range(1).select(*[R.export_text(F.lit(t), F.lit("demo"), F.lit("demo"), F.lit('Say "hi"'), F.lit(text), F.lit("skill")).alias(t) for t in ("cursor", "codex", "windsurf", "markdown")]).first()
    assert 'description: "Say \\"hi\\""' in row["cursor"] and "alwaysApply: false" in row["cursor"] and row["codex"] == text and row["windsurf"].startswith("# demo\n\nTarget: Windsurf rule")
    path = lambda t: spark.range(1).select(R.export_path(R.resolve_target(F.lit(t)), F.lit("demo"), F.lit("skill"))).first()[0]
    assert path("Codex") == ".agents/skills/demo/SKILL.md" and path("md") == "exports/markdown/demo.md" and path("x") == "error"
