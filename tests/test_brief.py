"""Short renderers against plain restatements."""

import json
import random

from pyspark.sql import functions as F

from sourcelens.operators import brief as B


def cut(text, n):
    words = (text or "").split()
    return " ".join(words[:n]) + ("..." if len(words) > n else "")


def time_of(s):
    s = max(0, int(s))
    return f"{s // 3600}:{s % 3600 // 60:02d}:{s % 60:02d}" if s >= 3600 else f"{s // 60}:{s % 60:02d}"


def name_of(s):
    if s["title"] or s["heading"]:
        return s["title"] or s["heading"]
    if s["page"]:
        return f"Page {s['page']}"
    if s["start_s"] is not None:
        return time_of(s["start_s"]) + ("" if s["end_s"] in (None, s["start_s"]) else "-" + time_of(s["end_s"]))
    return f"Section {s['ordinal'] or '?'}"


def shown(actions):
    out = []
    for a in (actions or [])[:3]:
        label = (a["actionType"] or "unknown").replace("_", " ")
        detail = a["visibleTextSample"] or "; ".join(a["observations"] or [])
        out.append(f"{label}: {cut(detail, 12)}" if detail else label)
    return "; ".join(out + ([f"+{len(actions) - 3} more"] if len(actions or []) > 3 else []))


def known(sections):
    lines = [f"- **{name_of(s)}:** {cut(s['text'], 36) or B.NO_TEXT}" + (f" Visual: {v}" if (v := shown(s["actions"])) else "") for s in sections[:12]]
    return "\n".join(lines + ([f"- Plus {len(sections) - 12} additional source-backed sections in `lessons.md`."] if len(sections) > 12 else []))


def steps(sections):
    lines = [f"{i}. Use **{name_of(s)}** to handle this part: {cut(s['text'], 24) or B.NO_TEXT}" + (f" Use the visual-action evidence ({v}) to preserve what happened on screen." if (v := shown(s["actions"])) else "") for i, s in enumerate(sections[:6], 1)]
    return "\n".join(lines + ([f"7. Check the remaining {len(sections) - 6} source sections in `lessons.md` before claiming full coverage."] if len(sections) > 6 else []))


def section(rng):
    maybe = lambda x: rng.choice([None, x])
    words = lambda n: " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(0, n)))
    action = lambda: {"actionType": rng.choice([None, "", "visual_cut", "x"]), "visibleTextSample": rng.choice([None, "", words(20)]), "observations": rng.choice([None, [], ["one", "two"]])}
    start = maybe(rng.choice([0.0, 59.9, 3599.0, 3600.0, 7325.5, -3.0]))
    return {"ordinal": rng.choice([None, 0, 3]), "title": rng.choice([None, "", "T"]), "heading": rng.choice([None, "", "H \"é\""]), "page": rng.choice([None, 0, 7]), "start_s": start, "end_s": rng.choice([None, start, 4000.0]),
            "text": rng.choice([None, "", "  ", words(60), words(60)]), "actions": rng.choice([None, [], [action() for _ in range(rng.randint(1, 6))]])}


def test_sections(spark):
    rng = random.Random(5)
    rows = [(k, [section(rng) for _ in range(rng.choice([0, 1, 5, 6, 7, 12, 13, 20]))]) for k in range(150)]
    df = spark.createDataFrame(rows, f"k int, s array<{B.SECTION}>")
    got = {r.k: (r.a, r.b) for r in df.select("k", B.knowledge(F.col("s")).alias("a"), B.procedure(F.col("s")).alias("b")).collect()}
    assert got == {k: (known(s), steps(s)) for k, s in rows}


def test_summary_and_frontmatter(spark):
    rows = [("n", "https://x", "t", "c", "s", "workflow", "owner"), ("n", None, "", None, None, "workflow", "null"), ("n m", "", None, "c", "", "skill", None), ("n", None, None, None, None, "workflow", None)]
    df = spark.createDataFrame(rows, "n string, url string, title string, channel string, summary string, shape string, owner string")
    about = B.plain_description(F.col("n"), F.col("url"))
    out = df.select(B.source_summary(*map(F.col, ("n", "url", "title", "channel", "summary"))).alias("a"), about.alias("b"), B.frontmatter(F.col("n"), F.concat(about, F.lit(' "é"\n')), F.col("shape"), F.col("owner")).alias("c")).collect()
    for (n, url, title, channel, summary, shape, owner), r in zip(rows, out):
        lines = [f"- **Playbook:** `{n}`"] + [f"- **{k}:** {v}" for k, v in (("Source", url), ("Title", title), ("Channel", channel), ("Summary", summary)) if v]
        text = f"Apply source-backed lessons from {url or 'captured source'} for {n}."
        assert r.a == "\n".join(lines) and r.b == text
        owned = [f"owner_agent: {owner if owner and owner != 'null' else 'unassigned'}"] if shape == "workflow" else []
        assert r.c == "\n".join(["---", f"name: {n}", "description: " + json.dumps(text + ' "é"\n'), *owned, "---"])


def test_visual_summaries_as_sql_has_them(spark, tmp_path):
    """Documents without text, source or language, odd spaces, names of many words, numbers below zero."""
    import duckdb

    from sourcelens.catalog import ORACLE_SQL
    from sourcelens.plans.evidence_queries import fn_visual_summary

    texts = [None, "", " \n\t", "a\x0bb " * 11, "\x0b", " x\x0b y\u00a0z\x85", "w " * 10, "w " * 11, "a_b $1 \\1"]
    names = [(None, "en"), ("web", None), ("", "en"), ("web", ""), ("", ""), ("web", " "), (" a  b\n", "en"), ("w " * 12, "en"), (None, None)]
    odd = [(t, "web", "en") for t in texts] + [("text", *n) for n in names]
    rows = [(5 * k + j, *r) for k, r in enumerate(odd) for j in range(5)] + [(-3, "text", "web", "en"), (2**62 + 3, "text", "web", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(ORACLE_SQL["fn_visual_summary"]).fetchall()
    assert sorted(map(tuple, fn_visual_summary(spark, str(tmp_path)).collect())) == sorted(want) and len(want) == len(rows)
