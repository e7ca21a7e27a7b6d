"""Scaffolds and finished texts against plain restatements."""

import json
import random

from pyspark.sql import functions as F

from sourcelens import asset_texts as A
from sourcelens import rules
from sourcelens.operators import assets, brief
from tests.test_brief import cut, name_of, section, shown, time_of

FIELDS = "id int, name string, shape string, kind string, about string, title string, url string, seconds double, pages int, path string, seed string, channel string, summary string, scope_notes string, owner_agent string"


def actions_seen(actions, limit, words):
    out = []
    for a in (actions or [])[:limit]:
        label, detail = (a["actionType"] or "unknown").replace("_", " "), a["visibleTextSample"] or "; ".join(a["observations"] or [])
        out.append(f"{label}: {cut(detail, words)}" if detail else label)
    return "; ".join(out + ([f"+{len(actions) - limit} more"] if len(actions or []) > limit else []))


def label_of(kind, s):
    n = f"§{'?' if s['ordinal'] is None else s['ordinal']}"
    at = lambda x: "?:??" if x is None else time_of(x)
    if kind == "youtube_video":
        return f"{n} ({at(s['start_s'])}–{at(s['end_s'])})"
    text = s["text"] or ""
    if kind == "pdf":
        first = text.split(" ")
        page = first[1] if len(first) > 1 and first[0] == "Page" and first[1].isdigit() else n[1:]
        return f"{n} (page {page})"
    heading = text.split(" / ", 1)[0].strip()
    heading = heading.split(" — ", 1)[1].strip() if " — " in heading else heading
    return f"{n} — {heading}" if heading else n


def source_lines(p):
    kind, url, title = p["kind"] or "youtube_video", p["url"] or "(unknown)", p["title"] or p["name"]
    pages, words = p["pages"] or "?", sum(len((s["text"] or "").split()) for s in p["sections"] or []) or "?"
    length = "?" if p["seconds"] is None else f"{int(p['seconds']) // 60} min"
    return [f"- **Playbook:** `{p['name']}`"] + {
        "youtube_video": [f"- **Video:** {title} ({length})", f"- **Source URL:** {url}"],
        "web_page": [f"- **Source page:** {url} ({words} words)"],
        "pdf": [f"- **Source PDF:** {p['path'].split('/')[-1] if p['path'] else title} ({pages} pages)", f"- **Source URL:** {url}"],
        "documentation_site": [f"- **Source docs root:** {p['seed'] or url} ({pages} pages)"],
    }.get(kind, [f"- **Source:** {title}", f"- **Source URL:** {url}"])


def curriculum(sections, limit):
    lines = [f"- **{name_of(s)}:** {cut(s['text'], 36) or brief.NO_TEXT}" + (f" Visual: {v}" if (v := shown(s["actions"])) else "") for s in sections[:limit]]
    return lines + ([f"- Plus {len(sections) - limit} additional source-backed sections in `lessons.md`."] if len(sections) > limit else [])


def procedure(sections):
    lines = [f"{i}. Use **{name_of(s)}** to handle this part: {cut(s['text'], 24) or brief.NO_TEXT}" + (f" Use the visual-action evidence ({v}) to preserve what happened on screen." if (v := shown(s["actions"])) else "") for i, s in enumerate(sections[:6], 1)]
    return lines + ([f"7. Check the remaining {len(sections) - 6} source sections in `lessons.md` before claiming full coverage."] if len(sections) > 6 else [])


def page(layout, words, parts):
    """Lines as one would type them: a block, then an empty line."""
    lines = []
    for b in layout:
        if isinstance(b, A.Part):
            lines += [*parts[b.name], ""]
        elif not isinstance(b, A.Given) or words[b.name]:
            text = b if isinstance(b, str) else b.text
            lines += [*text.format(**words).split("\n"), ""]
    return "\n".join(lines)


def scaffold(p):
    kind, sections = p["kind"] or "youtube_video", p["sections"] or []
    shape = p["shape"] if p["shape"] in A.SCAFFOLDS else "skill"
    line = lambda s: f"- **{label_of(kind, s)}** — {cut(s['text'], 30) or '_(no caption text)_'}"
    visual = lambda s: [f"  - Visual: {v}"] if (v := actions_seen(s["actions"], 2, 10)) else []
    words = {"name": p["name"], "about": p["about"] or "", "owner": p["owner_agent"] or "null", "summary": p["summary"] or "", "n": len(sections), "product": "sourcelens", "codifier": "codify command",
             "knows": f"Distilled from {len(sections)} sections of the source playbook. " + rules.KNOWS.get(kind, rules.KNOWS[""]), "scope": f"\n- **Author scope notes:** {p['scope_notes'].strip()}" if p["scope_notes"] else ""}
    parts = {"source": source_lines(p), "shown_sections": [x for s in sections for x in (line(s), *visual(s))], "listed_sections": [line(s) for s in sections]}
    return page(A.SCAFFOLDS[shape], words, parts)


def done(p):
    sections, shape = p["sections"] or [], p["shape"] if p["shape"] in A.FINISHED else "skill"
    if not any((s["text"] or "").split() for s in sections):
        return None
    source = p["url"] or p["seed"]
    about = p["about"] or f"Apply source-backed lessons from {source or 'captured source'} for {p['name']}."
    owner = p["owner_agent"] if p["owner_agent"] not in (None, "", "null") else "unassigned"
    front = ["---", f"name: {p['name']}", f"description: {json.dumps(about)}", *([f"owner_agent: {owner}"] if shape == "workflow" else []), "---"]
    rows = [f"| {i} | source-backed-playbook-review | request + {name_of(s)} | step_{i}_result | section claim is grounded and checked | retry with narrower source context or stop for user input |" for i, s in enumerate(sections[:8], 1)]
    known = {"Source": source, "Title": p["title"], "Channel": p["channel"], "Summary": p["summary"]}
    parts = {"summary_lines": [f"- **Playbook:** `{p['name']}`", *[f"- **{k}:** {v}" for k, v in known.items() if v]], "knowledge": curriculum(sections, 12), "curriculum": curriculum(sections, 16), "procedure": procedure(sections)}
    return page(A.FINISHED[shape], {"frontmatter": "\n".join(front), "name": p["name"], "owner": owner, "product": "sourcelens", "steps": "\n".join(rows)}, parts)


def playbook(rng, i):
    maybe = lambda *x: rng.choice([None, "", *x])
    sections = rng.choice([None, [], [section(rng)], [section(rng) for _ in range(rng.randint(2, 20))]])
    for s in sections or []:
        s["start_s"], s["end_s"] = (None if x is None else abs(x) for x in (s["start_s"], s["end_s"]))
        s["text"] = rng.choice([s["text"], f"Page {i} {s['text']}", f"Guide — Part / https://x.org {s['text']}"])
    return {"id": i, "name": f"n{{n}}-{i}", "shape": rng.choice(["skill", "agent", "workflow", "workflow", "other", None]), "kind": rng.choice(["youtube_video", "web_page", "pdf", "documentation_site", "local_video", None]),
            "about": maybe("Says \"é\" and {name}"), "title": maybe("T"), "url": maybe("https://x.org/a"), "seconds": rng.choice([None, 0.0, 61.0, 7200.5]), "pages": rng.choice([None, 0, 9]), "path": maybe("/in/a.pdf"), "seed": maybe("https://x.org/docs"),
            "channel": maybe("C"), "summary": maybe("Sums {n} up"), "scope_notes": maybe(" only\nthis \n"), "owner_agent": maybe("null", "lead"), "sections": sections}


def made(spark, books):
    df = spark.createDataFrame([tuple(b.values()) for b in books], f"{FIELDS}, sections array<{brief.SECTION}>")
    return assets.finished(assets.scaffolds(df, "scaffold"), "text").withColumn("extra", F.lit(1)).select("id", "scaffold", "text").collect()


def test_texts(spark):
    rng = random.Random(11)
    books = [playbook(rng, i) for i in range(150)]
    got = {r["id"]: (r["scaffold"], r["text"]) for r in made(spark, books)}
    for b in books:
        assert got[b["id"]][0] == scaffold(b)
        assert got[b["id"]][1] == done(b)


def test_empty_table(spark):
    assert made(spark, []) == []


def test_every_layout_has_its_contract():
    heads = lambda layout: [b[3:] for b in layout if isinstance(b, str) and b.startswith("## ")]
    assert heads(A.SKILL_SCAFFOLD) == ["Source playbook", "What this skill knows", "Inputs", "Outputs", "How to apply", "Success criteria", "Failure modes", "Dependencies", "Source notes"]
    assert heads(A.AGENT_SCAFFOLD) == ["Role", "Source playbook", "Curriculum", "Inputs", "Outputs", "Owned skills", "When to invoke this agent", "Constraints", "Error handling", "Source notes"] == heads(A.AGENT)
    assert heads(A.WORKFLOW_SCAFFOLD) == ["Role", "Source playbook", "Inputs", "Outputs", "Steps", "Decision gates", "Data flow", "Rollback", "Curriculum reference", "Source notes"] == heads(A.WORKFLOW)
    stubs = [sum("_(Stub." in b for b in layout if isinstance(b, str)) for layout in (A.SKILL_SCAFFOLD, A.AGENT_SCAFFOLD, A.WORKFLOW_SCAFFOLD, A.SKILL, A.AGENT, A.WORKFLOW)]
    assert stubs == [6, 6, 6, 0, 0, 0]


def test_validation(spark):
    text = "# A\n\n## Inputs\n\n- `a` (string, required): local paths\n- `b` (int): x\n- c (no): y\n\n## Success criteria\n\n- one\n-  two  \n\n## Next\n\n- three\n"
    rows = [
        (1, text, "1. PASS: x\n2. fail - y\n2. PASS", 0), (2, text, '```json\n{"criteria": [{"name": "n", "passed": true}]}\n```\n1. FAIL\n2. pass', 0), (3, text, None, 0), (4, text, "1. PASS\n2. PASS", 1), (5, text, "1. PASS\n2. PASS", None),
        (6, "## Success criteria of old\n- no\n", "1. PASS", 0), (7, None, None, None), (8, "", "", 0),
    ]
    df = spark.createDataFrame(rows, "id int, t string, r string, code int")
    got = {r["id"]: r for r in assets.validated(df, F.col("t"), F.col("r"), F.col("code")).collect()}
    assert [(c["check"], c["passed"], c["evidence"]) for c in got[1]["criteria"]] == [("one", True, "x"), ("two", False, "y")]
    assert [(c["check"], c["passed"], c["evidence"]) for c in got[2]["criteria"]] == [("one", True, None), ("two", True, None)]
    assert [c["evidence"] for c in got[3]["criteria"]] == ["not reported by executor"] * 2
    assert [(got[i]["ok"], got[i]["passed"], got[i]["failed"], got[i]["error"] is None) for i in range(1, 9)] == [
        (False, 1, 1, True), (True, 2, 0, True), (False, 0, 2, True), (False, 2, 0, True), (False, 2, 0, True), (False, 0, 0, False), (False, 0, 0, False), (False, 0, 0, False)]
    assert [tuple(x) for x in got[1]["inputs"]] == [("a", "string, required"), ("b", "int")] and got[7]["inputs"] == []
