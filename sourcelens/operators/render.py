"""Assets, exports and reports as text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelens import rules
from sourcelens.functions import text as T


def by_kind(kind: Column, values: dict) -> Column:
    """The value of the kind, or that of ""."""
    made = {k: F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v) for k, v in values.items()}
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in made.items() if k for x in (F.lit(k), v)]), kind), made[""])


def filled(template: Column, **values: Column) -> Column:
    """The template with each {name} replaced by its value."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{%s}" % name), value)
    return template


def input_phrase(kind: Column) -> Column:
    return by_kind(kind, rules.INPUT_PHRASES)


def trigger_phrases(topic: Column, kind: Column) -> Column:
    """Three ways to ask for the topic."""
    bare = F.trim(F.coalesce(topic, F.lit("")))
    named = F.when(bare != "", bare).otherwise(rules.NO_TOPIC)
    return F.transform(by_kind(kind, rules.TRIGGER_PHRASES), lambda x: filled(x, t=named))


def procedure_lead(topic: Column, kind: Column) -> Column:
    return filled(by_kind(kind, rules.PROCEDURE_LEADS), t=F.when(F.coalesce(topic, F.lit("")) != "", topic).otherwise(rules.NO_TOPIC))


def description(shape: Column, topic: Column, kind: Column, keywords: Column) -> Column:
    """What an asset does and when to use it."""
    template, none = (F.create_map(*[F.lit(x) for kv in v.items() for x in kv]) for v in (rules.DESCRIPTIONS, rules.NO_KEYWORDS))
    covers = F.when(F.size(F.filter(keywords, lambda k: k != "")) > 0, T.natural_join(keywords)).otherwise(none[shape])
    agent = F.transform(F.array(*map(F.lit, rules.AGENT_TRIGGERS)), lambda x: filled(x, t=topic))
    asks = T.natural_join_quoted(F.when(shape == "agent", agent).otherwise(trigger_phrases(topic, kind)))
    return filled(template[shape], lead=procedure_lead(topic, kind), asks=asks, input=input_phrase(kind), kind=kind, t=topic, kw=covers)


def knows(kind: Column, sections: Column) -> Column:
    """The lead-in of what an asset knows."""
    return F.concat(F.lit("Distilled from "), sections.cast("string"), F.lit(" sections of the source playbook. "), by_kind(kind, rules.KNOWS))


def source_block(kind: Column, name: Column, url: Column, title: Column, seconds: Column, words: Column, pages: Column, path: Column, seed: Column) -> Column:
    """The lines that name an asset's source: what it is and how long, by its kind."""
    counted = lambda n, unit: F.concat(F.when(F.coalesce(n, F.lit(0)) != 0, n.cast("string")).otherwise("?"), F.lit(unit))
    given = F.coalesce(F.when(url != "", url), F.lit("(unknown)"))
    called = F.coalesce(F.when(title != "", title), F.when(name != "", name), F.lit("?"))
    line = lambda label, *x: F.concat(F.lit(f"- **{label}:** "), *x)
    length = F.coalesce(F.concat(F.floor(seconds.cast("bigint") / 60).cast("string"), F.lit(" min")), F.lit("?"))
    file = F.coalesce(F.when(path != "", F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1)), called)
    source_url = line("Source URL", given)
    lines = (
        F.when(kind == "youtube_video", F.array(line("Video", called, F.lit(" ("), length, F.lit(")")), source_url)).when(kind == "web_page", F.array(line("Source page", given, F.lit(" ("), counted(words, " words"), F.lit(")"))))
        .when(kind == "pdf", F.array(line("Source PDF", file, F.lit(" ("), counted(pages, " pages"), F.lit(")")), source_url))
        .when(kind == "documentation_site", F.array(line("Source docs root", F.coalesce(F.when(seed != "", seed), given), F.lit(" ("), counted(pages, " pages"), F.lit(")")))).otherwise(F.array(line("Source", called), source_url))
    )
    return F.array_join(F.concat(F.array(F.concat(F.lit("- **Playbook:** `"), F.coalesce(F.when(name != "", name), F.lit("?")), F.lit("`"))), lines), "\n")


def export_path(target: Column, slug: Column, shape: Column) -> Column:
    """`error` for an unknown target."""
    md = F.when(shape == "skill", F.concat(slug, F.lit(".md"))).otherwise(F.concat(slug, F.lit("."), shape, F.lit(".md")))
    return (
        F.when(target == "codex", F.concat(F.lit(".agents/skills/"), slug, F.lit("/SKILL.md"))).when(target == "cursor", F.concat(F.lit(".cursor/rules/"), slug, F.lit(".mdc")))
        .when(target == "windsurf", F.concat(F.lit(".windsurf/rules/"), slug, F.lit(".md"))).when(target == "markdown", F.concat(F.lit("exports/markdown/"), md))
        .when(target == "claude_code", F.concat(F.lit(".claude/skills/"), slug, F.lit("/SKILL.md"))).otherwise("error")
    )


def yaml_string(x: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def export_text(target: Column, name: Column, slug: Column, about: Column, text: Column, shape: Column) -> Column:
    body = F.rtrim(T.split_frontmatter(text)["body"])
    body = F.regexp_replace(body, r"\s+\z", "")
    cursor = F.concat(F.lit("---\ndescription: "), yaml_string(about), F.lit('\nglobs:\n  - "**/*"\nalwaysApply: false\n---\n\n'), body, F.lit("\n"))
    wind = F.concat(F.lit("# "), name, F.lit("\n\nTarget: Windsurf rule\n\n"), about, F.lit("\n\n## Instructions\n\n"), body, F.lit("\n"))
    plain = F.concat(F.lit("# "), name, F.lit("\n\nExport target: portable Markdown\n\nSource asset shape: "), shape, F.lit("\nSkill slug: `"), slug, F.lit("`\n\n"), body, F.lit("\n"))
    return F.when(target == "cursor", cursor).when(target == "windsurf", wind).when(target == "markdown", plain).otherwise(F.concat(F.regexp_replace(text, r"\s+\z", ""), F.lit("\n")))


def resolve_target(x: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in rules.TARGET_ALIASES.items() for v in kv]), F.lower(F.trim(x))), F.lit("error"))


def append_once(text: Column, marker: str, block: Column) -> Column:
    return F.when(F.contains(text, F.lit(marker)), text).otherwise(F.concat(F.regexp_replace(text, r"\s+\z", ""), F.lit(f"\n\n{marker}\n\n"), block, F.lit("\n")))


def default_for(name: Column, about: Column) -> Column:
    """A sample value for a described input, as JSON."""
    low = F.lower(about)
    has = lambda s: F.contains(low, F.lit(s))
    text = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    first = F.regexp_replace(F.trim(F.substring_index(F.regexp_extract(about, r"(?i)literal\[(.+?)\]", 1), ",", 1)), "^['\"]+|['\"]+$", "")
    return (
        F.when(has("pathlib.path") | F.startswith(low, F.lit("path")) | has("filepath") | has("directory"), text(F.concat(F.lit("<SANDBOX>/"), name))).when(has("literal["), text(F.when(first != "", first).otherwise("default")))
        .when(has("bool"), "true").when(F.startswith(low, F.lit("int")) | F.contains(F.concat(F.lit(" "), low, F.lit(" ")), F.lit(" int ")), "1").when(has("float"), "1.0").when(has("list["), "[]")
        .when(has("dict[") | F.startswith(low, F.lit("dict")), "{}").otherwise(text(F.concat(F.lit("<sample-"), name, F.lit(">"))))
    )


def criteria_report(criteria: Column, out: Column) -> Column:
    """ARRAY<STRUCT<check, passed, evidence>>: from the fenced JSON, else numbered PASS or FAIL lines, else failed."""
    block = F.regexp_extract(out, r"(?s)```json\s*\n(\{.*?\})\s*\n```", 1)
    found = F.from_json(block, "criteria ARRAY<STRUCT<name: STRING, passed: BOOLEAN, evidence: STRING>>")["criteria"]
    lines = F.regexp_extract_all(out, F.lit(r"(?im)^\s*\d+\.\s*(?:PASS|FAIL)\b.*$"), F.lit(0))

    def one(check: Column, i: Column) -> Column:
        told = F.get(found, i)
        mine = F.get(F.filter(lines, lambda v: F.regexp_extract(v, r"^\s*(\d+)\.", 1).cast("int") == i + 1), F.lit(0))
        passed = F.when(told.isNotNull(), F.coalesce(told["passed"], F.lit(False))).otherwise(F.coalesce(F.regexp_like(mine, F.lit(r"(?i)^\s*\d+\.\s*PASS")), F.lit(False)))
        rest = F.nullif(F.trim(F.regexp_replace(mine, r"(?i)^\s*\d+\.\s*(?:PASS|FAIL)\b[:\-\s]*", "")), F.lit(""))
        evidence = F.when(told.isNotNull(), F.nullif(told["evidence"], F.lit(""))).when(mine.isNotNull(), rest).otherwise("not reported by executor")
        return F.struct(check.alias("check"), passed.alias("passed"), evidence.alias("evidence"))

    return F.transform(criteria, one)
