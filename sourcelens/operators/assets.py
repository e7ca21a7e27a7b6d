"""Assets as text columns: scaffolds of playbooks and finished texts, from the layouts in `asset_texts`.

A playbook is a row: name, shape, kind, about, title, url, seconds, pages, path, seed, channel, summary, scope_notes,
owner_agent and sections, an array of `brief.SECTION`. A text is one expression over its row, so nothing is shuffled and
a playbook's text is as long as its own sections make it. Any field may be null: it counts as not given; a playbook
without sections has empty lists, one without a shape or of an unknown one is a skill.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sourcelens import asset_texts as A
from sourcelens.functions import text as T
from sourcelens.operators import brief
from sourcelens.operators import render as R

#: Words of a section's line, actions and their words in it, sections of a curriculum and of a table of steps.
LINE_WORDS, LINE_ACTIONS, LINE_SEEN, CURRICULUM, TABLE = 30, 2, 10, 16, 8


def _given(name: str) -> Column:
    return T.filled(F.col(name).cast("string"))


def _or(name: str, default: str) -> Column:
    return F.coalesce(_given(name), F.lit(default))


def worded(text: str, fields: dict[str, Column]) -> Column:
    """The text with its fields put in; what a field holds is not read again."""
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(*[fields[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def laid_out(layout: tuple, fields: dict[str, Column]) -> Column:
    """A layout's text: each block's lines and an empty line. A part is an array of lines; where it has none its empty line stays."""
    empty = F.array().cast("array<string>")

    def block(b) -> Column:
        if isinstance(b, A.Part):
            return F.concat(fields[b.name], F.array(F.lit("")))
        if isinstance(b, A.Given):
            return F.when(fields[b.name] != "", F.array(worded(b.text, fields), F.lit(""))).otherwise(empty)
        return F.array(worded(b, fields), F.lit(""))

    return F.array_join(F.concat(*map(block, layout)), "\n")


def label(kind: Column, s: Column) -> Column:
    """Where a section stands in its source: a video's time, a document's page, else its heading."""
    n = F.concat(F.lit("§"), F.coalesce(s["ordinal"].cast("string"), F.lit("?")))
    heading = T.doc_heading(s["text"])
    clock = F.concat(n, F.lit(" ("), T.clock(s["start_s"]), F.lit("–"), T.clock(s["end_s"]), F.lit(")"))
    page = F.concat(n, F.lit(" (page "), F.coalesce(T.pdf_page_no(s["text"], s["ordinal"]), F.lit("?")), F.lit(")"))
    return F.when(kind == "youtube_video", clock).when(kind == "pdf", page).when(heading != "", F.concat(n, F.lit(" — "), heading)).otherwise(n)


def section_lines(kind: Column, sections: Column, shown: bool) -> Column:
    """A line for every section, and with `shown` one for what was seen in it."""

    def line(s: Column) -> Column:
        said = F.regexp_like(F.coalesce(s["text"], F.lit("")), F.lit(r"\S"))
        main = F.concat(F.lit("- **"), label(kind, s), F.lit("** — "), F.when(said, T.truncate_words(s["text"], LINE_WORDS)).otherwise(A.NO_CAPTION))
        if not shown:
            return main
        visual = brief.seen(s["actions"], LINE_ACTIONS, LINE_SEEN)
        return F.concat(main, F.when(visual != "", F.concat(F.lit("\n  - Visual: "), visual)).otherwise(""))

    return F.transform(sections, line)


def step_rows(sections: Column) -> Column:
    """The rows of a workflow's table of steps."""
    row = lambda s, i: worded(A.STEP_ROW, {"i": (i + 1).cast("string"), "label": brief.reference(s)})
    return F.when(F.size(sections) > 0, F.array_join(F.transform(F.slice(sections, 1, TABLE), row), "\n")).otherwise(A.NO_STEP_ROW)


def _by_shape(layouts: dict[str, tuple], fields: dict[str, Column]) -> Column:
    shape = F.col("shape")
    return F.when(shape == "agent", laid_out(layouts["agent"], fields)).when(shape == "workflow", laid_out(layouts["workflow"], fields)).otherwise(laid_out(layouts["skill"], fields))


def _sections() -> Column:
    return F.coalesce("sections", F.array().cast(f"array<{brief.SECTION}>"))


def words_of(sections: Column) -> Column:
    """The number of words of all sections."""
    return F.aggregate(sections, F.lit(0).cast("bigint"), lambda n, s: n + F.regexp_count(F.coalesce(s["text"], F.lit("")), F.lit(r"\S+")))


FIELDS = ("name", "shape", "kind", "about", "title", "url", "seconds", "pages", "path", "seed", "channel", "summary", "scope_notes", "owner_agent")


def playbook(rows: DataFrame, sections: Column, **fields: Column) -> DataFrame:
    """The rows with a playbook's fields, null where not given; sections: an array of structs of any of a section's fields, matched by name."""
    kinds = {"seconds": "double", "pages": "int"}
    had = {f.name for f in rows.select(sections.alias("s")).schema["s"].dataType.elementType.fields}
    wanted = StructType.fromDDL(brief.SECTION.removeprefix("struct<").removesuffix(">")).fields
    whole = F.transform(sections, lambda s: F.struct(*[(s[f.name] if f.name in had else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]))
    return rows.withColumns({n: fields.get(n, F.lit(None)).cast(kinds.get(n, "string")) for n in FIELDS} | {"sections": whole})


def scaffolds(playbooks: DataFrame, to: str = "asset", product: str = "sourcelens", codifier: str = "codify command") -> DataFrame:
    """Playbooks with the text of their scaffold, whose contracts are stubs."""
    kind, sections = _or("kind", "youtube_video"), _sections()
    note = F.when(F.coalesce(F.col("scope_notes"), F.lit("")) != "", F.concat(F.lit("\n- **Author scope notes:** "), F.regexp_replace("scope_notes", r"\A\s+|\s+\z", ""))).otherwise("")
    source = R.source_block(kind, F.col("name"), F.col("url"), F.col("title"), F.col("seconds"), words_of(sections), F.col("pages"), F.col("path"), F.col("seed"))
    fields = {
        "name": F.coalesce("name", F.lit("")), "about": _or("about", ""), "owner": _or("owner_agent", "null"), "summary": _or("summary", ""), "n": F.size(sections).cast("string"),
        "source": F.array(source), "knows": R.knows(kind, F.size(sections)), "shown_sections": section_lines(kind, sections, True), "listed_sections": section_lines(kind, sections, False),
        "product": F.lit(product), "codifier": F.lit(codifier), "scope": note,
    }
    return playbooks.withColumn(to, _by_shape(A.SCAFFOLDS, fields))


def finished(playbooks: DataFrame, to: str = "asset", product: str = "sourcelens") -> DataFrame:
    """Playbooks with their finished text, and null where no section has a word: there is nothing to make a procedure of."""
    sections, name = _sections(), F.coalesce("name", F.lit(""))
    owner = F.coalesce(F.when(~F.col("owner_agent").isin("", "null"), F.col("owner_agent")), F.lit("unassigned"))
    about = F.coalesce(_given("about"), brief.plain_description(name, F.coalesce(_given("url"), _given("seed"))))
    fields = {
        "frontmatter": brief.frontmatter(name, about, F.coalesce("shape", F.lit("skill")), owner), "name": name, "owner": owner, "product": F.lit(product), "steps": step_rows(sections),
        "summary_lines": F.array(brief.source_summary(name, F.coalesce(_given("url"), _given("seed")), F.col("title"), F.col("channel"), F.col("summary"))),
        "knowledge": F.array(brief.knowledge(sections)), "curriculum": F.array(brief.knowledge(sections, CURRICULUM)), "procedure": F.array(brief.procedure(sections)),
    }
    has_words = F.exists(sections, lambda s: F.regexp_like(F.coalesce(s["text"], F.lit("")), F.lit(r"\S")))
    return playbooks.withColumn(to, F.when(has_words, _by_shape(A.FINISHED, fields)))


def _body(text: Column, heading: str) -> Column:
    """What stands below a heading of the second level, up to the next."""
    return F.regexp_extract(text, rf"(?dms)^##\s+{heading}\s*$(.*?)(?=^##\s+\S|\z)", 1)


def success_criteria(text: Column) -> Column:
    """The points below an asset's success criteria, in order; empty without them."""
    return F.regexp_extract_all(_body(text, "Success criteria"), F.lit(r"(?dm)^\s*-\s+(.*\S)\s*$"), F.lit(1))


def declared_inputs(text: Column) -> Column:
    """ARRAY<STRUCT<name, spec>> of the inputs that an asset declares."""
    line = r"(?dm)^\s*-\s+`([A-Za-z_]\w*)`\s*\(([^)]*)\)\s*:"
    found = (F.regexp_extract_all(_body(text, "Inputs"), F.lit(line), F.lit(k)) for k in (1, 2))
    return F.zip_with(*found, lambda name, spec: F.struct(name.alias("name"), F.trim(spec).alias("spec")))


def validated(rows: DataFrame, text: Column, report: Column, exit_code: Column) -> DataFrame:
    """Rows with their asset's inputs and criteria as an executor's report tells of them.

    Adds inputs, criteria (ARRAY<STRUCT<check, passed, evidence>>), passed, failed, ok and error. An asset without criteria is
    not ok and says so; a criterion that the report leaves out has failed; a null report tells of nothing, and without an
    exit code nothing is ok. `text`, `report` and `exit_code` are columns of the rows.
    """
    criteria = success_criteria(F.coalesce(text, F.lit("")))
    told = rows.withColumns({"inputs": declared_inputs(F.coalesce(text, F.lit(""))), "criteria": R.criteria_report(criteria, F.coalesce(report, F.lit("")))})
    passed = F.size(F.filter("criteria", lambda c: c["passed"]))
    n = F.size("criteria")
    return told.withColumns({
        "passed": passed, "failed": n - passed, "ok": (n > 0) & (n == passed) & F.coalesce(exit_code == 0, F.lit(False)),
        "error": F.when(n == 0, F.lit("skill has no ## Success criteria block; nothing to validate")),
    })
