"""Short renderers of captured sections: what is known, a procedure, the source's summary and the frontmatter, as text columns.

A section is a struct with ordinal, title, heading, page, start_s, end_s, text and actions, an array of structs with
actionType, visibleTextSample and observations. Each renderer is one expression over the array of sections, so a
playbook's text is made where its row is. The words of the lines are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourcelens.functions import canonical
from sourcelens.functions import text as T

#: Sections and words of what is known and of a procedure, actions and words of what was seen.
KNOWN, KNOWN_WORDS, STEPS, STEP_WORDS, ACTIONS, SEEN_WORDS = 12, 36, 6, 24, 3, 12
NO_TEXT = "No lesson text was captured for this section."
SECTION = "struct<ordinal: int, title: string, heading: string, page: int, start_s: double, end_s: double, text: string, actions: array<struct<actionType: string, visibleTextSample: string, observations: array<string>>>>"


def _filled(x: Column) -> Column:
    return F.when(x != "", x)


def _join(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def reference(s: Column) -> Column:
    """What names a section: its title, heading, page, time or number."""
    spans = (s["end_s"].isNotNull()) & (s["end_s"] != s["start_s"])
    timed = F.when(s["start_s"].isNotNull(), F.when(spans, _join(T.timecode(s["start_s"]), "-", T.timecode(s["end_s"]))).otherwise(T.timecode(s["start_s"])))
    page = F.when(s["page"] != 0, _join("Page ", s["page"].cast("string")))
    number = F.coalesce(F.when(s["ordinal"] != 0, s["ordinal"].cast("string")), F.lit("?"))
    return F.coalesce(_filled(s["title"]), _filled(s["heading"]), page, timed, _join("Section ", number))


def lesson(s: Column, words: int) -> Column:
    said = F.regexp_like(F.coalesce(s["text"], F.lit("")), F.lit(r"\S"))
    return F.when(said, T.truncate_words(s["text"], words)).otherwise(NO_TEXT)


def seen(actions: Column, limit: int = ACTIONS, words: int = SEEN_WORDS, whole: bool = False) -> Column:
    """The first actions with what they show, and how many more there are; empty without any. With `whole` observations stay as they are.

    A null action counts, but has nothing said of it.
    """

    def one(a: Column) -> Column:
        label = F.replace(F.coalesce(_filled(a["actionType"]), F.lit("unknown")), F.lit("_"), F.lit(" "))
        sample, observed = _filled(a["visibleTextSample"]), F.array_join(F.coalesce(a["observations"], F.array().cast("array<string>")), "; ")
        detail = F.coalesce(sample, observed)
        said = F.when(sample.isNull(), observed).otherwise(T.truncate_words(sample, words)) if whole else T.truncate_words(detail, words)
        return F.when(a.isNotNull(), F.when(detail != "", _join(label, ": ", said)).otherwise(label))

    n = F.coalesce(F.size(actions), F.lit(0))
    more = F.when(n > limit, F.array(_join("+", (n - limit).cast("string"), " more"))).otherwise(F.array().cast("array<string>"))
    return F.when(n <= 0, "").otherwise(F.array_join(F.concat(F.transform(F.slice(actions, 1, limit), one), more), "; "))


def _lines(sections: Column, limit: int, line, rest) -> Column:
    n = F.size(sections)
    more = F.when(n > limit, F.array(rest((n - limit).cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.transform(F.slice(sections, 1, limit), line), more), "\n")


def knowledge(sections: Column, limit: int = KNOWN) -> Column:
    def line(s: Column) -> Column:
        shown = seen(s["actions"])
        return _join("- **", reference(s), ":** ", lesson(s, KNOWN_WORDS), F.when(shown != "", _join(" Visual: ", shown)).otherwise(""))

    return _lines(sections, limit, line, lambda n: _join("- Plus ", n, " additional source-backed sections in `lessons.md`."))


def procedure(sections: Column, limit: int = STEPS) -> Column:
    def line(s: Column, i: Column) -> Column:
        shown = seen(s["actions"])
        clause = F.when(shown != "", _join(" Use the visual-action evidence (", shown, ") to preserve what happened on screen.")).otherwise("")
        return _join((i + 1).cast("string"), ". Use **", reference(s), "** to handle this part: ", lesson(s, STEP_WORDS), clause)

    return _lines(sections, limit, line, lambda n: _join(f"{limit + 1}. Check the remaining ", n, " source sections in `lessons.md` before claiming full coverage."))


def source_summary(name: Column, url: Column, title: Column, channel: Column, summary: Column) -> Column:
    """A line for each thing that is known of a playbook's source."""
    line = lambda label, x: F.when(x != "", _join(f"- **{label}:** ", x))
    known = F.array(_join("- **Playbook:** `", name, "`"), line("Source", url), line("Title", title), line("Channel", channel), line("Summary", summary))
    return F.array_join(F.array_compact(known), "\n")


def plain_description(name: Column, url: Column) -> Column:
    return _join("Apply source-backed lessons from ", F.coalesce(_filled(url), F.lit("captured source")), " for ", name, ".")


def frontmatter(name: Column, about: Column, shape: Column, owner: Column) -> Column:
    """Name and description, a workflow's owner too; the description is a quoted string."""
    given = F.coalesce(F.when(~owner.isin("", "null"), owner), F.lit("unassigned"))
    lines = F.array(F.lit("---"), _join("name: ", name), _join("description: ", canonical.text(about)), F.when(shape == "workflow", _join("owner_agent: ", given)), F.lit("---"))
    return F.array_join(F.array_compact(lines), "\n")
