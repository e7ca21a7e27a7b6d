"""Text functions as Column expressions: all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourcelens import rules


def filled(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in cols])


def words(x: Column) -> Column:
    return F.filter(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda w: w != "")


def normalize_space(x: Column) -> Column:
    return F.array_join(words(x), " ")


def word_count(x: Column) -> Column:
    return F.size(words(x))


def truncate_words(x: Column, n: int) -> Column:
    """The first n words, with dots where there are more; what follows them is not looked at. As in the SQL a vertical tab is no space."""
    text, space, word = F.coalesce(x, F.lit("")), r"[\t\n\f\r ]", r"[^\t\n\f\r ]"
    first = F.regexp_extract(text, rf"^{space}*+((?:{word}++{space}++){{0,{n - 1}}}{word}++)", 1)
    more = F.regexp_like(text, F.lit(rf"^{space}*+(?:{word}++{space}++){{{n}}}{word}"))
    return F.concat(F.regexp_replace(first, rf"{space}+", " "), F.when(more, "...").otherwise(""))


def truncate_chars(x: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.substring(x, 1, n - len(mark)), F.lit(mark)))


def short_name(x: Column) -> Column:
    return truncate_chars(normalize_space(x), 80)


def slugify(x: Column, default: str = "tutorial", most: int = 80) -> Column:
    s = F.btrim(F.regexp_replace(F.lower(F.trim(x)), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))
    return F.substring(F.coalesce(F.when(s != "", s), F.lit(default)), 1, most)


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(rules.TOKEN_PATTERN), F.lit(0))


def strip_urls(x: Column) -> Column:
    return F.regexp_replace(x, rules.URL_PATTERN, " ")


def keyword_tokens(x: Column) -> Column:
    found = F.regexp_extract_all(strip_urls(F.lower(x)), F.lit(rules.KEYWORD_PATTERN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*rules.STOPWORDS, *rules.URL_TOKENS))  # a hash set after optimisation


def first_sentence(x: Column, n: int = 25) -> Column:
    return F.array_join(F.slice(words(F.substring_index(x, ".", 1)), 1, n), " ")


def doc_heading(x: Column) -> Column:
    first = F.trim(F.substring_index(F.coalesce(x, F.lit("")), " / ", 1))
    at = F.instr(first, " — ")
    return F.when(at > 0, F.trim(first.substr(at + 3, F.length(first)))).otherwise(first)


def pdf_page_no(x: Column, ordinal: Column) -> Column:
    n = F.regexp_extract(x, r"^Page\s+(\d+)\b", 1)
    return F.when(n != "", n).otherwise(ordinal.cast("string"))


def natural_join(items: Column, last: str = "and") -> Column:
    x = F.filter(items, lambda i: i.isNotNull() & (i != ""))
    n = F.size(x)
    return (
        F.when(n == 0, "").when(n == 1, F.get(x, F.lit(0))).when(n == 2, F.array_join(x, f" {last} "))
        .otherwise(F.concat(F.array_join(F.slice(x, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(f", {last} "), F.get(x, n - 1)))
    )


def natural_join_quoted(items: Column) -> Column:
    return natural_join(F.transform(F.filter(items, lambda i: i.isNotNull() & (i != "")), lambda i: F.concat(F.lit("'"), i, F.lit("'"))), "or")


def long_phrases(x: Column, n: int = 12, most: int = 4) -> Column:
    """Up to most runs of n words, one after the other."""
    w = words(x)
    count = F.least(F.floor(F.size(w) / n), F.lit(most))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), (F.greatest(count, F.lit(1)) - 1).cast("int")), lambda k: F.array_join(F.slice(w, k * n + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def normalize_alias(x: Column, aliases: dict[str, str], default: str) -> Column:
    key = F.translate(F.lower(F.trim(F.coalesce(F.when(x != "", x), F.lit(default)))), "- ", "__")
    table = F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def snippet(x: Column, start: Column, end: Column, radius: int = rules.SNIPPET_RADIUS) -> Column:
    """Text around the characters from start (0-based) to end, with marks where it is cut."""
    a, b = F.greatest(start - radius, F.lit(0)), F.least(end + radius, F.length(x))
    return F.concat(F.when(a > 0, "...").otherwise(""), normalize_space(x.substr(a + 1, b - a)), F.when(b < F.length(x), "...").otherwise(""))


def clock(seconds: Column, missing: str | None = "?:??", hours: bool = True) -> Column:
    """H:MM:SS or M:SS."""
    s = seconds.cast("bigint")
    h = F.floor(s / 3600) if hours else F.lit(0)
    minutes = F.floor(s % 3600 / 60) if hours else F.floor(s / 60)
    short = F.format_string("%d:%02d", minutes, s % 60)
    return F.when(s.isNull(), F.lit(missing)).when(h > 0, F.format_string("%d:%02d:%02d", h, minutes, s % 60)).otherwise(short)


def timecode(seconds: Column) -> Column:
    return clock(F.greatest(seconds, F.lit(0)), None)


def vtt_seconds(x: Column) -> Column:
    """Seconds of H:M:S.f, M:S.f or S; a comma counts as a point; null if malformed."""
    parts = F.split(F.replace(F.trim(x), F.lit(","), F.lit(".")), ":")
    n = F.size(parts)
    num = F.transform(parts, lambda p: p.try_cast("double"))
    total = F.aggregate(num, F.lit(0.0).cast("double"), lambda a, v: a * 60 + v)
    return F.when(n <= 3, total)


def split_fragments(x: Column) -> Column:
    """Caption lines without karaoke marks, trimmed, blank ones dropped."""
    bare = F.regexp_replace(F.regexp_replace(x, r"<\d{1,2}:\d{2}:\d{2}\.\d{1,3}>", ""), r"</?c[^>]*>", "")
    return F.filter(F.transform(F.split(bare, "\n"), lambda v: F.trim(v)), lambda p: p != "")


def html_title(html: Column) -> Column:
    """The first title element's text on one line. Only the five named references that end with a semicolon are resolved, once."""
    text = F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"[\t\n\f\r ]+", " ")
    text = F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+$", "")
    named = {"&quot;": '"', "&#x27;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}  # & at last, so that what it makes is no reference
    return reduce(lambda t, n: F.replace(t, F.lit(n), F.lit(named[n])), named, text)


def topic_from_seed_url(x: Column) -> Column:
    path = F.regexp_extract(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?i)^https?://", ""), r"^[^/]*/(.*)$", 1)
    no = F.array(*[F.lit(w) for w in rules.GENERIC_SEGMENTS])
    kept = F.filter(F.split(path, "/"), lambda s: (s != "") & ~F.array_contains(no, F.lower(s)))
    return F.coalesce(F.trim(F.translate(F.get(kept, F.lit(0)), "-_", "  ")), F.lit(""))


def strip_title(x: Column) -> Column:
    return normalize_space(reduce(lambda t, p: F.regexp_replace(t, f"(?iu){p}", " "), rules.TITLE_STRIPS, x))


def title_part(x: Column) -> Column:
    """Of the parts at the first separator that occurs, the longest; those with three commas come last."""
    def best(sep: str) -> Column:
        parts = F.filter(F.transform(F.split(x, sep.replace("|", r"\|")), lambda v: F.trim(v)), lambda p: p != "")
        scored = F.transform(parts, lambda p, i: F.struct(F.when(F.length(p) - F.length(F.replace(p, F.lit(","), F.lit(""))) >= 3, -1).otherwise(0).alias("a"), F.length(p).alias("b"), (-i).alias("c"), p.alias("p")))
        return F.coalesce(F.array_max(scored)["p"], x)

    return F.when(F.contains(x, F.lit(" | ")), best(" | ")).when(F.contains(x, F.lit(" — ")), best(" — ")).when(F.contains(x, F.lit(" - ")), best(" - ")).otherwise(x)


def topic_from_title(x: Column) -> Column:
    t = strip_title(title_part(strip_title(F.trim(F.coalesce(x, F.lit(""))))))
    return F.when(t != "", t).otherwise(F.trim(F.coalesce(x, F.lit(""))))


def split_frontmatter(x: Column) -> Column:
    """(meta MAP, body) of a document with a block of key: value lines between --- lines."""
    raw = F.regexp_extract(x, r"(?s)\A---\s*\n(.*?)\n---\s*\n", 1)
    found = F.regexp_like(x, F.lit(r"(?s)\A---\s*\n(.*?)\n---\s*\n"))
    lines = F.filter(F.split(raw, "\n"), lambda v: (v != "") & ~F.regexp_like(v, F.lit(r"^[ \t#]")) & F.contains(v, F.lit(":")))
    keys = F.transform(lines, lambda v: F.trim(F.substring_index(v, ":", 1)))
    values = F.transform(lines, lambda v: F.regexp_replace(F.trim(v.substr(F.instr(v, ":") + 1, F.length(v))), "^[\"']+|[\"']+$", ""))
    body = F.concat(F.regexp_replace(F.when(found, F.regexp_replace(x, r"(?s)\A---\s*\n.*?\n---\s*\n", "")).otherwise(x), r"\A\s+|\s+\z", ""), F.lit("\n"))
    return F.struct(F.when(found, F.map_from_arrays(keys, values)).otherwise(F.create_map().cast("map<string,string>")).alias("meta"), body.alias("body"))


def unfilled_stub(x: Column) -> Column:
    return F.regexp_like(x, F.lit(r"(?i)_\(Stub\.")) | F.regexp_like(x, F.lit(r"(?m)^\s*(inputs|outputs|dependencies|owned_skills|rollback_strategy):\s*null\b"))


def markdown_section(x: Column, name: str) -> Column:
    """What stands between an H2 and the next."""
    return F.regexp_extract(x, rf"(?ims)^##\s+{name}[^\n]*\n(.*?)(?=^##\s|\z)", 1)


def bullets(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit(r"(?m)^\s*(?:[-*]|\d+\.)\s+(.+)$"), F.lit(1)), lambda v: F.trim(v))
