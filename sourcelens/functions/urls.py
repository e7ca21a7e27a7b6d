"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourcelens import rules
from sourcelens.functions.text import slugify

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def part(x: Column, k: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query with its mark; empty if there is none."""
    return F.regexp_extract(x, _PARTS, k)


def origin(x: Column) -> Column:
    return F.concat(part(x, 1), F.lit("://"), part(x, 2))


def origin_label(x: Column) -> Column:
    return part(x, 2)


def normalize_url(x: Column) -> Column:
    """Without fragment and parameters, the path without a trailing slash, the query kept."""
    path = F.rtrim(F.regexp_replace(part(x, 3), r";[^/]*$", ""))
    bare = F.regexp_replace(path, "/+$", "")
    return F.concat(origin(x), F.when(bare == "", "/").otherwise(bare), part(x, 4))


def without_dots(path: Column) -> Column:
    """An absolute path without `.` and `..` parts; what leads above the root stays at it."""
    parts = F.split(path, "/")
    start = F.array(F.lit(""))

    def step(kept: Column, x: Column) -> Column:
        up = F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
        return F.when(x == "..", up).when(x == ".", kept).otherwise(F.array_append(kept, x))

    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), start, step)
    open_end = F.element_at(parts, -1).isin(".", "..")
    return F.array_join(F.when(open_end | (F.size(kept) == 1), F.array_append(kept, F.lit(""))).otherwise(kept), "/")


def url_join(base: Column, href: Column) -> Column:
    """RFC 3986: the base's parts as far as the reference has none, dot segments resolved; an empty one is the base."""
    path, query, mark = (F.regexp_extract(href, r"^([^?#]*)(\?[^#]*)?(#.*)?$", k) for k in (1, 2, 3))
    beside = F.regexp_replace(part(base, 3), "[^/]*$", "")
    beside = F.when(beside == "", "/").otherwise(beside)
    own_path = without_dots(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(beside, path)))
    other_host = F.concat(part(base, 1), F.lit(":"), href)
    return (
        F.when(href == "", base).when(F.regexp_like(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), href).when(F.startswith(href, F.lit("//")), other_host)
        .when(path != "", F.concat(origin(base), own_path, query, mark)).when(query != "", F.concat(origin(base), part(base, 3), query, mark))
        .otherwise(F.concat(origin(base), part(base, 3), part(base, 4), mark))
    )


def unquoted(x: Column) -> Column:
    """Percent-decoded; plus signs and broken escapes stay."""
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def is_http_url(x: Column) -> Column:
    return F.lower(part(x, 1)).isin("http", "https") & (part(x, 2) != "")


def is_youtube(x: Column) -> Column:
    host = F.lower(part(x, 2))
    return F.regexp_like(host, F.lit(r"youtube\.com|youtu\.be|youtube-nocookie\.com"))


def youtube_id(x: Column) -> Column:
    v = F.regexp_extract(part(x, 4), r"[?&]v=([^&]+)", 1)
    short = F.regexp_extract(part(x, 3), r"^/+([^/]+)", 1)
    marked = F.regexp_extract(part(x, 3), r"/(?:embed|shorts|live)/([^/]+)", 1)
    found = F.when(v != "", v).when(F.endswith(F.lower(part(x, 2)), F.lit("youtu.be")) & (short != ""), short).otherwise(marked)
    return F.when(found != "", found)


def host_seed(x: Column) -> Column:
    host = F.regexp_extract(F.lower(part(x, 2)), "^[^:]*", 0)
    no = F.array(*[F.lit(w) for w in rules.IGNORED_HOST_PARTS])
    return F.coalesce(F.get(F.filter(F.split(host, r"\."), lambda p: (p != "") & ~F.array_contains(no, p)), F.lit(0)), host)


def stem(path: Column) -> Column:
    """The last path part without its last suffix; both kinds of slashes part."""
    name = F.regexp_extract(F.regexp_replace(path, r"[/\\]+$", ""), r"[^/\\]*$", 0)
    bare = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.when(bare != "", bare).otherwise(name)


def infer_name(x: Column, fallback: str = "source") -> Column:
    """A deterministic name for a source."""
    last = stem(unquoted(F.regexp_extract(part(x, 3), r"([^/]*)/*$", 1)))
    web = F.when(last != "", F.concat_ws("-", host_seed(x), last)).otherwise(host_seed(x))
    video = F.coalesce(F.concat(F.lit("youtube-"), youtube_id(x)), host_seed(x))
    return slugify(F.when(is_http_url(x) & is_youtube(x), video).when(is_http_url(x), web).otherwise(stem(x)), fallback)


def source_type(x: Column, kind: Column, max_pages: Column, pattern: Column) -> Column:
    """The router; `error` where neither an alias nor the source decides."""
    asked = F.translate(F.lower(F.trim(F.coalesce(kind, F.lit("auto")))), "-", "_")
    table = F.create_map(*[F.lit(v) for kv in rules.SOURCE_TYPE_ALIASES.items() for v in kv])
    path = F.lower(F.when(is_http_url(x), part(x, 3)).otherwise(x))
    pdf = F.endswith(path, F.lit(".pdf"))
    web = F.when(is_youtube(x), "youtube_video").when(pdf, "pdf").when((F.coalesce(max_pages, F.lit(0)) > 1) | (F.coalesce(pattern, F.lit("")) != ""), "documentation_site").otherwise("web_page")
    local = F.when(pdf, "pdf").when(F.regexp_like(path, F.lit(r"\.(mp4|m4v|mov|avi|mkv|webm|wmv)$")), "local_video").otherwise("error")
    return F.when(asked != "auto", F.coalesce(F.try_element_at(table, asked), F.lit("error"))).when(is_http_url(x), web).otherwise(local)


def pdf_filename(x: Column) -> Column:
    """The decoded last part of the path; `source.pdf` where there is none."""
    name = F.regexp_extract(unquoted(part(x, 3)), r"([^/]*)/*$", 1)
    return F.when(name == "", "source.pdf").when(F.regexp_like(name, F.lit(r"(?i).\.pdf$")), name).otherwise(F.concat(name, F.lit(".pdf")))
