"""Queries of text and URL functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens import rules
from sourcelens.catalog import query
from sourcelens.functions import text as T
from sourcelens.functions import urls as U
from sourcelens.sources.tables import table

D, P = "documents", "pages"


def sql_words(x: str) -> str:
    return rf"list_filter(string_split_regex(coalesce({x}, ''), '\s+'), lambda w: w <> '')"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_first(x: str, n: int) -> str:
    return f"array_to_string({sql_words(x)}[1:{n}], ' ') || CASE WHEN len({sql_words(x)}) > {n} THEN '...' ELSE '' END"


def docs(spark: SparkSession, sf_dir: str, **cols) -> DataFrame:
    return table(spark, sf_dir, D).select("doc_id", *[c.alias(k) for k, c in cols.items()])


@query(r"SELECT doc_id, substr(coalesce(nullif(trim(regexp_replace(lower(trim(text)), '[^\p{L}\p{N}]+', '-', 'g'), '-'), ''), 'tutorial'), 1, 80) AS slug FROM documents")
def fn_slugify(spark, sf_dir):
    return docs(spark, sf_dir, slug=T.slugify(F.col("text")))


@query(f"SELECT doc_id, {sql_first('text', 60)} AS head FROM documents")
def fn_truncate_words(spark, sf_dir):
    return docs(spark, sf_dir, head=T.truncate_words(F.col("text"), 60))


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 199) || '…' END AS a, CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 197) || '...' END AS b FROM documents")
def fn_truncate_chars(spark, sf_dir):
    return docs(spark, sf_dir, a=T.truncate_chars(F.col("text"), 200), b=T.truncate_chars(F.col("text"), 200, "..."))


@query(f"SELECT doc_id, CASE WHEN length(s) <= 80 THEN s ELSE substr(s, 1, 79) || '…' END AS short FROM (SELECT doc_id, array_to_string({sql_words('text')}, ' ') AS s FROM documents)")
def fn_short_name(spark, sf_dir):
    return docs(spark, sf_dir, short=T.short_name(F.col("text")))


@query(f"SELECT doc_id, md5(array_to_string({sql_words('text')}, ' ')) AS h, CAST(len({sql_words('text')}) AS INT) AS n FROM documents")
def fn_normalize_space(spark, sf_dir):
    return docs(spark, sf_dir, h=F.md5(T.normalize_space(F.col("text"))), n=T.word_count(F.col("text")))


@query(rf"SELECT doc_id, CAST(len(t) AS INT) AS n, md5(array_to_string(t, ' ')) AS h FROM (SELECT doc_id, regexp_extract_all(lower(text), '{rules.TOKEN_PATTERN}') AS t FROM documents)")
def fn_tokens(spark, sf_dir):
    t = T.tokens(F.col("text"))
    return docs(spark, sf_dir, n=F.size(t), h=F.md5(F.array_join(t, " ")))


KEYWORDS = rf"list_filter(regexp_extract_all(regexp_replace(lower(text), '{rules.URL_PATTERN}', ' ', 'g'), '{rules.KEYWORD_PATTERN}'), lambda t: NOT list_contains({sql_list([*rules.STOPWORDS, *rules.URL_TOKENS])}, t))"


@query(f"SELECT doc_id, CAST(len(t) AS INT) AS n, md5(array_to_string(t, ' ')) AS h FROM (SELECT doc_id, {KEYWORDS} AS t FROM documents)")
def fn_kw_tokens(spark, sf_dir):
    return docs(spark, sf_dir, t=T.keyword_tokens(F.col("text"))).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("h"))


@query(rf"SELECT page_id, md5(regexp_replace(url || ' ' || html, '{rules.URL_PATTERN}', ' ', 'g')) AS h FROM pages")
def fn_strip_urls(spark, sf_dir):
    return table(spark, sf_dir, P).select("page_id", F.md5(T.strip_urls(F.concat_ws(" ", "url", "html"))).alias("h"))


@query(f"SELECT doc_id, array_to_string({sql_words('''string_split(text, '.')[1]''')}[1:25], ' ') AS s FROM documents")
def fn_first_sentence(spark, sf_dir):
    return docs(spark, sf_dir, s=T.first_sentence(F.col("text")))


HEADED = "source || ' — ' || lang || ' / ' || text"


@query(f"SELECT doc_id, CASE WHEN f LIKE '% — %' THEN trim(substr(f, instr(f, ' — ') + 3)) ELSE f END AS heading FROM (SELECT doc_id, trim(string_split({HEADED}, ' / ')[1]) AS f FROM documents)")
def fn_doc_heading(spark, sf_dir):
    return docs(spark, sf_dir, heading=T.doc_heading(F.concat(F.col("source"), F.lit(" — "), F.col("lang"), F.lit(" / "), F.col("text"))))


@query(r"SELECT doc_id, coalesce(nullif(regexp_extract(t, '^Page\s+(\d+)\b', 1), ''), CAST(doc_id AS VARCHAR)) AS page FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'Page ' || CAST(doc_id % 40 AS VARCHAR) || ' / ' || text END AS t FROM documents)")
def fn_pdf_page_no(spark, sf_dir):
    t = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("Page "), (F.col("doc_id") % 40).cast("string"), F.lit(" / "), F.col("text")))
    return docs(spark, sf_dir, page=T.pdf_page_no(t, F.col("doc_id")))


def sql_join(x: str, last: str) -> str:
    return f"CASE len({x}) WHEN 0 THEN '' WHEN 1 THEN {x}[1] WHEN 2 THEN array_to_string({x}, ' {last} ') ELSE array_to_string({x}[1:len({x}) - 1], ', ') || ', {last} ' || {x}[len({x})] END"


@query(f"SELECT doc_id, {sql_join('i', 'and')} AS plain, {sql_join('q', 'or')} AS quoted FROM (SELECT doc_id, i, list_transform(i, lambda v: '''' || v || '''') AS q FROM (SELECT doc_id, {sql_words('text')}[1:CAST(doc_id % 5 AS INT)] AS i FROM documents))")
def fn_natural_join(spark, sf_dir):
    i = F.slice(T.words(F.col("text")), F.lit(1), (F.col("doc_id") % 5).cast("int"))
    return docs(spark, sf_dir, plain=T.natural_join(i), quoted=T.natural_join_quoted(i))


PHRASES = f"list_transform(range(CAST(least(len({sql_words('text')}) // 12, 4) AS BIGINT)), lambda k: array_to_string({sql_words('text')}[CAST(k * 12 + 1 AS INT):CAST(k * 12 + 12 AS INT)], ' '))"


@query(f"SELECT doc_id, array_to_string({PHRASES}, '|') AS phrases FROM documents")
def fn_long_phrases(spark, sf_dir):
    return docs(spark, sf_dir, phrases=F.array_join(T.long_phrases(F.col("text")), "|"))


def sql_map(aliases: dict[str, str], x: str, default: str) -> str:
    key = f"replace(replace(lower(trim(coalesce(nullif({x}, ''), '{default}'))), '-', '_'), ' ', '_')"
    return f"coalesce(CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in aliases.items()) + f" END, '{default}')"


BASES = ["Owned", "licensed", "permission", "Creative-Commons", "public domain", "internal-sop", "fair use", "", "weird", "CC", "pd"]
INTENTS = ["private", "Team", "publish", "commercial", "", "other"]
PICK = f"{sql_list(BASES)}[CAST(doc_id % {len(BASES)} + 1 AS INT)]", f"{sql_list(INTENTS)}[CAST(doc_id % {len(INTENTS)} + 1 AS INT)]"


def pick(values, key="doc_id"):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


@query(f"SELECT doc_id, {sql_map(rules.BASIS_ALIASES, PICK[0], 'unknown')} AS basis, {sql_map(rules.INTENT_ALIASES, PICK[1], 'private')} AS intent FROM documents")
def fn_normalize_alias(spark, sf_dir):
    return docs(spark, sf_dir, basis=T.normalize_alias(pick(BASES), rules.BASIS_ALIASES, "unknown"), intent=T.normalize_alias(pick(INTENTS), rules.INTENT_ALIASES, "private"))


@query(f"SELECT doc_id, {sql_map(rules.BASIS_ALIASES, PICK[0], 'unknown')} AS basis FROM documents")
def join_alias_map(spark, sf_dir):
    """The alias table as a relation; it has a fixed size, so it may be broadcast."""
    aliases = spark.createDataFrame(list(rules.BASIS_ALIASES.items()), "alias string, basis string")
    key = F.translate(F.lower(F.trim(F.coalesce(F.when(pick(BASES) != "", pick(BASES)), F.lit("unknown")))), "- ", "__")
    return docs(spark, sf_dir, alias=key).join(F.broadcast(aliases), "alias", "left").select("doc_id", F.coalesce("basis", F.lit("unknown")).alias("basis"))


@query(rf"""SELECT doc_id, CASE WHEN a > 0 THEN '...' ELSE '' END || array_to_string({sql_words('substr(text, CAST(a + 1 AS INT), CAST(b - a AS INT))')}, ' ') || CASE WHEN b < length(text) THEN '...' ELSE '' END AS snippet
FROM (SELECT *, greatest(s - 96, 0) AS a, least(s + 20 + 96, length(text)) AS b FROM (SELECT doc_id, text, doc_id % 500 AS s FROM documents))""")
def fn_snippet(spark, sf_dir):
    s = (F.col("doc_id") % 500).cast("int")
    return docs(spark, sf_dir, snippet=T.snippet(F.col("text"), s, s + 20))


CLOCK = "CASE WHEN s // 3600 > 0 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END"


@query(f"SELECT event_id, {CLOCK} AS long, printf('%d:%02d', s // 60, s % 60) AS short FROM (SELECT event_id, CAST(floor(value * 37) AS BIGINT) AS s FROM events)")
def fn_mm_ss(spark, sf_dir):
    s = F.floor(F.col("value") * 37)
    return table(spark, sf_dir, "events").select("event_id", T.clock(s).alias("long"), T.clock(s, hours=False).alias("short"))


@query(f"SELECT event_id, {CLOCK} AS code FROM (SELECT event_id, greatest(CAST(floor(value * 37 - 300) AS BIGINT), 0) AS s FROM events)")
def fn_timecode(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.timecode(F.floor(F.col("value") * 37 - 300)).alias("code"))


STAMPS = "CASE event_id % 4 WHEN 0 THEN '01:02:' || CAST(event_id % 60 AS VARCHAR) || ',5' WHEN 1 THEN CAST(event_id % 60 AS VARCHAR) || ':07.25' WHEN 2 THEN CAST(event_id % 1000 AS VARCHAR) ELSE 'x:' || CAST(event_id AS VARCHAR) END"


@query(f"SELECT event_id, CASE len(p) WHEN 3 THEN p[1] * 3600 + p[2] * 60 + p[3] WHEN 2 THEN p[1] * 60 + p[2] WHEN 1 THEN p[1] END AS seconds FROM (SELECT event_id, list_transform(string_split(replace(trim({STAMPS}), ',', '.'), ':'), lambda v: TRY_CAST(v AS DOUBLE)) AS p FROM events)")
def fn_vtt_ts(spark, sf_dir):
    i = F.col("event_id")
    s = lambda m: (i % m).cast("string")
    x = F.when(i % 4 == 0, F.concat(F.lit("01:02:"), s(60), F.lit(",5"))).when(i % 4 == 1, F.concat(s(60), F.lit(":07.25"))).when(i % 4 == 2, s(1000)).otherwise(F.concat(F.lit("x:"), i.cast("string")))
    return table(spark, sf_dir, "events").select("event_id", T.vtt_seconds(x).alias("seconds"))


TITLE_SQL = "CASE doc_id % 6 WHEN 0 THEN '2024 ' || w || ' Bootcamp for FREE' WHEN 1 THEN w || ' in 100 Seconds' WHEN 2 THEN w || ' | FULL COURSE for Beginners' WHEN 3 THEN 'Learn ' || w || ' - Complete Guide [2023]' WHEN 4 THEN w || ' Roadmap' ELSE w || ' — MDN' END"
TITLED = f"(SELECT doc_id, {TITLE_SQL} AS title FROM (SELECT doc_id, array_to_string({sql_words('text')}[1:4], ' ') AS w FROM documents))"


def titles(spark, sf_dir) -> DataFrame:
    w, k = F.array_join(F.slice(T.words(F.col("text")), 1, 4), " "), F.col("doc_id") % 6
    t = (
        F.when(k == 0, F.concat(F.lit("2024 "), w, F.lit(" Bootcamp for FREE"))).when(k == 1, F.concat(w, F.lit(" in 100 Seconds"))).when(k == 2, F.concat(w, F.lit(" | FULL COURSE for Beginners")))
        .when(k == 3, F.concat(F.lit("Learn "), w, F.lit(" - Complete Guide [2023]"))).when(k == 4, F.concat(w, F.lit(" Roadmap"))).otherwise(F.concat(w, F.lit(" — MDN")))
    )
    return docs(spark, sf_dir, title=t)


def sql_strips(x: str) -> str:
    for p in rules.TITLE_STRIPS:
        x = f"regexp_replace({x}, '(?i){p}', ' ', 'g')"
    return f"array_to_string({sql_words(x)}, ' ')"


def sql_part(x: str) -> str:
    parts = "list_filter(list_transform(string_split(t, '{s}'), lambda p: trim(p)), lambda p: p <> '')"
    best = "list_sort(list_transform({p}, lambda p, i: struct_pack(a := CASE WHEN length(p) - length(replace(p, ',', '')) >= 3 THEN -1 ELSE 0 END, b := length(p), c := -i, p := p)), 'DESC')[1].p"
    return "CASE " + " ".join(f"WHEN contains(t, '{s}') THEN coalesce({best.format(p=parts.format(s=s))}, t)" for s in (" | ", " — ", " - ")) + " ELSE t END"


@query(f"SELECT doc_id, coalesce(nullif({sql_strips('u')}, ''), trim(title)) AS topic FROM (SELECT doc_id, title, {sql_part('t')} AS u FROM (SELECT doc_id, title, {sql_strips('trim(title)')} AS t FROM {TITLED}))")
def fn_topic_from_title(spark, sf_dir):
    return titles(spark, sf_dir).select("doc_id", T.topic_from_title(F.col("title")).alias("topic"))


@query(f"SELECT doc_id, {sql_part('t')} AS part FROM (SELECT doc_id, title AS t FROM {TITLED})")
def topk_title_part(spark, sf_dir):
    return titles(spark, sf_dir).select("doc_id", T.title_part(F.col("title")).alias("part"))


@query(f"SELECT page_id, coalesce(trim(replace(replace(list_filter(string_split(regexp_extract(regexp_replace(url, '(?i)^https?://', ''), '^[^/]*/(.*)$', 1), '/'), lambda s: s <> '' AND NOT list_contains({sql_list(rules.GENERIC_SEGMENTS)}, lower(s)))[1], '-', ' '), '_', ' ')), '') AS topic FROM pages")
def fn_topic_from_seed_url(spark, sf_dir):
    return table(spark, sf_dir, P).select("page_id", T.topic_from_seed_url(F.col("url")).alias("topic"))


@query(rf"SELECT t.doc_id, CASE WHEN regexp_matches(title, '(?i){rules.ROLE_TITLE}') AND n >= 10 THEN 'agent' ELSE 'skill' END AS shape FROM {TITLED} t JOIN (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents) d USING (doc_id)")
def prd_detect_shape(spark, sf_dir):
    n = docs(spark, sf_dir, n=F.size(F.split(F.col("text"), "\n")))
    role = F.regexp_like("title", F.lit(f"(?iu){rules.ROLE_TITLE}"))
    return titles(spark, sf_dir).join(n, "doc_id").select("doc_id", F.when(role & (F.col("n") >= 10), "agent").otherwise("skill").alias("shape"))


@query(r"SELECT doc_id, regexp_matches(t, '(?i)_\(Stub\.') OR regexp_matches(t, '(?m)^\s*(inputs|outputs|dependencies|owned_skills|rollback_strategy):\s*null\b') AS stub FROM (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' _(stub. fill)_' WHEN 1 THEN chr(10) || '  inputs: null' ELSE '' END AS t FROM documents)")
def prd_unfilled_stub(spark, sf_dir):
    k = F.col("doc_id") % 5
    return docs(spark, sf_dir, stub=T.unfilled_stub(F.concat(F.col("text"), F.when(k == 0, " _(stub. fill)_").when(k == 1, "\n  inputs: null").otherwise(""))))


PARTS = r"'^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$'"
ORIGIN = f"regexp_extract(url, {PARTS}, 1) || '://' || regexp_extract(url, {PARTS}, 2)"


@query(f"SELECT page_id, {ORIGIN} AS origin, regexp_extract(url, {PARTS}, 2) AS label FROM pages")
def fn_origin(spark, sf_dir):
    return table(spark, sf_dir, P).select("page_id", U.origin(F.col("url")).alias("origin"), U.origin_label(F.col("url")).alias("label"))


@query(f"SELECT page_id, {ORIGIN} || coalesce(nullif(regexp_replace(regexp_extract(url, {PARTS}, 3), '/+$', ''), ''), '/') || regexp_extract(url, {PARTS}, 4) AS url FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || '/#top' WHEN 1 THEN url || '?a=1#x' ELSE url END AS url FROM pages)")
def fn_normalize_url(spark, sf_dir):
    k = F.col("page_id") % 3
    u = F.concat("url", F.when(k == 0, "/#top").when(k == 1, "?a=1#x").otherwise(""))
    return table(spark, sf_dir, P).select("page_id", U.normalize_url(u).alias("url"))


#: References that a page gets besides its own, and what they lead to, d being the folder and u the folder above it.
REFERENCES = {"../x": "u || 'x'", "./y/": "d || 'y/'", "?q=1": f"{ORIGIN} || regexp_extract(url, {PARTS}, 3) || '?q=1'", "//h.example/p": f"regexp_extract(url, {PARTS}, 1) || '://h.example/p'", "z/../w?a=..": "d || 'w?a=..'", ".": "d", "#f": "regexp_replace(url, '#.*$', '') || '#f'"}
FOLDER = f"{ORIGIN} || coalesce(nullif(regexp_replace(regexp_extract(url, {PARTS}, 3), '[^/]*$', ''), ''), '/')"


@query(rf"""WITH own AS (SELECT page_id, url, unnest(list_concat(regexp_extract_all(html, 'href="([^"#]+)', 1), {sql_list(list(REFERENCES))})) AS href, {FOLDER} AS d FROM pages),
placed AS (SELECT *, regexp_replace(d, '([^/])/[^/]+/$', '\1/') AS up FROM own)
SELECT page_id, href, CASE {' '.join(f"WHEN href = '{k}' THEN {v}" for k, v in REFERENCES.items())} WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN {ORIGIN} || href ELSE d || href END AS link
FROM (SELECT * EXCLUDE up, CASE WHEN d = {ORIGIN} || '/' THEN d ELSE up END AS u FROM placed)""")
def fn_url_join(spark, sf_dir):
    hrefs = table(spark, sf_dir, P).select("page_id", "url", F.explode(F.concat(F.regexp_extract_all("html", F.lit('href="([^"#]+)'), F.lit(1)), F.array(*[F.lit(x) for x in REFERENCES]))).alias("href"))
    return hrefs.select("page_id", "href", U.url_join(F.col("url"), F.col("href")).alias("link"))


SOURCES = ["https://youtu.be/abc123", "https://www.youtube.com/watch?v=xyz9&t=3", "https://docs.stripe.com/webhooks/signatures", "https://example.com/tutorial", "https://example.com/docs/start", "https://example.com/manual.pdf", "C:\\media\\power-bi.mp4", "/data/manual.PDF", "not-a-url-or-known-file", "https://youtube.com/shorts/qq1"]


@query(None)
def prd_source_type(spark, sf_dir):
    """Sources of every kind, with names and file names; the router's cases are in the tests."""
    s = table(spark, sf_dir, P).select("page_id", F.col("url").alias("source"), F.lit("auto").alias("kind"), (F.col("page_id") % 4).alias("max_pages"))
    more = spark.range(len(SOURCES)).select((-F.col("id") - 1).alias("page_id"), pick(SOURCES, "id").alias("source"), F.lit("auto").alias("kind"), F.lit(1).alias("max_pages"))
    x = F.col("source")
    return s.union(more).select("page_id", "source", U.source_type(x, F.col("kind"), F.col("max_pages"), F.lit("")).alias("source_type"), U.infer_name(x).alias("name"), U.pdf_filename(x).alias("file"))


@query("SELECT page_id, x, starts_with(lower(x), 'http://') AND x <> 'http:///p' OR starts_with(lower(x), 'https://') AS web FROM (SELECT page_id, CASE page_id % 6 WHEN 1 THEN replace(url, 'https:', 'ftp:') WHEN 2 THEN upper(url) WHEN 3 THEN 'http:///p' WHEN 4 THEN replace(url, '://', '/') ELSE url END AS x FROM pages)")
def fn_is_http_url(spark, sf_dir):
    k, url = F.col("page_id") % 6, F.col("url")
    x = F.when(k == 1, F.replace(url, F.lit("https:"), F.lit("ftp:"))).when(k == 2, F.upper(url)).when(k == 3, "http:///p").when(k == 4, F.replace(url, F.lit("://"), F.lit("/"))).otherwise(url)
    return table(spark, sf_dir, P).select("page_id", x.alias("x"), U.is_http_url(x).alias("web"))


@query(f"SELECT page_id, coalesce(list_filter(string_split(lower(regexp_extract(url, {PARTS}, 2)), '.'), lambda p: p <> '' AND NOT list_contains({sql_list(rules.IGNORED_HOST_PARTS)}, p))[1], '') AS seed FROM pages")
def fn_host_seed(spark, sf_dir):
    return table(spark, sf_dir, P).select("page_id", U.host_seed(F.col("url")).alias("seed"))


@query(f"SELECT page_id, trim(regexp_replace(lower(trim(coalesce(list_filter(string_split(lower(regexp_extract(url, {PARTS}, 2)), '.'), lambda p: p <> '' AND NOT list_contains({sql_list(rules.IGNORED_HOST_PARTS)}, p))[1], '') || '-' || regexp_replace(regexp_extract(url_decode(regexp_extract(regexp_extract(url, {PARTS}, 3), '([^/]*)/*$', 1)), '[^/]*$'), '\\.[^.]*$', ''))), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-') AS name FROM (SELECT page_id, url || CASE page_id % 4 WHEN 1 THEN '/my%20file.v2.html' WHEN 2 THEN '/b%C3%A9+c%2Fd/' ELSE '' END AS url FROM pages)")
def fn_infer_name(spark, sf_dir):
    k = F.col("page_id") % 4
    url = F.concat("url", F.when(k == 1, "/my%20file.v2.html").when(k == 2, "/b%C3%A9+c%2Fd/").otherwise(""))
    return table(spark, sf_dir, P).select("page_id", U.infer_name(url).alias("name"))


@query(f"""WITH own AS (SELECT page_id, url || CASE page_id % 4 WHEN 1 THEN '/my%20file.PDF' WHEN 2 THEN '/report' ELSE '' END AS url FROM pages),
named AS (SELECT page_id, regexp_extract(url_decode(regexp_extract(url, {PARTS}, 3)), '([^/]*)/*$', 1) AS name FROM own)
SELECT page_id, CASE WHEN name = '' THEN 'source.pdf' WHEN ends_with(lower(name), '.pdf') THEN name ELSE name || '.pdf' END AS file FROM named""")
def fn_pdf_filename(spark, sf_dir):
    k = F.col("page_id") % 4
    url = F.concat("url", F.when(k == 1, "/my%20file.PDF").when(k == 2, "/report").otherwise(""))
    return table(spark, sf_dir, P).select("page_id", U.pdf_filename(url).alias("file"))


@query("SELECT doc_id, sha256(text) AS h FROM documents")
def fn_sha256_text(spark, sf_dir):
    return docs(spark, sf_dir, h=F.sha2(F.col("text"), 256))


JSON_SQL = """SELECT doc_id, sha256('{"doc_id": ' || doc_id || ', "meta": {"lang": ' || coalesce('"' || lang || '"', 'null') || ', "source": ' || coalesce('"' || source || '"', 'null')
  || '}, "n_chars": ' || coalesce(CAST(n_chars AS VARCHAR), 'null') || ', "parts": [' || coalesce('"' || sha256(text) || '"', 'null') || ', ' || coalesce('"' || lang || '"', 'null') || '], "share": '
  || coalesce(CAST(CAST(n_chars AS DOUBLE) / 8 AS VARCHAR), 'null') || '}') AS h FROM documents"""


@query(JSON_SQL)
def fn_json_canonical_hash(spark, sf_dir):
    """A hash of a nested object's canonical JSON."""
    from sourcelens.functions import canonical

    d = table(spark, sf_dir, "documents").select("doc_id", F.struct("source", "lang").alias("meta"), "n_chars", F.array(F.sha2("text", 256), F.col("lang")).alias("parts"), (F.col("n_chars") / F.lit(8.0)).alias("share"))
    return d.select("doc_id", F.sha2(canonical.of(d, *d.columns), 256).alias("h"))


@query("SELECT doc_id, md5(replace(text, 'the', 'tmp://x')) AS h FROM documents")
def fn_replace_strings(spark, sf_dir):
    return docs(spark, sf_dir, h=F.md5(F.replace(F.col("text"), F.lit("the"), F.lit("tmp://x"))))


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, ''), nullif(lang, ''), 'x') AS v FROM documents")
def fn_coalesce_chain(spark, sf_dir):
    return docs(spark, sf_dir, v=F.coalesce(T.filled(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")), F.col("lang")), F.lit("x")))
