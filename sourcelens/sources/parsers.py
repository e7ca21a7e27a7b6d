"""Parsers that need the standard library: captions, HTML, byte streams. All run batch-wise on the executors."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, BinaryType, StringType, StructField, StructType

from sourcelens.functions.pieces import by_row, pieces

CUES = ArrayType(StructType([StructField("start", DoubleType()), StructField("end", DoubleType()), StructField("text", StringType())]))


def seconds(stamp: str) -> float | None:
    parts = stamp.strip().replace(",", ".").split(":")
    try:
        numbers = [float(p) for p in parts]
    except ValueError:
        return None
    return sum(n * 60 ** (len(numbers) - 1 - k) for k, n in enumerate(numbers)) if len(numbers) <= 3 else None


def _json_cues(body: str) -> list[dict]:
    try:
        events = json.loads(body).get("events")
    except ValueError:
        return [{"start": None, "end": None, "text": body}]
    out = []
    for e in events if isinstance(events, list) else []:
        if not isinstance(e, dict):
            continue
        text = "".join(str(s.get("utf8", "")) for s in e.get("segs") or [] if isinstance(s, dict)).strip()
        start, length = (x / 1000 if isinstance(x := e.get(k), (int, float)) else None for k in ("tStartMs", "dDurationMs"))
        if text:
            out.append({"start": start, "end": None if start is None or length is None else start + length, "text": text})
    return out


def cues_of(body: str) -> list[dict]:
    """Cues of a WebVTT, SRT or json3 body. Digit lines and NOTE, STYLE and WEBVTT lines are no text, wherever they stand."""
    body = (body or "").strip()
    if body.startswith("{"):
        return _json_cues(body)
    out: list[dict] = []
    start = end = None
    lines: list[str] = []
    header = True
    for line in [*map(str.strip, body.splitlines()), ""]:
        if not line:
            if text := " ".join(lines).strip():
                out.append({"start": start, "end": end, "text": text})
            start, end, lines, header = None, None, [], False
        elif line.startswith(("WEBVTT", "NOTE", "STYLE")) or line.isdigit():
            continue
        elif "-->" in line:
            left, _, right = line.partition("-->")
            start, end, header = seconds(left), seconds(right.strip().split(" ", 1)[0]), False
        elif not (header and ":" in line):
            lines.append(line)
    return out


@by_row(CUES)
def parse_cues(body: str | None) -> list[dict]:
    return [] if body is None else cues_of(body)


# Tags that are noise, and those that end an open paragraph.
DROP = frozenset("script style nav footer header aside form iframe noscript button input select textarea svg".split())
BLOCKS = frozenset("p div section article main ul ol li table tr td th blockquote pre h1 h2 h3 h4 h5 h6 hr body html form nav header footer aside".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Element:
    __slots__ = ("attrs", "items", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent):
        self.tag, self.attrs, self.parent, self.items = tag, attrs, parent, []

    def find(self, *tags: str):
        """Elements with one of the tags, in document order, this one included."""
        todo = [self]
        while todo:
            e = todo.pop()
            if e.tag in tags:
                yield e
            todo.extend(x for x in reversed(e.items) if isinstance(x, Element))

    def texts(self):
        todo: list = [self]
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                yield e
            else:
                todo.extend(reversed(e.items))


class Tree(HTMLParser):
    """A forgiving tree: paragraphs end where a block begins, list items where the next one does."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)
        self.made: list[Element] = []
        self.feed(html)
        self.close()

    def _add(self, tag, attrs) -> Element:
        e = Element(tag, dict(attrs), self.at)
        self.at.items.append(e)
        self.made.append(e)
        return e

    def forget(self) -> None:
        """Cuts the ties to parents, which make circles, so that the tree is gone when nothing refers to it."""
        for e in self.made:
            e.parent = None

    def _end(self, tags, stop=()):
        e = self.at
        while e.parent is not None and e.tag not in stop:
            if e.tag in tags:
                self.at = e.parent
                return
            e = e.parent

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._end(("p",), ("div", "section", "article", "main", "li", "td", "blockquote", "body"))
        if tag == "li":
            self._end(("li",), ("ul", "ol"))
        e = self._add(tag, attrs)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs)

    def handle_endtag(self, tag):
        self._end((tag,))

    def handle_data(self, data):
        self.at.items.append(data)


def inline(e: Element) -> str:
    return " ".join(" ".join(e.texts()).split())


def strip_noise(e: Element) -> None:
    e.items = [x for x in e.items if not (isinstance(x, Element) and x.tag in DROP)]
    for x in e.items:
        if isinstance(x, Element):
            strip_noise(x)


def density(e: Element) -> int:
    return sum(len(" ".join(p.texts()).strip()) for p in e.find("p"))


def main_content(root: Element) -> Element:
    """main, article, a main role or id, else the division with most paragraph text, the first of equals."""
    for wanted in ("main", "article"):
        if found := next(root.find(wanted), None):
            return found
    todo, by_attr = [root], {}
    while todo:
        e = todo.pop(0)
        for key, value in (("role", "main"), ("id", "content"), ("id", "main")):
            if e.attrs.get(key) == value:
                by_attr.setdefault((key, value), e)
        todo.extend(x for x in e.items if isinstance(x, Element))
    for key in (("role", "main"), ("id", "content"), ("id", "main")):
        if key in by_attr:
            return by_attr[key]
    best = next(root.find("body"), root)
    score = density(best)
    for e in best.find("div", "section"):
        if (d := density(e)) > score:
            best, score = e, d
    return best


def markdown(root: Element) -> str:
    out: list[str] = []

    def alone(text: str):
        out.extend(["", text, ""])

    def walk(e: Element):
        tag = e.tag
        if tag in DROP:
            return
        text = inline(e) if re.fullmatch(r"h[1-6]|code|li|p|blockquote", tag) else ""
        if re.fullmatch("h[1-6]", tag):
            if text:
                alone("#" * int(tag[1]) + " " + text)
        elif tag == "pre":
            if raw := "".join(e.texts()).rstrip():
                out.extend(["", "```", raw, "```", ""])
        elif tag == "code" and not (e.parent and e.parent.tag == "pre"):
            if text:
                out.append(f"`{text}`")
        elif tag == "li":
            if text:
                out.append(f"- {text}")
        elif tag in ("p", "blockquote"):
            if text:
                alone(("> " if tag == "blockquote" else "") + text)
        else:
            for x in e.items:
                if isinstance(x, Element):
                    walk(x)
                elif bare := " ".join(x.split()):
                    out.append(bare)

    walk(root)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def split_sections(text: str) -> list[tuple[str, str]]:
    """(heading, body); any line that starts with # opens a section, inside code too."""
    out: list[list] = [["", []]]
    for line in text.splitlines():
        if line.startswith("#"):
            out.append([line.lstrip("# ").strip(), []])
        else:
            out[-1][1].append(line)
    done = [(h, "\n".join(b).strip()) for h, b in out]
    return [s for s in done if s[0] or s[1]]


def page_title(root: Element) -> str:
    for tag in ("title", "h1"):
        if (e := next(root.find(tag), None)) and (text := inline(e)):
            return text
    return ""


def page_links(root: Element, base: str) -> list[str]:
    found: dict[str, None] = {}
    for a in root.find("a"):
        if href := (a.attrs.get("href") or "").strip():
            link = urldefrag(urljoin(base, href))[0]
            if link.startswith(("http://", "https://")):
                found[link] = None
    return list(found)


PAGE = StructType([StructField("title", StringType()), StructField("markdown", StringType()), StructField("links", ArrayType(StringType())), StructField("sections", ArrayType(StructType([StructField("heading", StringType()), StructField("body", StringType())])))])


def page_row(url: str | None, html: str | None) -> dict:
    tree = Tree(html or "")
    root = tree.root
    title, links = page_title(root), page_links(root, url or "")
    strip_noise(root)
    text = markdown(main_content(root))
    tree.forget()
    return {"title": title, "markdown": text, "links": links, "sections": [{"heading": a, "body": b} for a, b in split_sections(text)]}


@arrow_udf(PAGE)
def parse_page(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Title, main content as markdown, links of the whole page and sections, given back page by page in pieces."""
    for url, html in batches:
        for lo, hi in pieces(html):
            rows = zip(url.slice(lo, hi - lo).to_pylist(), html.slice(lo, hi - lo).to_pylist())
            yield pa.array([page_row(u, h) for u, h in rows], to_arrow_type(PAGE))


def page_steps(pages: DataFrame) -> DataFrame:
    """pages(url, html) -> a step per section that has a heading or text: url, ordinal, title, heading, caption_text."""
    p = pages.select("url", parse_page("url", "html").alias("p"))
    # The outer form, since for the other one the planner adds a filter for which pages are parsed a second time.
    s = p.select("url", F.col("p.title").alias("title"), F.posexplode_outer("p.sections").alias("k", "s")).where("k is not null")
    head = F.concat_ws(" / ", F.nullif(F.col("s.heading"), F.lit("")), "url")
    return s.select("url", (F.col("k") + 1).alias("ordinal"), "title", F.col("s.heading").alias("heading"), F.concat_ws("\n\n", head, F.nullif(F.col("s.body"), F.lit(""))).alias("caption_text"), F.lit(100.0).alias("diff_score"), F.lit("document_section").alias("trigger"))


def samples(raw: pa.Array) -> pa.Array:
    """Lists of numbers, in one buffer from the start: a sample takes four bytes, never an object."""
    every = [np.frombuffer(b.as_buffer(), "<i2", len(b.as_buffer()) // 2) if b.is_valid else np.zeros(0, "<i2") for b in raw]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in every])])
    missing = np.append(raw.is_null().to_numpy(zero_copy_only=False), False)
    values = np.concatenate([np.zeros(0, "<i2"), *every]).astype(np.float32) / np.float32(32768)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=missing), pa.array(values))


@arrow_udf(ArrayType(FloatType()))
def pcm16(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Signed 16-bit little-endian samples as numbers below one; an odd last byte is dropped."""
    for batch in batches:
        for lo, hi in pieces(batch):
            yield samples(batch.slice(lo, hi - lo))


@by_row(ArrayType(BinaryType()))
def split_jpegs(raw: bytes | None) -> list[bytes] | None:
    """The images in a byte stream, from start to end marker."""
    return None if raw is None else re.findall(rb"\xff\xd8.*?\xff\xd9", raw, re.DOTALL)


def jpeg_size(b: bytes) -> tuple[int, int]:
    at = 2
    while b and at + 9 < len(b) and b[at] == 0xFF:
        kind = b[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", b[at + 5 : at + 9])
            return width, height
        at += 2 + int.from_bytes(b[at + 2 : at + 4], "big")
    return 0, 0


@by_row(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
def jpeg_dims(raw: bytes | None) -> dict:
    return dict(zip(("width", "height"), jpeg_size(raw)))


def crawl(links: DataFrame, pages: DataFrame, seed: str, depth: int | None = None, most: int = 30, pattern: str | None = None) -> DataFrame:
    """links(src, dst), pages(url, n_sections) -> url, depth of the first most pages with sections, links taken by dst; see sources.crawl."""
    from sourcelens.sources import crawl as C

    of = links.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("links"))
    table = pages.join(of, F.col("url") == F.col("src"), "left").select("url", "n_sections", F.coalesce("links", F.array().cast("array<string>")).alias("links"))
    found = C.crawl(table, seed, most, True, pattern, depth)
    return C.first(found, most).where("ordinal is not null").orderBy("ordinal").select("url", "depth")
