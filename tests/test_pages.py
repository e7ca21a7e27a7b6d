"""Main content against a walk of the tree, and the crawl against a plain queue."""

import collections
import random
import re

from sourcelens.sources import crawl as C
from sourcelens.sources import dom
from sourcelens.sources import parsers as P


def scores(root):
    """(element, score) in document order, without noise, each subtree walked by itself."""
    def walk(e):
        yield e
        for x in e.items:
            if isinstance(x, P.Element) and x.tag not in P.DROP:
                yield from walk(x)

    def text(e):
        return [s for x in e.items for s in ([x] if isinstance(x, str) else text(x) if x.tag not in P.DROP else [])]

    for top in (x for x in root.items if isinstance(x, P.Element) and x.tag not in P.DROP):
        for e in walk(top):
            yield e, sum(len(" ".join(text(p)).strip()) for p in walk(e) if p.tag == "p")


def chosen(html):
    every = list(scores(P.Tree(html).root))
    wanted = [lambda e: e.tag == "main", lambda e: e.tag == "article", lambda e: e.attrs.get("role") == "main", lambda e: e.attrs.get("id") == "content", lambda e: e.attrs.get("id") == "main"]
    for is_it in wanted:
        for e, score in every:
            if is_it(e):
                return e.tag, score
    best = None
    for e, score in every:
        if e.tag in ("body", "div", "section") and (best is None or score > best[1]):
            best = (e.tag, score)
    return best or (every[0][0].tag, every[0][1]) if every else None


def random_page(rng):
    tags = ["div", "section", "p", "p", "span", "nav", "ul", "li", "aside", "b", "article", "main"]
    out = []

    def grow(depth):
        for _ in range(rng.randint(0, 4)):
            tag = rng.choice(tags[: 10 if rng.random() < 0.9 else 12])
            extra = rng.choice(["", "", "", "", ' role="main"', ' id="content"', ' id="main"'] if rng.random() < 0.1 else [""])
            out.append(f"<{tag}{extra}>{rng.choice(['', ' a b ', 'words ' * rng.randint(0, 9)])}")
            if depth < 5:
                grow(depth + 1)
            out.append("" if rng.random() < 0.1 else f"</{tag}>")
            out.append(rng.choice(["", " tail "]))

    grow(0)
    return ("<html><body>%s</body></html>" if rng.random() < 0.7 else "%s") % "".join(out)


def test_main_content_against_a_walk(spark):
    rng = random.Random(2)
    pages = [random_page(rng) for _ in range(400)] + ["", None, "only text", "<nav><p>x</p></nav>", "<div>" * 300 + "<p>deep</p>"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string").repartition(3)
    got = {r.page_id: (r.tag, r.score) for r in dom.main_content(dom.elements(df)).collect()}
    want = {k: c for k, h in enumerate(pages) if (c := chosen(h or ""))}
    assert got == want and len({t for t, _ in want.values()}) > 5


def plain_crawl(pages, seed, most, pattern=None):
    """Addresses in the order of a queue: (visited with status, captured in order)."""
    name = lambda u: re.sub(r"(?<=[^/])/+$", "", u.split("#")[0]) if u.count("/") > 3 else u.split("#")[0]
    known = {name(u): (n, links) for u, n, links in pages}
    queue, seen, captured = collections.deque([seed]), {}, []
    while queue and len(captured) < most:
        here = name(queue.popleft())
        if here in seen:
            continue
        n, links = known.get(here, (None, []))
        seen[here] = "failed" if n is None else "captured" if n else "empty"
        if n:
            captured.append(here)
            queue.extend(u for u in links if u.startswith("http://a/") and (not pattern or re.search(pattern, u)) and name(u) not in seen)
    return seen, captured


def test_crawl_against_a_queue(spark):
    rng = random.Random(3)
    n = 60
    at = lambda: rng.choice(["http://a/%d", "http://a/%d", "http://a/%d/", "http://a/%d#x", "http://b/%d"]) % rng.randint(0, n + 15)
    pages = [(f"http://a/{k}", rng.choice([0, 1, 1, 2]) if k else 1, [at() for _ in range(rng.randint(1, 6))]) for k in range(n)]
    pages[0][2].extend(["http://a/7", "http://a/3", "http://a/5"])
    df = spark.createDataFrame(pages, "url string, n_sections int, links array<string>")
    for most, pattern in ((1, None), (5, None), (12, "[0-5]"), (1000, None)):
        seen, captured = plain_crawl(pages, "http://a/0", most, pattern)
        rows = C.first(C.crawl(df, "http://a/0", most, pattern=pattern), most).collect()
        assert {r.url: r.status for r in rows} == seen
        assert [r.url for r in sorted((r for r in rows if r.ordinal), key=lambda r: r.ordinal)] == captured
    assert len(captured) > 12 and {"failed", "empty"} <= set(seen.values())


def test_links_of_pages_without_sections_are_not_followed(spark):
    html = lambda body, *links: "<html><body>" + "".join(f'<nav><a href="{x}">x</a></nav>' for x in links) + body + "</body></html>"
    pages = [("http://a/", html("<h1>Start</h1><p>x</p>", "/z", "b", "/gone", "//b/out")), ("http://a/z", html("", "/hidden")), ("http://a/b", html("<p>y</p>", "/")), ("http://a/hidden", html("<p>never</p>"))]
    seen = C.crawl(C.fetched(spark.createDataFrame(pages, "url string, html string")), "http://a/")
    assert {r.url: (r.depth, r.status) for r in seen.collect()} == {"http://a/": (0, "captured"), "http://a/z": (1, "empty"), "http://a/b": (1, "captured"), "http://a/gone": (1, "failed")}
    none = C.first(C.crawl(C.fetched(spark.createDataFrame(pages, "url string, html string")), "http://nowhere/"), 3).collect()
    assert [(r.url, r.ordinal, r.status) for r in none] == [("http://nowhere/", None, "failed")]
