import pandas as pd
from pyspark.sql import functions as F

from sourcelens.sources import parsers as P

HTML = """<html><head><title>Setup</title></head><body><nav><a href="/nav">n</a></nav><header>top</header><main><h1>Setup Guide for Acme Widget</h1><p>Intro <b>bold
<h2>Prerequisites</h2><ul><li>Python<li>Node</ul><h2>Install</h2><pre>pip x
# not a heading?</pre><h2>Configure</h2><p>Do it.</p></main><footer>foot</footer><script>x()</script></body></html>"""


def test_page(spark):
    r = spark.createDataFrame([("https://a.b/c", HTML), ("https://a.b/d", None), ("https://a.b/e", "<p>only")], "url string, html string").select(P.parse_page("url", "html").alias("p")).select("p.*").collect()
    assert r[0]["title"] == "Setup" and r[0]["links"] == ["https://a.b/nav"]
    heads = [s["heading"] for s in r[0]["sections"]]
    assert heads[:3] == ["Setup Guide for Acme Widget", "Prerequisites", "Install"] and heads[-1] == "Configure" and "- Python" in r[0]["markdown"] and "foot" not in r[0]["markdown"] and "top" not in r[0]["markdown"]
    assert r[1]["sections"] == [] and r[2]["markdown"] == "only"


def test_titles_as_sql_has_them(spark, tmp_path):
    """References without a semicolon, nested ones, blank and repeated titles, odd spaces."""
    import duckdb

    from sourcelens.catalog import ORACLE_SQL
    from sourcelens.plans.source_queries import fn_page_title

    titles = ["a &amp;&amp; b&amp", "&amp;lt;b&amp;gt; &lt;i&gt;", "&quot;x&#x27; &nbsp; &copy &#39;", " \n\tmany   blanks\r\n", "", "\u00a0 wide\u2003", "\x0bv\x1c", "<b>bold</b>", "$1 \\1", "&ampamp; &AMP;"]
    html = [f"<html><title>{t}</title><h1>head</h1>" for t in titles] + ["<TITLE>upper</TITLE><title>lower</title>", "<title lang=en>\none</Title>", "<title>open", "<p>none", None]
    spark.createDataFrame([(k, "http://a/", h) for k, h in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(ORACLE_SQL["fn_page_title"]).fetchall()
    assert sorted(map(tuple, fn_page_title(spark, str(tmp_path)).collect())) == sorted(want) and len(want) == 13


def test_cues():
    vtt = "WEBVTT\nKind: captions\nLanguage: en\n\n1\n00:00:10.500 --> 00:00:12.750 position:50%\nfirst\nline\n\nNOTE x\n\n00:01:00,000 --> 00:01:02,000\nsecond\n"
    assert P.cues_of(vtt) == [{"start": 10.5, "end": 12.75, "text": "first line"}, {"start": 60.0, "end": 62.0, "text": "second"}]
    assert P.cues_of('{"events":[{"tStartMs":1200,"dDurationMs":800,"segs":[{"utf8":"hi"}]},{"segs":[]}]}') == [{"start": 1.2, "end": 2.0, "text": "hi"}]
    assert P.cues_of("{bad") == [{"start": None, "end": None, "text": "{bad"}] and P.cues_of("") == []


def test_all_turns_as_cues(spark, tmp_path):
    """Turns with blank lines, arrows, digits and header words inside, read again block by block."""
    from sourcelens.plans.source_queries import fn_parse_cues

    texts = ["plain", "two\nlines", "a: b", "one --> two", "12", "NOTE x", "first\n\nWEBVTT\nlast", None, "", "Kind: x\n7\ny", "so\n\n\nmany"]
    spark.createDataFrame([(1, k, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = []
    for k, t in enumerate(texts):
        clock, parts = (2.0 * k, 2.0 * k + 1), (t or "").split("\n")
        block: list = []
        for line in [*parts, ""]:
            if line == "":
                if block:
                    want.append((*clock, " ".join(block)))
                clock, block = (None, None), []
            elif "-->" in line:
                clock = tuple(P.seconds(x) for x in (line.split("-->")[0], line.split("-->")[1].split()[0]))
            elif not line.isdigit() and not line.startswith(("NOTE", "WEBVTT", "STYLE")):
                block.append(line)
    got = [(r["start"], r["e"], r["text"]) for r in fn_parse_cues(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) == 8


def test_streams(spark):
    d = spark.createDataFrame([(bytearray(b"\x00\x80\xff\x7f\x01"),)], "b binary")
    assert [round(v, 4) for v in d.select(P.pcm16("b")).first()[0]] == [-1.0, 1.0]
    j = b"\xff\xd8\xff\xc0\x00\x11\x08\x01\x68\x02\x80\x03aaaaaaaaaa\xff\xd9"
    e = spark.createDataFrame([(bytearray(b"junk" + j + b"x" + j),)], "b binary")
    assert e.select(F.size(P.split_jpegs("b"))).first()[0] == 2 and P.jpeg_size(j) == (640, 360) and P.jpeg_size(b"") == (0, 0)


def test_crawl(spark):
    links = spark.createDataFrame([("http://a/1", "http://a/2"), ("http://a/1", "http://a/3"), ("http://a/2", "http://b/9"), ("http://a/3", "http://a/1")], "src string, dst string")
    pages = spark.createDataFrame([(u, 1) for u in ("http://a/1", "http://a/2", "http://a/3", "http://b/9")], "url string, n_sections int")
    assert {r["url"] for r in P.crawl(links, pages, "http://a/1").collect()} == {"http://a/1", "http://a/2", "http://a/3"}
    assert P.crawl(links, pages, "http://a/1", most=2).count() == 2


def test_crawl_follows_a_long_chain(spark):
    links = spark.createDataFrame([(f"http://a/{k}", f"http://a/{k + 1}") for k in range(13)], "src string, dst string")
    pages = spark.createDataFrame([(f"http://a/{k}", 1) for k in range(14)], "url string, n_sections int")
    assert [tuple(r) for r in P.crawl(links, pages, "http://a/0").collect()] == [(f"http://a/{k}", k) for k in range(14)]


def test_stream_equals_replay(spark, tmp_path):
    from sourcelens.streaming import live as L

    rows = [(s, k, n, float(t), v, x, "en") for s in (1, 2) for n, (k, t, v, x) in enumerate([("frame", 0, 0.0, None), ("caption", 1, None, "a"), ("frame", 2, 50.0, None), ("caption", 3, None, "b"), ("caption", 14, None, "c"), ("frame", 15, 0.0, None)])]
    table = spark.createDataFrame(rows, L.INPUT)
    want = sorted(tuple(r)[:4] + (r["text"],) for r in L.replay(table).collect())
    assert [w[2] for w in want if w[0] == 1] == ["keyframe", "keyframe", "quiet_period", "keyframe"]
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = L.live_steps(spark.readStream.schema(L.INPUT).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r)[:4] + (r["text"],) for r in spark.sql("select * from live").collect()) == want


def test_quiet_steps_are_due_without_another_row(spark, tmp_path):
    import time

    from sourcelens.streaming import live as L

    at = lambda *rows: [(1, k, n, float(t), v, x, "en") for n, (k, t, v, x) in enumerate(rows)]
    steps = lambda rows: [tuple(r)[1:] for r in L.replay(spark.createDataFrame(rows, L.INPUT)).orderBy("ordinal").collect()]
    first, said = ("frame", 0, 5.0, None), ("caption", 1, None, "a")
    assert steps(at(first, said, ("frame", 20, 90.0, None))) == [(1, "keyframe", 0.0, 0.0, None, ""), (2, "quiet_period", 0.0, 8.0, 0.0, "a"), (3, "keyframe", 8.0, 20.0, 85.0, "")]
    assert steps(at(first, said)) == [(1, "keyframe", 0.0, 0.0, None, ""), (2, "quiet_period", 0.0, 8.0, 0.0, "a")]
    assert steps(at(first, ("caption", 12, None, "late")))[1] == (2, "quiet_period", 0.0, 12.0, 0.0, "late")
    spark.createDataFrame(at(first, said), L.INPUT).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = L.live_steps(spark.readStream.schema(L.INPUT).parquet(str(tmp_path / "in")), quiet=2.0)
    q = out.writeStream.format("memory").queryName("quiet").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            if spark.sql("select * from quiet").count() >= 2:
                break
        assert [tuple(r)[1:] for r in spark.sql("select * from quiet order by ordinal").collect()] == [(1, "keyframe", 0.0, 0.0, None, ""), (2, "quiet_period", 0.0, 2.0, 0.0, "a")]
    finally:
        q.stop()


def test_a_crawl_makes_its_pages_once(spark):
    """A chain of pages takes a level each; pages are not made anew for each of them."""
    from sourcelens.sources import crawl as C

    made = spark.sparkContext.accumulator(0)

    def sections(n):
        made.add(1)
        return n

    n = 5
    rows = [(f"http://a/{k}", 1, [f"http://a/{k + 1}"]) for k in range(n)]
    pages = spark.createDataFrame(rows, "url string, n int, links array<string>").select("url", F.udf(sections, "int")("n").alias("n_sections"), "links")
    found = C.crawl(pages, "http://a/0").collect()
    assert len(found) == n + 1 and made.value == n
