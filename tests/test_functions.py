import pytest
from pyspark.sql import functions as F

from sourcelens.functions import media as M
from sourcelens.functions import text as T
from sourcelens.functions import urls as U


def one(spark, f, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("f", "value", "want"), [
    (T.slugify, "Power BI / Refresh!", "power-bi-refresh"), (T.slugify, "!!", "tutorial"), (T.slugify, "a" * 200, "a" * 80), (T.vtt_seconds, "00:00:10.500", 10.5), (T.vtt_seconds, "1:02,5", 62.5), (T.vtt_seconds, "x", None),
    (T.topic_from_seed_url, "https://docs.astral.sh/uv/getting-started/", "uv"), (T.doc_heading, "A — B / http://x", "B"), (T.normalize_space, "  a \n b ", "a b"), (T.first_sentence, "One two. Three", "One two"), (T.word_count, None, 0),
    (T.topic_from_title, "2026 Data Analyst Bootcamp for FREE", "Data Analyst"), (U.normalize_url, "http://a.b/c/?q=1#f", "http://a.b/c?q=1"), (U.normalize_url, "http://a.b", "http://a.b/"),
    (U.infer_name, "https://youtu.be/abc123", "youtube-abc123"), (U.infer_name, "https://docs.stripe.com/webhooks/signatures", "stripe-signatures"), (U.infer_name, "https://example.com/tutorial", "example-tutorial"), (U.infer_name, "C:\\media\\power-bi.mp4", "power-bi"),
])
def test_text(spark, f, value, want):
    assert one(spark, f, value) == want


@pytest.mark.parametrize(("source", "pages", "want"), [("https://youtu.be/abc123", 1, "youtube_video"), ("https://docs.stripe.com/webhooks/signatures", 1, "web_page"), ("https://example.com/docs/start", 5, "documentation_site"), ("https://example.com/manual.pdf", 1, "pdf"), ("/x/lesson.mp4", 1, "local_video"), ("not-a-url-or-known-file", 1, "error")])
def test_router(spark, source, pages, want):
    assert one(spark, lambda x: U.source_type(x, F.lit("auto"), F.lit(pages), F.lit("")), source) == want


def test_url_join_like_the_standard_library(spark):
    from urllib.parse import urljoin

    bases = ["http://a.b/c/d/e", "http://a.b/c%20d.pdf", "http://a.b", "http://a.b/x/?q=2", "https://a.b/c/d/#old"]
    refs = ["../x", "?q=1", "./y/", "../../../z", "/p/../r", "//h/i", "mailto:x", "k/./l/..", "#f", ".", "..", "m?n=../o", "", "g;x=1/../y"]
    rows = [(b, r, urljoin(b, r)) for b in bases for r in refs]
    got = spark.createDataFrame(rows, "b string, r string, want string").select("b", "r", "want", U.url_join(F.col("b"), F.col("r")).alias("got")).collect()
    assert [(x["b"], x["r"], x["got"]) for x in got if x["got"].rstrip("/") != x["want"].rstrip("/")] == []


@pytest.mark.parametrize(("f", "value", "want"), [
    (U.infer_name, "https://a.b/c%20d.html", "a-c-d"), (U.infer_name, "https://docs.a.b/x/y%2Fz/", "a-z"), (U.pdf_filename, "https://a.b/c%20d.pdf", "c d.pdf"), (U.pdf_filename, "https://a.b/", "source.pdf"), (U.pdf_filename, "https://a.b/r.v2", "r.v2.pdf"),
    (U.pdf_filename, "https://a.b/100%.PDF?x", "100%.PDF"),
])
def test_names_are_decoded(spark, f, value, want):
    assert one(spark, f, value) == want


def test_clock_and_joins(spark):
    assert one(spark, T.clock, 33951, "int") == "9:25:51" and one(spark, T.clock, None, "int") == "?:??" and one(spark, T.timecode, -3, "int") == "0:00"
    lists = [([], ""), (["a"], "a"), (["a", "b"], "a and b"), (["a", "", "b", "c"], "a, b, and c")]
    for value, want in lists:
        assert one(spark, T.natural_join, value, "array<string>") == want
    assert one(spark, T.natural_join_quoted, ["a", "b"], "array<string>") == "'a' or 'b'"


def test_frontmatter(spark):
    r = spark.createDataFrame([("---\nname: 'x'\n# c\nabout: y: z\n---\nBody\n",), ("no front",)], "x string").select(T.split_frontmatter(F.col("x")).alias("f")).select("f.*").collect()
    assert r[0]["meta"] == {"name": "x", "about": "y: z"} and r[0]["body"] == "Body\n" and r[1]["meta"] == {} and r[1]["body"] == "no front\n"


def test_frames(spark):
    d = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([1.0], [1.0, 2.0]), ([], [])], "a array<double>, b array<double>")
    assert [r[0] for r in d.select(M.mean_abs_diff(F.col("a"), F.col("b"))).collect()] == [1.5, float("inf"), float("inf")]
    box = F.struct(F.lit(0).alias("left"), F.lit(0).alias("top"), F.lit(100).alias("right"), F.lit(10).alias("bottom"))
    assert one(spark, lambda _: M.zones(box, F.lit(640), F.lit(360))) == ["left_rail", "top_bar", "top_left"]
    for ratio, text, diff, want in [(0.95, False, None, "screen_transition"), (None, False, None, "no_visible_change"), (0.1, True, None, "text_entry_or_selection"), (0.3, True, None, "content_update"), (0.02, False, None, "pointer_or_selection_change"), (0.2, False, 70.0, "visual_cut"), (0.2, False, 1.0, "layout_change")]:
        a = M.classify_action(F.lit(ratio).cast("double"), F.array(F.lit("middle_center")), F.lit(text), F.lit(diff).cast("double"))
        assert one(spark, lambda _: a["action"]) == want
