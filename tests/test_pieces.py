import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sourcelens.functions import pieces as C
from sourcelens.operators import steps as S
from sourcelens.sources import parsers as P

PAGE = "<html><title>t</title><body><main><h1>a</h1><p>b</p></main></body></html>"


def test_pieces_are_bounded():
    long = "x" * (C.BYTES + 1)
    assert list(C.pieces(pa.array(["a", long, None, "b"]))) == [(0, 1), (1, 2), (2, 4)]
    assert list(C.pieces(pa.array([["a", long], None, [], ["b", None]]).slice(1))) == [(0, 3)]
    assert max(hi - lo for lo, hi in C.pieces(pa.array([""] * 3000))) == C.ROWS and list(C.pieces(pa.array([], pa.string()))) == []


def test_a_batch_is_given_back_in_pieces():
    """Results of a batch are never whole in memory: pages, captions, samples."""
    n, html = 2000, pa.array([PAGE, None] * 1000)
    got = list(P.parse_page.func(iter([(pa.array(["http://a/"] * n), html)])))
    assert max(map(len, got)) <= C.ROWS and sum(map(len, got)) == n and got[0][0]["title"].as_py() == "t"
    got = list(S.overlap_merge.func(iter([pa.array([["a b c d", "b c d e"], None] * 1000)])))
    assert max(map(len, got)) <= C.ROWS and [x for g in got for x in g.to_pylist()] == ["a b c d e", None] * 1000
    raw = pa.array([bytes(range(256)) * 8192, None, b"", b"\x01"])
    got = list(P.pcm16.func(iter([raw])))
    assert sum(g.nbytes for g in got) < 2.1 * len(raw[0].as_py()) and [x is None for g in got for x in g.to_pylist()] == [False, True, False, False]
    assert got[0][0].values.to_numpy().tolist() == (np.frombuffer(raw[0].as_py(), "<i2").astype(np.float32) / 32768).tolist()


def test_pages_are_parsed_once(spark):
    p = spark.createDataFrame([("http://a/1", PAGE), ("http://a/2", None)], "url string, html string")
    steps = P.page_steps(p)
    assert steps.count() == 1 and steps._jdf.queryExecution().executedPlan().toString().count("parse_page(") == 1
