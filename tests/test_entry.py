"""The driver's contract, and SQL equality of all queries that have SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
EVERY = sorted(entry.oracle_sql())


def rows(frame):
    return sorted(map(str, frame[sorted(frame.columns)].astype(str).values.tolist()))


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return c


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["playbook_id", "ordinal", "trigger", "steps", "text", "word_count"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", EVERY)
def test_sql_equality(spark, con, small, name):
    got = entry.queries()[name](spark, small).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert len(got) == len(want) and sorted(got.columns) == sorted(want.columns)
    if not any(t.startswith("float") for t in map(str, got.dtypes)):
        ints = [c for c in got if str(got[c].dtype).startswith(("int", "uint"))]
        assert rows(got.astype({c: "int64" for c in ints})) == rows(want.astype({c: "int64" for c in ints}))
