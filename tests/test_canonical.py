"""Canonical JSON against Python's own."""

import hashlib
import json
import math
import random

from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sourcelens.functions import canonical as C

KIND = "b boolean, a struct<z: int, y: array<struct<q: double, p: string>>>, `é` string, m map<string, array<bigint>>, n double, e array<string>, s struct<only: string>"


def test_nested_values(spark):
    rows = [
        (True, (1, [(0.5, "x"), (None, None)]), "naïve \U0001f600 \"q\" \\ / \n\t\r\b\f\x01\x7f", {"b": [1, -2], "a": [], "é": None, "Z": [0]}, 1e-7, ["", None], ("t",)),
        (None, None, None, None, None, None, None),
        (False, (None, []), "", {}, -0.0, [], (None,)),
    ]
    df = spark.createDataFrame(rows, KIND)
    got = [r[0] for r in df.select(C.of(df, *df.columns)).collect()]
    assert got == [json.dumps(r.asDict(recursive=True), sort_keys=True) for r in df.collect()]


def test_numbers(spark):
    rng = random.Random(4)
    values = [0.0, -0.0, 1.0, -1.5, 0.1, 123456789.125, 1e15, 9999999999999998.0, 1e16, 1.5e16, 1e17, 123456789012345680.0, 1e22, 1.7976931348623157e308, 5e-324, 1e-4, 9.99e-5, 0.001, 0.00012345, 1e-5, 2.5e-10, 1e100, -3e-200, 100.0, 12345678.0, 1e7, 9999999.0, math.inf, -math.inf, math.nan, 2.0**53]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-20, 25) for _ in range(3000)] + [float(rng.randint(-(10**9), 10**9)) / 8 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    got = [r[0] for r in df.select(C.json(F.col("v"), df.schema["v"].dataType)).collect()]
    print("WRONG", [(g, v) for g, v in zip(got, values) if g != json.dumps(v)])
    assert [(g, v) for g, v in zip(got, values) if g != json.dumps(v)] == []


def test_hash(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 2.5])], "id long, name string, v array<double>")
    got = df.select(F.sha2(C.of(df, "name", "v", "id"), 256)).first()[0]
    assert got == hashlib.sha256(json.dumps({"id": 1, "name": "a", "v": [1.0, 2.5]}, sort_keys=True).encode()).hexdigest()
    assert isinstance(df.schema, StructType) and isinstance(df.schema["id"], StructField)
