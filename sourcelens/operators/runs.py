"""Folds over sorted runs: rows of a key in order, with a state that passes over batches, so a run of any length fits.

A fold whose state depends on all rows before it is sequential within its key; keys are dealt to tasks, sorted there by
Spark (which spills), and read batch by batch. Nothing of a run is held but its fold's own state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a task gives back at a time.
ROWS = 8192


class Fold:
    """What one run does: feed gets each row's values without the key, end comes after the last; both give rows of the result."""

    def feed(self, *values) -> list[tuple]:
        raise NotImplementedError

    def end(self) -> list[tuple]:
        return []


def fold_runs(rows: DataFrame, key: str, order: list[str], values: list[str], begin: Callable[[], Fold], result: StructType) -> DataFrame:
    """rows -> (key, *result). A run is all rows with a key, null being one, sorted by order; begin makes its fold."""
    schema = StructType([rows.schema[key], *result.fields])
    names, kind = schema.names, to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        fold, at = None, None

        def record() -> pa.RecordBatch:
            columns = zip(*out) if out else [[] for _ in names]
            made = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kind)], schema=kind)
            out.clear()
            return made

        for batch in batches:
            keys, *rest = (c.to_pylist() for c in batch.columns)
            for k, *row in zip(keys, *rest):
                if fold is None or k != at:
                    if fold is not None:
                        out += [(at, *r) for r in fold.end()]
                    fold, at = begin(), k
                out += [(k, *r) for r in fold.feed(*row)]
                if len(out) >= ROWS:
                    yield record()
        if fold is not None:
            out += [(at, *r) for r in fold.end()]
        if out:
            yield record()

    dealt = rows.select(key, *dict.fromkeys([*values, *order])).repartition(key).sortWithinPartitions(key, *order)
    return dealt.select(key, *values).mapInArrow(run, schema)
