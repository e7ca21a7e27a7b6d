"""Python functions of a row's text or bytes, run over Arrow batches in pieces, so that a task holds the objects of a piece only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Bytes and rows of a piece; a longer row is a piece of its own.
BYTES, ROWS = 1 << 20, 1 << 9


def sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each text, or of each list of texts."""
    if pa.types.is_list(column.type):
        total = np.concatenate([[0], np.cumsum(sizes(column.values))])
        at = column.offsets.to_numpy()
        return total[at[1:]] - total[at[:-1]]
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def pieces(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of runs of rows with about BYTES bytes and at most ROWS rows."""
    end, lo = np.cumsum(sizes(column)), 0
    while lo < len(column):
        hi = int(np.searchsorted(end, (end[lo - 1] if lo else 0) + BYTES, "right"))
        hi = max(lo + 1, min(hi, lo + ROWS))
        yield lo, hi
        lo = hi


def by_row(kind: DataType):
    """Makes a function of one value, null being None, a function of a column with results of this kind."""

    def make(f: Callable):
        arrow = to_arrow_type(kind)

        @arrow_udf(kind)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                for lo, hi in pieces(batch):
                    yield pa.array([f(x) for x in batch.slice(lo, hi - lo).to_pylist()], arrow)

        return run

    return make
