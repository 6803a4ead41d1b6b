"""Arrow batches for operators whose inner loop is Python: small helpers of tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows turned into Python objects at a time; bounds a task's memory beside its longest text.
SLICE_ROWS = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, most: int | None = None) -> Iterator[list[list]]:
    """Columns of at most ``rows`` rows as Python lists; with ``most``, of so many bytes in the last column, or of one row that has more."""
    for batch in batches:
        ends = None if most is None else np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            n = rows
            if ends is not None:
                n = min(rows, max(1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")) - at))
            part = batch.slice(at, n)
            yield [column.to_pylist() for column in part.columns]
            at += n


def map_slices(df: DataFrame, fn: Callable[..., list], schema: str, rows: int = SLICE_ROWS, most: int | None = None) -> DataFrame:
    """Run ``fn(*columns) -> columns`` over slices of every partition, one output row list per column."""
    out: StructType = _parse_datatype_string(schema)

    def run(batches):
        target = to_arrow_schema(out)
        for columns in slices(batches, rows, most):
            made = fn(*columns)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(made, target, strict=True)], schema=target)

    return df.mapInArrow(run, out)
