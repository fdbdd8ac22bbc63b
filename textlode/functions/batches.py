"""Arrow batches in small slices, so that a worker holds few rows as Python objects, whatever the size of a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes of a slice; a larger row is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in order, in slices that are halved until they are within both bounds."""
    if batch.num_rows > 1 and (batch.num_rows > rows or batch.nbytes > size):
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half), rows, size)
        yield from slices(batch.slice(half), rows, size)
    elif batch.num_rows:
        yield batch


def flat_map(df: DataFrame, make: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that ``make`` gives for the values of each row."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [r for values in zip(*(c.to_pylist() for c in part.columns), strict=True) for r in make(*values)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)
