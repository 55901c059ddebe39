"""Arrow batch helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows handed to a function at once, whatever the session's batch size, so that its memory stays bounded.
ARROW_ROWS = 1024


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ARROW_ROWS):
            yield b.slice(at, ARROW_ROWS)


def map_columns(df: DataFrame, columns: Sequence[str], schema: str, fn: Callable[..., Sequence[Sequence]]) -> DataFrame:
    """Apply ``fn`` to Python lists of the named columns, one Arrow batch at a time.

    ``fn`` returns one list per output column.  Only the named columns reach Python, so the scan
    stays pruned to them.  An empty table gives an empty result.
    """
    out: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols = fn(*(b.column(i).to_pylist() for i in range(b.num_columns)))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(run, out)


def map_partition(df: DataFrame, columns: Sequence[str], schema: str, fn: Callable[[Iterator[list[list]]], Iterator[Sequence[Sequence]]]) -> DataFrame:
    """As :func:`map_columns`, for functions that keep state over a partition's batches."""
    out: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = ([b.column(i).to_pylist() for i in range(b.num_columns)] for b in slices(batches))
        for cols in fn(lists):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(run, out)
