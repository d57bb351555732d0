"""A column computed from whole string columns, slice by slice of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

#: Rows that one call of a function gets at most.
SLICE_ROWS = 1_000


def map_strings(rows: DataFrame, columns: list[str], into: str, kind: DataType, start: Callable[[], Callable[..., list | pa.Array]]) -> DataFrame:
    """The rows with a column from string columns (null: None); all others pass through.

    ``start`` runs once in each task and returns a function from one list of strings
    for each column to a list, or an Arrow array of the kind, of as many values.
    """
    others = [f for f in rows.schema.fields if f.name != into]
    names = [*[f.name for f in others], into]
    places, keep = [rows.columns.index(c) for c in columns], [rows.columns.index(f.name) for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function, arrow = start(), to_arrow_type(kind)
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(begin, SLICE_ROWS)
                values = function(*[part.column(i).to_pylist() for i in places])
                values = values if isinstance(values, pa.Array) else pa.array(values, arrow)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], values], names=names)

    return rows.mapInArrow(run, StructType([*others, StructField(into, kind)]))
