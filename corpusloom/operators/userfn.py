"""User functions over batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BatchFn = Callable[[dict[str, list]], dict[str, list]]


def map_batches(df: DataFrame, fn: BatchFn, schema: str, batch_col: str | None = None) -> DataFrame:
    """``fn`` gets ``{column: values}`` and returns the same form; it may change the row count.

    Without ``batch_col`` the batches are Arrow batches of no fixed size. Where batch borders
    matter, name a column with the batch number: its rows, which should be few, go in together.
    Values are passed as Python objects, so whole numbers beside nulls stay whole.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_pydict(fn(table.to_pydict()), schema=out)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from run(pa.Table.from_batches([batch])).to_batches()

    if batch_col is None:
        return df.mapInArrow(stream, schema)
    return df.groupBy(batch_col).applyInArrow(run, schema)
