"""Rows of Arrow batches in bounded parts, for functions that run in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS_AT_ONCE = 500


def rows_of(batches: Iterable, at_once: int = ROWS_AT_ONCE) -> Iterator[tuple]:
    """The rows as tuples of Python values; only ``at_once`` rows are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, at_once):
            part = batch.slice(at, at_once)
            yield from zip(*(part.column(k).to_pylist() for k in range(part.num_columns)), strict=True)


def batches_of(rows: Iterable[tuple], schema, at_once: int = ROWS_AT_ONCE, max_bytes: int = 8_000_000) -> Iterator:
    """Arrow batches of ``schema`` from tuples; a batch ends early once its strings and bytes reach ``max_bytes``."""
    import pyarrow as pa

    def batch(held: list[tuple]):
        columns = list(zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
                                          schema=schema)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str | bytes))
        if len(held) >= at_once or size >= max_bytes:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def in_tasks(df: DataFrame, function: Callable, ddl: str, *args) -> DataFrame:
    """``function(rows, *args)``, from tuples to tuples of the columns in ``ddl``, on the partitions of ``df``."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator) -> Iterator:
        yield from batches_of(function(rows_of(batches), *args), schema)

    return df.mapInArrow(run, ddl)
