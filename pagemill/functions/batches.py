"""Arrow batches in slices: a batch is bounded by its rows alone, so what Python holds at once is bounded here by bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def slices(batch: pa.RecordBatch | pa.Array, at: int | None = None, rows: int = 256, size: int = 1_000_000) -> Iterator:
    """Slices of at most so many rows, and of so many bytes of the texts in column at (in the array itself if None); a longer text
    is a slice of its own."""
    lengths = pc.binary_length(batch if at is None else batch.column(at)).to_pylist()
    start = held = 0
    for k, n in enumerate(lengths):
        if k > start and (k - start == rows or held + (n or 0) > size):
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n or 0
    if start < len(lengths):
        yield batch.slice(start)


def changed(texts: pa.Array, change: Callable[[str], str]) -> pa.Array:
    return pa.array([None if t is None else change(t) for t in texts.to_pylist()], pa.string())


def in_slices(batches: Iterator[pa.RecordBatch], at: int, change: Callable[[str], str]) -> Iterator[pa.RecordBatch]:
    """Batches with column at changed; each slice is handed on before the next one is read."""
    for b in batches:
        for part in slices(b, at):
            yield part.set_column(at, part.schema.names[at], changed(part.column(at), change))


def map_text(df: DataFrame, column: str, change: Callable[[str], str]) -> DataFrame:
    """df with a column of texts changed by a function, one slice at a time; nulls stay."""
    at = df.columns.index(column)
    return df.mapInArrow(lambda batches: in_slices(batches, at, change), df.schema)
