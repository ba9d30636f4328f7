"""Kernels over sentences that run one after another in a single Python stage, so that what they hand on never goes through the JVM.

A flow begins with lines (doc_id, sent_id, text). Its batches are cut to a bounded number of characters, a sentence at least, so what a
worker holds doesn't grow with the rows of Spark's batches or with their lengths; columns that a query doesn't return never leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[pa.RecordBatch], pa.RecordBatch]
#: Characters of a slice.
CHARACTERS = 1 << 18


def slices(batch: pa.RecordBatch, text: int = 2, most: int = CHARACTERS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that have `most` characters in a column, or one row."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes + 1)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def run(lines: DataFrame, steps: list[Step], schema: str) -> DataFrame:
    """What the steps make of the lines' batches."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for step in steps:
                    part = step(part)
                yield part

    return lines.select(F.col("doc_id").cast("bigint"), F.col("sent_id").cast("int"), "text").mapInArrow(stage, schema)


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with a column added or replaced."""
    names = batch.schema.names
    columns = dict(zip(names, batch.columns, strict=True)) | {name: values}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def starts(lists: pa.ListArray) -> np.ndarray:
    """Where each list begins among their elements on end, and where the last ends."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0]


def owners(lists: pa.ListArray) -> np.ndarray:
    """The row of each element."""
    return np.repeat(np.arange(len(lists)), np.diff(starts(lists)))


def field(lists: pa.ListArray, name: str) -> pa.Array:
    flat = lists.flatten()
    return flat.field(flat.type.get_field_index(name))


def with_fields(lists: pa.ListArray, **changed: pa.Array) -> pa.ListArray:
    """Lists of structs with some of their fields replaced."""
    flat = lists.flatten()
    values = [changed[f.name].cast(f.type) if f.name in changed else flat.field(k) for k, f in enumerate(flat.type)]
    return pa.ListArray.from_arrays(pa.array(starts(lists).astype(np.int32)), pa.StructArray.from_arrays(values, fields=list(flat.type)))


def ints(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int32))


def per_row(batch: pa.RecordBatch, *rows: np.ndarray | None, **columns: pa.Array) -> pa.RecordBatch:
    """doc_id, sent_id (of the given rows, or of all) and columns."""
    ids = [batch.column(k) if not rows else batch.column(k).take(pa.array(rows[0])) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([*ids, *columns.values()], ["doc_id", "sent_id", *columns])


def joined(values: pa.Array, bounds: np.ndarray, sep: str) -> pa.Array:
    """Strings joined by stretches: bounds[k] to bounds[k + 1] is the k-th."""
    values = values if pa.types.is_string(values.type) else values.cast(pa.string())
    return pc.binary_join(pa.ListArray.from_arrays(ints(bounds), values), sep)


def joined_ranges(values: pa.Array, begins: np.ndarray, ends: np.ndarray, sep: str) -> pa.Array:
    """Strings joined by ranges, which may overlap or be empty."""
    from ..operators.trees import scatter

    sizes = np.maximum(ends - begins, 0)
    return joined(values.take(pa.array(scatter(begins, sizes))), np.append(0, np.cumsum(sizes)), sep)


def token_rows(names: list[str]) -> Step:
    """A row a token: doc_id, sent_id, i and the named fields of tokens or units."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = batch.column("tokens")
        begin, row = starts(tokens), owners(tokens)
        of = {}
        for column in ("tokens", "units"):
            if column in batch.schema.names:
                flat = batch.column(column).flatten()
                of |= {f.name: (flat, k) for k, f in enumerate(flat.type)}
        return per_row(batch, row, i=ints(np.arange(len(row)) - begin[:-1][row]), **{n: of[n][0].field(of[n][1]) for n in names})

    return step


def counted(*names: str) -> Step:
    """Rows that agree in all of the named columns, with their number `n`."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = pa.table({n: batch.column(n) for n in names}).group_by(list(names)).aggregate([([], "count_all")]).rename_columns([*names, "n"])
        return table.combine_chunks().to_batches()[0] if table.num_rows else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in table.schema], table.schema.names)

    return step
