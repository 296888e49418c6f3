"""Helpers shared by the operators: pass-through maps, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueline.operators.graphs import connected_components  # noqa: F401
from cueline.storage import materialise, new_path, release, scratch  # noqa: F401


def private(*tables: DataFrame) -> str:
    """A prefix that no column of ``tables`` begins with, for columns of one's own."""
    taken = [c.lower() for df in tables for c in df.columns]
    prefix = "__own"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return prefix


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop the columns that would clash with the output columns ``names``."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def append_columns(
    df: DataFrame,
    source: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    binary: bool = False,
) -> DataFrame:
    """Append ``fields``, computed in Arrow batches from column ``source``.

    ``make`` runs once in each task and returns a function from the source array
    to one array per field. An input column named like a field is replaced.
    """
    names = [f.name for f in fields]
    column = F.col(f"`{source}`").cast("binary" if binary else "string").alias(private(df))
    rest = without(df, names)
    schema = T.StructType([*rest.schema.fields, *fields])
    width = len(rest.columns)
    kinds = [pa_type(f.dataType) for f in fields]
    columns = [F.col(f"`{c}`") for c in df.columns if c in rest.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            new = [a.cast(k) for a, k in zip(each(batch.column(width)), kinds, strict=True)]
            arrays = [*batch.columns[:width], *new]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:width], *names])

    return df.select(*columns, column).mapInArrow(run, schema)


def pa_type(kind: T.DataType) -> pa.DataType:
    simple = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(pa_type(kind.elementType))
    return simple[kind.simpleString()]


def chunks(array: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, list]]:
    """Slices of a text or binary array with about ``limit`` bytes each, as lists."""
    n, start = len(array), 0
    if not n:
        return
    base = array.offset
    width = 8 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else 4
    import numpy as np

    offsets = np.frombuffer(array.buffers()[1], dtype=f"<i{width}", count=base + n + 1)[base:]
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, max(start + 1, end))
        yield start, array.slice(start, end - start).to_pylist()
        start = end
