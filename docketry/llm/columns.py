"""Zero-copy access to Arrow columns inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from docketry.runtime import give_back


#: What 32-bit offsets can address.
MOST_BYTES = (1 << 31) - 1


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one uint8 array and n + 1 offsets into it; null is empty. Chunks may exceed 2 GiB together."""
    if isinstance(col, pa.ChunkedArray):
        if col.nbytes > MOST_BYTES:
            col = col.cast(pa.large_string())
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    if not wide and not pa.types.is_string(col.type):
        return utf8(col.cast(pa.string()))
    _, offsets, data = col.buffers()
    if offsets is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all ranges [start, start + length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, with unused memory given back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def released_groups(work: Callable[[tuple, pa.Table, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """work on a pair of groups, with unused memory given back at its end."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return work(key, left, right)
        finally:
            give_back()

    return run


def field(schema, name: str, as_name: str | None = None) -> str:
    """The DDL of a column of a DataFrame's schema."""
    return f"`{as_name or name}` {schema[name].dataType.simpleString()}"


def fresh(columns: list[str], name: str) -> str:
    """The name, or the name behind as many underscores as it takes to be none of the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def has_map(kind: DataType) -> bool:
    """Whether a type is or holds a map, which Spark neither hashes nor compares."""
    if isinstance(kind, ArrayType):
        return has_map(kind.elementType)
    return isinstance(kind, MapType) or isinstance(kind, StructType) and any(has_map(f.dataType) for f in kind.fields)


def comparable(value: Column, kind: DataType) -> Column:
    """A column whose maps have become arrays of their entries in the order of their keys; others are as they are."""
    if not has_map(kind):
        return value
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: comparable(x, kind.elementType))
    if isinstance(kind, MapType):
        entry = lambda k: F.struct(k.alias("key"), comparable(F.element_at(value, k), kind.valueType).alias("value"))
        return F.transform(F.sort_array(F.map_keys(value)), entry)
    return F.when(value.isNotNull(), F.struct(*[comparable(value[f.name], f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)]))
