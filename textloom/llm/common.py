"""What the operators of this subpackage share: tables, the shared folder, and access to Arrow text columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.arrow import lean, slices, trim
from textloom.session import forget, materialize, shared_dir, ship

__all__ = ["as_bytes", "forget", "held", "lean", "let", "materialize", "parts", "remainder", "shared_dir", "slices", "table", "trim"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table of the data folder, through Spark's own reader, whatever store the path names."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; a null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, a null as b''."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return []
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].tolist()
    whole = memoryview(column.buffers()[2] or b"")
    values = [whole[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
    if column.null_count:
        for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist():
            values[i] = b""
    return values


def parts(batch: pa.RecordBatch, text: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts (the column at `text`) have at most `most` bytes, one row at least."""
    sizes = [n or 0 for n in pc.binary_length(batch.column(text)).to_pylist()]
    for begin, end in slices(sizes, most):
        yield batch.slice(begin, end - begin)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside further lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


_HELD: dict[str, Any] = {}


def held(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task under a name. Only the last name is kept, as workers serve operators in turn."""
    if name not in _HELD:
        _HELD.clear()
        trim()
        _HELD[name] = make()
    return _HELD[name]
