"""What the operators of this subpackage share: Arrow batching, column appending, shared storage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import discard, put_file, shared_dir, written

__all__ = ["append_columns", "discard", "fresh_prefix", "lower_ascii", "put_file", "remainder", "shared_dir", "table", "text_chunks", "written"]

#: Bytes of text that a Python worker unpacks at once; a longer single text makes a chunk of its own.
CHUNK_BYTES = 1 << 20

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def lower_ascii(col: Column) -> Column:
    """Lower-cases A-Z only, as the contracts ask."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % F.lit(modulus)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_prefix(columns: list[str]) -> str:
    """Underscores that no column's name starts with, for columns of an operator's own."""
    prefix = "__"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """The C library's malloc_trim(), where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release_memory() -> None:
    """Gives freed memory back to the system: a Python worker stays after its task, beside whatever runs next on the executor."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices a record batch so that each slice holds about ``limit`` bytes of ``column``."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    yield batch.slice(start)
    release_memory()


def append_columns(
    df: DataFrame,
    text: str,
    fields: list[T.StructField],
    fn: Callable[[list[str | None]], list],
    inputs: list[str] | None = None,
) -> DataFrame:
    """Runs ``fn`` over chunks of ``text`` (and further ``inputs``) and appends what it returns, one list for each field.

    A column of ``df`` that has the name of a new field (in any case) is replaced by it.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in new or c == text or c in (inputs or ())]
    df = df.select(*[F.col(f"`{c}`") for c in kept])
    out_names = [c for c in kept if c.lower() not in new]
    schema = T.StructType([df.schema[c] for c in out_names] + fields)
    arrow_types = [_arrow_type(f.dataType) for f in fields]
    more = list(inputs or ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, text):
                columns = fn(part.column(text).to_pylist(), *[part.column(c).to_pylist() for c in more])
                arrays = [part.column(c) for c in out_names]
                arrays += [pa.array(v, type=t) for v, t in zip(columns, arrow_types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*out_names, *[f.name for f in fields]])

    return df.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    return {
        T.StringType: pa.string(), T.BinaryType: pa.binary(), T.LongType: pa.int64(), T.IntegerType: pa.int32(),
        T.DoubleType: pa.float64(), T.FloatType: pa.float32(), T.BooleanType: pa.bool_(),
    }[type(kind)]
