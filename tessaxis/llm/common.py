"""Helpers shared by the corpus operators."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaxis.sources.stages import dropped, shared_dir, written

__all__ = ["ASCII_LOWER", "LOWER", "UPPER", "crc_mod", "dropped", "in_slices", "partitions", "put", "shared_dir", "table", "with_field", "words", "written"]

SLICE = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Each batch in slices of about `most` bytes or list items of one column, so that few become Python objects at a time."""
    for batch in batches:
        values = batch.column(column)
        sizes = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
        total, start = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while start < len(total):
            done = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, done + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def with_field(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def put(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = [x for x in batch.schema.names if x != name]
    return pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), values], [*names, name])


def words(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words between ASCII white space (space, 0x09-0x0D), as UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; a null key gives -1."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(-1))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
