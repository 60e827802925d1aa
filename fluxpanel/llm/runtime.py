"""How the operators of this subpackage use Spark: batches of bounded size,
tables in the shared checkpoint folder, temporary column names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..tables import discard, materialise, shared_folder, small_side

#: Rows, and bytes of text, that an operator takes at a time.  Arrow batches hold
#: more (64 MB, by spark.sql.execution.arrow.maxBytesPerBatch) and are sliced here,
#: so nothing depends on settings of the session that a later action may not find.
BATCH_ROWS, BATCH_BYTES = 512, 1 << 20


__all__ = ["blobs", "discard", "fields", "map_batches", "materialise", "named", "packed", "plain", "shared_folder", "small_side", "table", "unpacked"]


def map_batches(df: DataFrame, f, schema: str | StructType) -> DataFrame:
    """`df.mapInArrow`, in batches of at most BATCH_ROWS rows and, where there is a
    text, BATCH_BYTES of text (or one row)."""
    return df.mapInArrow(lambda batches: f(_slices(batches)), schema)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place = batch.schema.get_field_index("text")
        part = np.arange(batch.num_rows) // BATCH_ROWS
        if place >= 0:
            sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            text = (np.cumsum(sizes) - sizes) // BATCH_BYTES
            part = part + text
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a or not batch.num_rows:
                yield batch.slice(a, b - a)


def plain(df: DataFrame, added: tuple[str, ...], read: tuple[str, ...] = ("text",)) -> tuple[DataFrame, list[str]]:
    """`df` without the columns `added`, and the names of what is left.  Columns but
    those in `read` are renamed by their place, so names with dots, backticks or
    blanks and names that an operator uses itself mean nothing to it; `named` gives
    them back."""
    inner = [c if c in read and c not in added else f"_{k}" for k, c in enumerate(df.columns)]
    kept = [(n, c) for n, c in zip(inner, df.columns, strict=True) if c not in added]
    return df.toDF(*inner).select(*[n for n, _ in kept]), [c for _, c in kept]


def named(df: DataFrame, own: list[str]) -> DataFrame:
    """`df` with its first columns called `own`."""
    return df.toDF(*own, *df.columns[len(own) :])


def packed(df: DataFrame, *read: str) -> DataFrame:
    """`row`, all columns of `df` by their place, and those in `read` beside it."""
    inner = [f"_{k}" for k in range(len(df.columns))]
    return df.toDF(*inner).select(F.struct(*inner).alias("row"), *[F.col(inner[df.columns.index(c)]).alias(c) for c in read])


def unpacked(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns that `packed` put into `row`, by their names."""
    return df.select("row.*").toDF(*names)


def fields(df: DataFrame, names: list[str], more: str) -> StructType:
    """A schema: columns of `df` by name, then `more`."""
    return StructType([StructField(f.name, f.dataType) for f in df.schema if f.name in names] + StructType.fromDDL(more).fields)


def blobs(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes; null stays None."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
