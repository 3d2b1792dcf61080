"""Column helpers and word rules shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.session import BROADCAST_LIMIT_BYTES, materialize

# Fixed values of the word rules.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_WORD = r"[^\x20\x09-\x0D]+"
LETTER_WORD_RAW = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The row as it came, kept aside while an operator adds columns of its own.
ROW = "_input_row"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def kept_row(docs: DataFrame, columns: Iterable[str] | None = None) -> Column:
    """Columns of a table (all by default) as one struct, so that added names cannot clash."""
    return F.struct(*[named(c) for c in columns or docs.columns]).alias(ROW)


def unpacked(columns: Iterable[str]) -> list[Column]:
    """The columns that ``kept_row`` put aside."""
    return [F.col(ROW).getField(c).alias(c) for c in columns]


def numbered(docs: DataFrame) -> DataFrame:
    """(``ROW``, row): every row with a number of its own, the same whenever it is read.

    A table read from files is numbered by file and place, and its texts are not copied.  Any
    other is written with a counter first; inside a run scope it outlives that.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and (
        "_metadata" not in docs.columns
    ):
        file, at = F.xxhash64(F.col("_metadata.file_path")), F.col("_metadata.row_index")
        return docs.select(kept_row(docs), F.struct(file.alias("file"), at.alias("at")).alias("row"))
    counter = F.struct(
        F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at")
    )
    return materialize(docs.select(kept_row(docs), counter.alias("row")), keep=True)


def without(marked: DataFrame, gone: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The rows of :func:`numbered` but those in ``gone`` (row), with their own columns.

    A list of measured small size is broadcast, so that the texts stay where they are.
    """
    small = 64 * gone.count() <= BROADCAST_LIMIT_BYTES
    return marked.join(F.broadcast(gone) if small else gone, "row", "left_anti").select(
        *unpacked(columns)
    )


def text_of(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(named(column).cast("string"), F.lit(""))


def to_bytes_lower(text: str | None) -> bytes:
    """UTF-8 of a text with A-Z in lower case and nothing else changed."""
    return b"" if text is None else text.encode("utf-8").lower()


def release_memory() -> None:
    """Gives freed memory of a worker process back to the system, where that is possible."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
