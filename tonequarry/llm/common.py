"""What the text operators share: the table, white space and case as the contracts fix them, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: [\x20\x09-\x0D]: the white space of words and line ends.
SPACES = " \t\n\x0b\x0c\r"
#: One word, as a Java regular expression.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Bytes of text that a Python worker takes up at a time.
CHUNK = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() does just that where all is ASCII."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def remainder(n: int, c: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def texts(column: pa.Array) -> list[str]:
    """A text column as Python strings, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about limit bytes of the named text column, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(name))
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64) + 16)
        start = 0
        while start < batch.num_rows:
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow in batches of bounded size; a worker that has done its task keeps no more memory than it needs."""
    bounded(df.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(whole, schema)


def release() -> None:
    """Give freed memory back to the system: Spark keeps Python workers, which wait beside the JVM's own tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def bounded(spark: SparkSession) -> None:
    """Arrow batches of at most 2000 rows and 8 MB, where the session still has Spark's own sizes."""
    for name, usual, own in (("maxRecordsPerBatch", ("10000",), "2000"), ("maxBytesPerBatch", ("-1", "64MB", "67108864", "67108864b", "256MB", "268435456", None), str(8 << 20))):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, None) in usual:
            spark.conf.set(key, own)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text", limit: int = CHUNK) -> DataFrame:
    """fn over df in pieces of bounded size, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, text, limit):
            out = fn(piece)
            if out is not None:
                yield out

    return in_arrow(df, run, schema)
