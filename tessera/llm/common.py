"""Helpers shared by the training-data operators: shared-folder checkpoints, Arrow text buffers, sampling."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import checkpoint as checkpoint
from ..operators.graph import checkpoint_dir as checkpoint_dir

#: Bytes of text that the numpy operators turn into temporaries at once.
BLOCK_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Bounds the Arrow batches handed to Python, by rows and by bytes, because a row here is a whole document.  Queries are lazy,
    so the session keeps these settings; the registered queries set them, the operators do not."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """Gives freed memory back to the system when a task ends: workers live on, and several wait beside each other."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass

    return wrapped


def keep_heap() -> None:
    """Lets the C library keep freed memory while a task runs (``frugal`` gives it back at the end).  Arrays of a megabyte that are
    made and freed in a loop can else go back to the system each time, and every page of the next one is a page fault.
    Freeing one block, untouched, raises glibc's own threshold, which it bounds by 32 MB."""
    np.empty(31 << 20, np.uint8)


def broadcast_if(small: DataFrame, rows: int = 200_000) -> DataFrame:
    """With a broadcast hint if the rows (a few fixed-size columns each) are few; else a shuffle joins it."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only.  ``lower`` is the fast way where no other character can change."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def crc_mod(key: str | Column, m: int) -> Column:
    c = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(c.cast("string")), F.lit(0)) % m


def hash_fraction(key: str, seed: int) -> Column:
    """A number in [0, 1) fixed by the key: samples drawn with it are the same on every run."""
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def spread(text: str, key: str, span: int, seed: int) -> Column:
    """The text, or ``span`` characters of a longer one from a place fixed by the key."""
    at = F.floor(hash_fraction(key, seed + 1) * F.greatest(F.char_length(text) - span, F.lit(0))).cast("int") + 1
    return F.substr(F.col(text), at, F.lit(span))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one array, and the n+1 offsets of its rows (a null row is empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(col) else np.zeros(0, np.uint8)
    return raw, off - off[0]


def texts(col: pa.Array) -> list[str]:
    return [x or "" for x in col.to_pylist()]


def groups_by_bytes(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of about ``limit`` bytes at most; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
