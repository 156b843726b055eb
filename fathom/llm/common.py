"""What the operators share: reading tables, cutting lineage, bounded Arrow slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.materialize import discard, shared_dir, stored  # noqa: F401

#: A word is a run of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 4 << 20


#: What is held of long texts at once, where the session keeps Spark's defaults: bytes of an Arrow batch, rows of a scan's.
BOUNDS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", f"{2 << 20}b"),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"),
}


def bounded(spark: SparkSession) -> None:
    """Small batches in this session; settings of its own are left alone."""
    for key, (default, ours) in BOUNDS.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def least_hashes(order: Column, wanted: int, rows: int) -> Column:
    """Whether a 64-bit hash is among about twice the ``wanted`` least of ``rows``: a filter before a sort and limit, so
    that what tasks send for the limit doesn't grow with their number."""
    if rows <= 2 * wanted:
        return F.lit(True)
    return order < F.lit(-(1 << 63) + (1 << 65) * wanted // rows).cast("bigint")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice's text has at most ``limit`` bytes, or is one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(lengths, dtype=np.int64), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's texts; null is the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def on_one_thread() -> None:
    """Keep Rust thread pools from claiming more cores than the task has."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def given_back() -> None:
    """Give memory that isn't used any more back to the system; freed pieces stay with the process otherwise."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not on this system's C library
        pass


_HELD: dict = {}


def held(key, build):
    """What a worker keeps between tasks: one model or cache, the last asked for. Workers outlive a stage, so another
    operator's is given back to the system first."""
    if key not in _HELD:
        _HELD.clear()
        given_back()
        _HELD[key] = build()
    return _HELD[key]
