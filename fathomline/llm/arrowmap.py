"""Row-wise Python over Arrow batches, with memory bounded by bytes and not by rows.

Spark cuts batches by the session's settings (``spark.sql.execution.arrow.maxBytesPerBatch`` and ``maxRecordsPerBatch``,
the latter smaller while ``common.written`` writes); functions get slices of these. Freed memory goes back to the system
after each batch: workers are reused, and an idle one would otherwise keep the most that it has ever held.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from fathomline.llm.common import WordHashes

#: A batch handed to a function holds at most so many bytes of text, but one row at least.
SLICE_BYTES = 2 << 20


def release() -> None:
    """Give memory that is allocated but free back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other libraries don't
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``SLICE_BYTES`` of the text column, in order, all rows."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        rows = max(1, int(n * min(1.0, SLICE_BYTES / max(1, batch.column(text).nbytes))))
        for i in range(0, n, rows):
            yield batch.slice(i, rows)
        del batch
        release()
    WordHashes.forget()
    release()


def map_texts(df: DataFrame, function: Callable, schema: str, text: int = 1) -> DataFrame:
    """``function`` on each slice of ``df``; column number ``text`` has the texts."""

    def run(batches):
        for batch in slices(batches, text):
            yield from function(batch)

    return df.mapInArrow(run, schema)
