"""Keeps executors small. Python workers live on from task to task, so what one operator leaves in them adds to the next:
a task gives its memory back when it ends, and caches are bounded. Arrow batches, which both sides hold whole, are of at
most ROWS rows: the session's setting is lowered where it is higher. No result depends on it."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

Batches = Iterator[pa.RecordBatch]
ROWS, _SETTING = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def give_back() -> None:
    """Returns freed memory to the system (the C library's part where it has such a call)."""
    gc.collect()
    if not gc.get_freeze_count():
        gc.freeze()  # what is left now is modules; not to be looked through after each task
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function for mapInArrow that gives memory back at the end of its task."""
    if (spark := SparkSession.getActiveSession()) and not 0 < int(spark.conf.get(_SETTING)) <= ROWS:
        spark.conf.set(_SETTING, str(ROWS))

    def task(batches: Batches) -> Batches:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about so many bytes in its last column, so that arrays stay small whatever the batch."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


class Recent(dict):
    """A cache of at most twice `most` entries: when it is full it becomes the older half, from which entries that are
    asked for again come back. Changes no result."""

    def __init__(self, make: Callable[[str], object], most: int) -> None:
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> object:
        if (value := self.older.get(key)) is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
