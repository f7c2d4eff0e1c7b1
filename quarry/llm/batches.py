"""What keeps Python workers small: batches bounded by bytes, and state that ends with its task."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of an Arrow batch that goes to a Python worker, about; a longer row is a batch of its own.
BATCH_BYTES = 2 << 20
BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_batches(df: DataFrame) -> DataFrame:
    """The same rows; from here on the session hands them to Python in batches of ``BATCH_BYTES`` at most, whatever the length of texts."""
    conf = df.sparkSession.conf
    if int(conf.get(BYTES_SETTING, str((1 << 31) - 1))) > BATCH_BYTES:
        conf.set(BYTES_SETTING, str(BATCH_BYTES))
    return df


def by_groups(links: Callable[[pa.Table], pa.RecordBatch]) -> Callable[[Iterator], Iterator]:
    """For ``mapInArrow``: ``links`` of whole groups, of rows that are sorted by their first two columns, ``g`` and ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows whose last group may go on
        last = None
        for batch in batches:
            if not len(batch):
                continue
            g, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            upto = int(np.argmax((g == g[-1]) & (part == part[-1])))  # where the batch's last group begins
            if upto or (held and last != (g[-1], part[-1])):
                ready = pa.Table.from_batches([*held, batch.slice(0, upto)], batch.schema)
                if len(ready):
                    yield links(ready)
                held = []
            held.append(batch.slice(upto))
            last = (g[-1], part[-1])
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores appended until no column of ``taken`` has it."""
    names = {x.lower() for x in taken}
    while name.lower() in names:
        name += "_"
    return name


def release() -> None:
    """Give memory that is no longer used back to the system: workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc
        pass


def tidy(run: Callable[[Iterator], Iterator], after: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, which calls ``after`` and gives memory back when the task's rows are done."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            if after:
                after()
            release()

    return wrapped
