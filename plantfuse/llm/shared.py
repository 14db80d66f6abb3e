"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from plantfuse.session import removed, removed_at_exit, shared_path

#: Rows taken out of an Arrow batch at once, so that a task never holds the
#: Python objects of more than these.
ROWS = 256

#: Rows of a file of a small table. On a file system without native permissions each
#: file costs some seven processes, on any a task.
FILE_ROWS = 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of bounded numbers of rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def sized_slices(
    batches: Iterator[pa.RecordBatch],
    sizes: Callable[[pa.RecordBatch], np.ndarray],
    most: int,
    rows: int = ROWS,
) -> Iterator[pa.RecordBatch]:
    """As ``slices``, each of a bounded size too, or of one row that is larger."""
    for batch in slices(batches, rows):
        ends = np.cumsum(sizes(batch))
        start, before = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start, before = stop, int(ends[stop - 1])


def text_lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each text or binary of a column."""
    return pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)


def text_sizes(batch: pa.RecordBatch, column: int = 1) -> np.ndarray:
    """Bytes of the texts of a column of a batch."""
    return text_lengths(batch.column(column))


def by_slice(
    of: Callable[[pa.RecordBatch], pa.RecordBatch],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of slices as one that mapInArrow takes."""
    return lambda batches: map(of, slices(batches))


def written(frame: DataFrame, label: str, most: int | None = None) -> DataFrame:
    """The frame as a Parquet table in the shared folder.

    What several later steps read, and what must not change when a lost
    executor's work is repeated, is written once where all executors see it.
    The driver removes it when it ends.
    """
    return passing(frame, label, most)[0]


def passing(
    frame: DataFrame, label: str, most: int | None = None
) -> tuple[DataFrame, Callable[[], None]]:
    """As ``written``, and what removes the table once no later step reads it.

    ``most`` is a number of rows that the table cannot have more of, if one is
    known: it is then written as no more files than it needs for them.
    """
    if most is not None:
        frame = frame.coalesce(max(1, -(-most // FILE_ROWS)))
    spark, path = frame.sparkSession, shared_path(frame.sparkSession, f"llm-{label}")
    frame.write.parquet(path)
    removed_at_exit(spark, path)
    return spark.read.schema(frame.schema).parquet(path), lambda: removed(spark, path)
