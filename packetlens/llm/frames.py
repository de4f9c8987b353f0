"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of an Arrow batch: texts are long, so the default of 10,000 rows would be too much memory.
BATCH_ROWS = 1000


def map_arrow(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema
) -> DataFrame:
    """``mapInArrow`` with batches small enough for long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def byte_blocks(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about ``limit`` bytes of a text or binary column, one row at least.

    Spark itself ends a batch at 64 MB, so that neither many rows nor long texts fill a task's memory.
    """
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(size, dtype=np.int64) // limit
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for low, high in zip(edges[:-1], edges[1:]):
        if high > low:
            yield batch.slice(low, high - low)


def utf8(column: str | Column) -> Column:
    """A text as its bytes, null as none: what vectorised code works on."""
    column = F.col(f"`{column}`") if isinstance(column, str) else column
    return F.coalesce(column.cast("binary"), F.lit("").cast("binary"))


def unused(names: Sequence[str], wanted: str) -> str:
    """``wanted``, or a longer name if a table already has such a column (names ignore case)."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def let(value: Column, run: Callable[[Column], Column]) -> Column:
    """``run(value)`` with ``value`` computed once for a row, however often ``run`` uses it."""
    return F.element_at(F.transform(F.array(value), run), 1)


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of an id written as text; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
