"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from ..session import work_path

#: Rows handed to one vectorised step inside a task, and a bound on their text.
CHUNK_ROWS = 512
CHUNK_CHARS = 4_000_000


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared work folder and read it back.

    Cuts the lineage at a table every executor can read again, so a lost
    executor costs a re-read and not a re-computation.
    """
    path = work_path(df.sparkSession, "llm", name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_of(df: DataFrame) -> int:
    """Shuffle partitions the session is set to."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front as long as a column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def texts(column: pa.Array) -> list[str]:
    """Python strings of a text column; null reads as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def chunks(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch holding at most CHUNK_ROWS rows and about CHUNK_CHARS bytes of text."""
    sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (i - start >= CHUNK_ROWS or held + size > CHUNK_CHARS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if batch.num_rows > start:
        yield batch.slice(start)


def all_chunks(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from chunks(batch, text)
