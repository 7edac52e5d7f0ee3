"""What several operators share: input columns, tables settled in the shared folder, Arrow batches in blocks."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir

# Texts of one block together, unless a single text is longer. Memory of a task follows this, not its input.
BLOCK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A text column where null counts as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: a cut of the lineage that outlives any executor.

    The files stay until the folder is cleaned; each call has a folder of its own, so reruns never meet. Row groups
    are small, because a task holds one in memory while it writes.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/panelmill-{uuid.uuid4().hex}/{name}"
    df.write.options(**{"compression": "zstd", "parquet.block.size": str(32 << 20)}).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the texts of one piece have about `size` bytes; a longer text stands alone."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        ends = _offsets(batch.column(at))
        first, rows = 0, batch.num_rows
        while first < rows:
            last = first + 1
            while last < rows and ends[last + 1] - ends[first] <= size:
                last += 1
            yield batch.slice(first, last - first)
            first = last


def _offsets(texts: pa.Array):
    import numpy as np

    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    if not len(texts):
        return np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)


def bytes_of(texts: pa.Array):
    """The UTF-8 bytes of a text column in one array, and where each text begins and the last one ends."""
    import numpy as np

    offsets = _offsets(texts)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]
