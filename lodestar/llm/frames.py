"""Small helpers shared by the operators: scratch tables, Arrow columns, constant seeds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestar.sources.tables import work_dir

#: Bytes of text, and rows, that a task works on at once.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 2048


class Scratch:
    """Intermediate tables below the shared folder of ``spark.checkpoint.dir``.

    A table is computed once, ends its lineage and outlives lost executors. ``drop`` removes it as
    soon as nothing reads it any more; what a returned frame still reads has to stay.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def table(self, df: DataFrame) -> DataFrame:
        path = work_dir(self.spark)
        df.write.parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(stored)] = (stored, path)
        return stored

    def drop(self, *frames: DataFrame | None) -> None:
        for frame in frames:
            if frame is None or id(frame) not in self._paths:
                continue
            _, path = self._paths.pop(id(frame))
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, null as empty, and where each row starts and ends in them."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pa.compute.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` of about ``size`` bytes in ``column`` and a bounded number of rows, one row at least."""
    _, offsets = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
        stop = min(max(stop, start + 1), start + BLOCK_ROWS, batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, stream: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    step = np.uint64(0x9E3779B97F4A7C15)
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(stream * 1_000_003)) * step)


def large_list(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One list a row out of flat ``values``."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
