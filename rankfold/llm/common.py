"""Helpers shared by the training-data operators.

Every operator that reads the same intermediate result twice writes it once with
``stage`` under ``spark.checkpoint.dir`` and reads it back: the files are shared, so a
lost executor costs only the tasks it was running.
"""

from __future__ import annotations

import contextlib
import ctypes
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rankfold.session import scratch_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CHUNK_ROWS = 1 << 17  # texts of one chunk; empty ones have no bytes that would close it
U64 = np.uint64
GOLDEN = 0x9E3779B97F4A7C15  # odd 64-bit multiplier of the polynomial hashes
MASK = (1 << 64) - 1


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and give memory back, and bound the bytes of one Arrow batch."""
    env = spark.sparkContext.environment
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"),
                       ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))):
        spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """A new schema with the columns of ``ddl`` at its end."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def buckets_for(total: int, per_bucket: int, spark: SparkSession) -> int:
    """Number of memory-sized buckets: follows the input, never fewer than the shuffle width."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // per_bucket), 1)


def give_back() -> None:
    """Return freed memory to the system after a large step; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def chunk_name(number: int) -> str:
    """Name of a task's chunk. A task that runs again over the same table's files names its chunks alike, so
    results of other tasks that refer to them stay valid when an executor is lost."""
    return f"{TaskContext.get().partitionId():08d}-{number:06d}"


def total_bytes(df: DataFrame, column: str) -> int:
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column (null: empty) as one byte array and ``n + 1`` offsets into it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset: wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    data = wide.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Powers:
    """Powers of the hash multiplier and of its inverse, grown on demand and kept per worker."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16, 2 * len(self.up) if len(self.up) < 1 << 24 else 0)
            one = np.ones(size, np.uint64)
            for name, base in (("up", GOLDEN), ("down", pow(GOLDEN, -1, 1 << 64))):
                steps = one * U64(base)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``n + 1`` prefix sums of ``(byte + 1) * g**i`` modulo 2**64."""
    up, _ = POWERS.get(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U64(1)) * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``[start, end)``; equal bytes give equal hashes."""
    _, down = POWERS.get(max(len(prefix), 1))
    return mixed((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text: starts, ends, and words before each text."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    edge = space[1:] != space[:-1]
    # A text's end closes its last word and a text's begin opens the next one.
    starts = np.flatnonzero(edge & ~space[1:])
    ends = np.flatnonzero(edge & space[1:])
    cuts = np.unique(offsets[1:-1]) if len(offsets) > 2 else np.empty(0, np.int64)
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    joined = cuts[~space[cuts] & ~space[cuts + 1]]
    if len(joined):
        starts, ends = np.sort(np.concatenate([starts, joined])), np.sort(np.concatenate([ends, joined]))
    return starts, ends, np.searchsorted(starts, offsets)
