"""Reading the given tables, and small helpers that every operator of this subpackage shares."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from echolens.sources.shared import write_and_read

__all__ = ["read", "written", "in_batches", "batch_of", "tree_sum", "TwoAgeCache"]

SLOTS = 256  # groups of partial sums in the first step
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, lineage cut, survives lost executors."""
    return write_and_read(df, name)


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` over batches of about ``BATCH_BYTES``.

    A batch is else 10,000 rows, of which the executor and its Python worker hold several copies at once, per task. A session
    that sets the bound itself keeps its own.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def tree_sum(rows: DataFrame, measure, dtype) -> np.ndarray | None:
    """Sum of the arrays of one shape that ``measure`` makes of an iterator over Arrow batches; None without rows.

    Tasks yield one packed partial sum each. These meet by groups of tasks first, then in one task, so that one
    array reaches the driver.
    """
    out = pa.schema([("slot", pa.int32()), ("part", pa.binary())])

    def added(parts):
        total = None
        for part in parts:
            total = part if total is None else total + part
        if total is not None:
            yield batch_of(out, [[TaskContext.get().partitionId() % SLOTS],
                                 [zlib.compress(total.astype(dtype).tobytes(), 1)]])

    def first(batches):
        yield from added(measure(b for b in batches if b.num_rows))

    def again(batches):
        yield from added(np.frombuffer(zlib.decompress(p.as_py()), dtype) for b in batches for p in b.column(1))

    schema = "slot int, part binary"
    sums = (in_batches(rows, first, schema).repartition("slot").mapInArrow(again, schema)
            .repartition(1).mapInArrow(again, schema).collect())
    return np.frombuffer(zlib.decompress(sums[0].part), dtype) if sums else None


class TwoAgeCache(dict):
    """``cache[key]`` computes and remembers ``make(key)`` within a fixed number of entries.

    When the young half is full it becomes the old half and the former old half is forgotten, so
    common keys stay and memory is bounded; a forgotten key is simply computed again.
    """

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.half, self.old = make, size // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
