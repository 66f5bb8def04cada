"""Vectors as bytes, dealt into shards of bounded size, and the meeting of
blocks of queries with those shards.

A row's shard is a hash of its place in the written table, not of its id or
content, so that no id and no vector, however often it occurs, makes a
shard larger.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratecast.llm.common import Scratch


def usable(nonzero: bool = False, column: str = "embedding") -> Column:
    """Whether a vector has components, none of them null or non-finite (and,
    for ``nonzero``, one that is not 0); false for null."""
    v = F.transform(column, lambda c: c.cast("double"))
    good = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    if nonzero:
        good &= F.exists(v, lambda c: c != 0)
    return F.coalesce(F.when(F.col(column).isNotNull(), good), F.lit(False))


def dealt(vectors: DataFrame, store: Scratch, name: str, label: Column | None = None) -> DataFrame:
    """A written table (vec_id, label, dim, v, place) of usable vectors: v holds
    the components' bytes, 32-bit floats where the column has them and else
    64-bit ones, and place is the row's own number."""
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    kind = "<f4" if single else "<f8"

    def run(batches):
        nth = TaskContext.get().partitionId() << 40
        for batch in batches:
            v = batch.column(2)
            size = pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(kind)
            ends = np.concatenate([[0], np.cumsum(size) * flat.itemsize]).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int32()), raw, pa.array(np.arange(nth, nth + len(size)))],
                names=["vec_id", "label", "dim", "v", "place"])
            nth += len(size)

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), (F.lit(None) if label is None else label).cast("long").alias("label"),
                          F.transform("embedding", lambda c: c.cast("float" if single else "double")).alias("embedding"))
    return store.write(rows.mapInArrow(run, "vec_id long, label long, dim int, v binary, place long"), name)


def matrix(column, dim: int) -> np.ndarray:
    """A column of vectors' bytes as rows of 64-bit floats."""
    raw = b"".join(column.to_pylist())
    wide = len(raw) // max(1, len(column)) // dim
    return np.frombuffer(raw, f"<f{wide or 8}").reshape(-1, dim).astype(np.float64)


def shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int")


def meet(rows: DataFrame, asks: DataFrame, shards: int, turns: int, run, schema: str) -> DataFrame:
    """``run(key, rows, asks)`` for every shard of ``rows`` (which has a column
    ``shard``) with every one of ``turns`` blocks of ``asks``, of equal dimension."""
    left = rows.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    right = asks.withColumn("turn", F.pmod(F.xxhash64("place", F.lit(1)), F.lit(turns)).cast("int"))
    right = right.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    keys = ("dim", "shard", "turn")
    right = right.toDF(*right.columns)  # columns of its own, also where both sides come from one table
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def blocks(rows: int, size: int) -> int:
    """Number of blocks of about ``size`` rows."""
    return max(1, -(-rows // size))
