"""Structured Streaming re-aims of the incremental jobs (survey §2.10).

* :func:`stream_expanding_mean` -- W1 as keyed state: per key the running
  (sum of values, row count) lives in ``applyInPandasWithState``; each
  micro-batch's rows of a key are processed in event order.
* :func:`stream_dedupe` -- U1's keep-one-per-key for a stream, bounded by
  a watermark (``dropDuplicatesWithinWatermark``).
* :func:`run_to_table` -- drive a stream to completion (``availableNow``)
  into a Parquet folder under the shared checkpoint dir (no memory sink,
  nothing collected on the driver) and return it as a batch DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ratecast.sources.io import scratch_path


def stream_expanding_mean(stream: DataFrame, key: str, value: str, order: Sequence[str], id_col: str,
                          out: str = "lag_mean", out_n: str = "lag_n") -> DataFrame:
    """Expanding mean of earlier rows per key (T1 rule: nulls counted in
    the row count, skipped in the sum; null current value -> null)."""
    order = list(order)
    out_schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField(key, T.LongType()),
                               T.StructField(out_n, T.LongType()), T.StructField(out, T.DoubleType())])
    state_schema = T.StructType([T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s, n = state.get if state.exists else (0.0, 0)
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        v = pdf[value].astype("float64")
        prev_n = n + pd.Series(range(len(pdf)), index=pdf.index, dtype="int64")
        prev_s = s + v.fillna(0.0).cumsum() - v.fillna(0.0)
        mean = (prev_s / prev_n.where(prev_n > 0)).where(v.notna())
        state.update((float(s + v.fillna(0.0).sum()), int(n + len(pdf))))
        yield pd.DataFrame({id_col: pdf[id_col].astype("int64"), key: pdf[key].astype("int64"),
                            out_n: prev_n.astype("int64"), out: mean})

    return stream.groupBy(key).applyInPandasWithState(step, out_schema, state_schema, "append",
                                                      GroupStateTimeout.NoTimeout)


def stream_dedupe(stream: DataFrame, keys: Sequence[str], ts: str, delay: str = "1 day") -> DataFrame:
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def run_to_table(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run ``stream`` until its available input is consumed; results land
    in Parquet under the shared checkpoint dir and are read back."""
    out = scratch_path(spark, f"stream-{name}")
    q = (stream.writeStream.format("parquet").option("path", f"{out}/data")
         .option("checkpointLocation", f"{out}/_checkpoint").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(f"{out}/data")
