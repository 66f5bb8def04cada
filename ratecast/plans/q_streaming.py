"""Streaming re-aims (§2.10) run end to end on the driver's tables: the
events file is read as a stream, processed with keyed state or a
watermark, and written to Parquet under the shared checkpoint dir."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratecast.plans.registry import query, measure
from ratecast.plans.tables import EVENTS_SQL, table
from ratecast.streaming import incremental as S

EV = EVENTS_SQL


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    # a glob makes the file source list the folder and pick the one table file
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .parquet(f"{sf.rstrip('/')}/events.parque[t]"))


_W = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("stream_expanding_mean", f"""SELECT event_id, user_id, CAST(count(*) OVER {_W} AS BIGINT) AS lag_n,
  (CASE WHEN value IS NOT NULL AND count(*) OVER {_W} > 0 THEN coalesce(sum(value) OVER {_W}, 0) / count(*) OVER {_W} END)
  AS lag_mean FROM events""")
def q_stream_expanding_mean(spark, sf):
    st = S.stream_expanding_mean(_event_stream(spark, sf), "user_id", "value", ["ts", "event_id"], "event_id")
    res = S.run_to_table(spark, st, "expanding_mean")
    return res.select("event_id", "user_id", "lag_n", measure("lag_mean").alias("lag_mean"))


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS d FROM events")
def q_stream_dedupe(spark, sf):
    # watermarks need TIMESTAMP (the session zone is UTC, so values are unchanged)
    st = _event_stream(spark, sf).withColumn("d", F.to_date("ts")).withColumn("ts", F.col("ts").cast("timestamp"))
    res = S.run_to_table(spark, S.stream_dedupe(st, ["user_id", "event_type", "d"], "ts", "2 days"), "dedupe")
    return res.select("user_id", "event_type", "d")
