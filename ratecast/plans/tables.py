"""Driver tables in the reference's roles (survey §7.3).

``events`` plays the broadcast table: series key ``user_id``, category
``event_type`` (the status role), date ``to_date(ts)``, hour ``hour(ts)``,
measure ``value`` and a second measure ``k`` from the JSON ``props``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Total order of the broadcast role: (ts, event_id).
EV_ORDER = ["ts", "event_id"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broadcast-role view of ``events`` (column pruning still applies:
    unused derived columns never reach the scan)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").try_cast("double").alias("k"),
        F.to_date("ts").alias("d"),
        F.hour("ts").cast("bigint").alias("h"),
        F.dayofweek("ts").cast("bigint").alias("dow"),  # 1 = Sunday
    )


EVENTS_SQL = """(SELECT event_id, ts, user_id, event_type, value,
    TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
    CAST(ts AS DATE) AS d, CAST(hour(ts) AS BIGINT) AS h,
    CAST(dayofweek(ts) + 1 AS BIGINT) AS dow FROM events)"""


# ---------------------------------------------------------------------------
# The event-interval calendar used against ``events``
# (2024-01-01 .. 2024-01-30).  Overlapping season and security rows, a
# one-day holiday, a null end and a reversed range are deliberate.
# (ord, category, name, start, end, severity)
# ---------------------------------------------------------------------------
INTERVALS = [
    (1, "season", "winter-a", "2024-01-01", "2024-01-15", None),
    (2, "season", "winter-b", "2024-01-10", "2024-01-31", None),
    (3, "holiday", "new-year", "2024-01-01", "2024-01-01", 3),
    (4, "holiday", "mid-feast", "2024-01-18", "2024-01-20", 5),
    (5, "security", "alert-north", "2024-01-05", "2024-01-12", 7),
    (6, "security", "alert-south", "2024-01-09", "2024-01-14", 4),
    (7, "security", "op-open", "2024-01-25", None, 9),
    (8, "political", "election", "2024-01-22", "2024-01-24", 2),
    (9, "security", "alert-east", "2024-01-12", "2024-01-12", 6),
    (10, "holiday", "reversed", "2024-01-28", "2024-01-26", 1),
]
SEC_CATS = ["security", "political"]

_IV_SCHEMA = T.StructType([
    T.StructField("ord", T.LongType()), T.StructField("category", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("start_date", T.DateType()),
    T.StructField("end_date", T.DateType()), T.StructField("severity", T.LongType())])


def _d(s):
    return dt.date.fromisoformat(s) if s else None


def intervals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(o, c, n, _d(s), _d(e), v) for o, c, n, s, e, v in INTERVALS], _IV_SCHEMA)


def _lit(v):
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


INTERVALS_SQL = "(SELECT CAST(ord AS BIGINT) AS ord, category, name, CAST(start_date AS DATE) AS start_date, " \
    "CAST(end_date AS DATE) AS end_date, CAST(severity AS BIGINT) AS severity FROM (VALUES " + ", ".join(
        "(" + ", ".join(_lit(x) for x in row) + ")" for row in INTERVALS) + \
    ") AS t(ord, category, name, start_date, end_date, severity))"
