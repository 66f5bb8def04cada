"""Baseline predictions on ``events`` (M2, M3/J10, M29/J15) used by the
error-analysis queries, with the identical DuckDB CTE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratecast.operators import aggregates as A
from ratecast.operators import joins as J
from ratecast.operators import windows as W
from ratecast.plans.tables import EVENTS_SQL, events

MODELS = {"global": "pred_global", "slot": "pred_slot", "user": "pred_user", "weekday": "pred_weekday"}
SLOT_LEVELS = [["event_type", "dow", "h"], ["dow", "h"]]
ID_COLS = ["event_id", "user_id", "event_type", "d", "h", "dow", "actual"]


def split_events(spark: SparkSession, sf: str) -> DataFrame:
    return W.split_by_date(events(spark, sf), "ts", 0.2)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Wide table: one row per test event with four baseline predictions."""
    ev = split_events(spark, sf)
    train = ev.where(F.col("split") == "train")
    test = ev.where(F.col("split") == "test")
    g = train.agg(F.avg("value")).scalar()
    p = test.withColumn("pred_global", g)
    p = J.cascade_mean(train, p, SLOT_LEVELS, "value", out="pred_slot")
    p = J.cascade_mean(train, p, [["user_id"]], "value", out="pred_user")
    p = J.recent_weekday_mean(train, p, "d", "value", weeks=8, out="pred_weekday")
    return p.select(*ID_COLS[:-1], F.col("value").alias("actual"), *MODELS.values())


def predictions_long(spark: SparkSession, sf: str) -> DataFrame:
    return A.to_long(predictions(spark, sf), ID_COLS, MODELS)


PRED_CTE = f"""ev AS {EVENTS_SQL},
cutrow AS (SELECT d AS cut FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM ev)
           WHERE i = CAST(round_even((SELECT count(*) - 1 FROM ev) * 0.8, 0) AS BIGINT)),
tr AS (SELECT * FROM ev WHERE d < (SELECT cut FROM cutrow)),
te AS (SELECT * FROM ev WHERE d >= (SELECT cut FROM cutrow)),
gm AS (SELECT avg(value) AS gm FROM tr),
l1 AS (SELECT event_type, dow, h, avg(value) AS m1 FROM tr GROUP BY event_type, dow, h),
l2 AS (SELECT dow, h, avg(value) AS m2 FROM tr GROUP BY dow, h),
um AS (SELECT user_id, avg(value) AS mu FROM tr GROUP BY user_id),
rw AS (SELECT * FROM tr WHERE d >= (SELECT max(d) FROM tr) - 56),
wk AS (SELECT dow AS wdow, avg(value) AS mw FROM rw GROUP BY dow),
pred AS (SELECT te.event_id, te.user_id, te.event_type, te.d, te.h, te.dow, te.value AS actual,
        (SELECT gm FROM gm) AS pred_global,
        coalesce(l1.m1, l2.m2, (SELECT gm FROM gm)) AS pred_slot,
        coalesce(um.mu, (SELECT gm FROM gm)) AS pred_user,
        coalesce(wk.mw, (SELECT gm FROM gm)) AS pred_weekday
   FROM te LEFT JOIN l1 USING (event_type, dow, h) LEFT JOIN l2 USING (dow, h)
   LEFT JOIN um USING (user_id) LEFT JOIN wk ON wk.wdow = te.dow),
plong AS (""" + " UNION ALL ".join(
    f"SELECT event_id, user_id, event_type, d, h, dow, actual, '{m}' AS model, {c} AS pred FROM pred"
    for m, c in MODELS.items()) + ")"
