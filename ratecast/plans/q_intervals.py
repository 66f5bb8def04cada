"""Interval-join queries (J4-J9) of ``events`` against the fixed calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratecast.operators import intervals as I
from ratecast.plans.registry import query, measure
from ratecast.plans.tables import EVENTS_SQL, INTERVALS_SQL, SEC_CATS, events, intervals

EV, IV = EVENTS_SQL, INTERVALS_SQL
_ACTIVE = "i.end_date IS NOT NULL AND e.d BETWEEN i.start_date AND i.end_date"


def _last_sql(cat):
    return (f"coalesce((SELECT arg_max(i.name, i.ord) FROM {IV} i WHERE i.category = '{cat}' AND {_ACTIVE}), '—')")


_SEC_LIST = "(" + ", ".join(f"'{c}'" for c in SEC_CATS) + ")"
_CONCAT_SQL = (f"coalesce((SELECT string_agg(i.name, ' + ' ORDER BY i.ord) FROM {IV} i "
               f"WHERE i.category IN {_SEC_LIST} AND {_ACTIVE}), '—')")


@query("interval_tag_last", f"SELECT e.event_id, {_last_sql('season')} AS tag_season, "
                            f"{_last_sql('holiday')} AS tag_holiday FROM {EV} e")
def q_interval_tag_last(spark, sf):
    ev = events(spark, sf).select("event_id", "d")
    iv = intervals(spark)
    r = I.interval_tag(ev, iv, "d", out="tag_season", mode="last", cats=["season"])
    r = I.interval_tag(r, iv, "d", out="tag_holiday", mode="last", cats=["holiday"])
    return r.select("event_id", "tag_season", "tag_holiday")


@query("interval_tag_concat", f"""
SELECT event_id, tag_season, tag_holiday, tag_security, tag_holiday <> '—' AS is_holiday,
       tag_security <> '—' AS is_security,
       CASE WHEN tag_security <> '—' THEN tag_security WHEN tag_holiday <> '—' THEN tag_holiday ELSE '—' END AS special_event
FROM (SELECT e.event_id, {_last_sql('season')} AS tag_season, {_last_sql('holiday')} AS tag_holiday,
             {_CONCAT_SQL} AS tag_security FROM {EV} e)""")
def q_interval_tag_concat(spark, sf):
    ev = events(spark, sf).select("event_id", "d")
    r = I.tag_events(ev, intervals(spark), "d", season=["season"], holiday=["holiday"], security=SEC_CATS)
    return r.select("event_id", "tag_season", "tag_holiday", "tag_security", "is_holiday", "is_security",
                    "special_event")


@query("interval_max", f"SELECT e.event_id, CAST(coalesce((SELECT max(i.severity) FROM {IV} i WHERE "
                       f"i.category IN {_SEC_LIST} AND {_ACTIVE}), 0) AS BIGINT) AS severity_max FROM {EV} e")
def q_interval_max(spark, sf):
    ev = events(spark, sf).select("event_id", "d")
    r = I.interval_max(ev, intervals(spark), "d", out="severity_max", cats=SEC_CATS)
    return r.select("event_id", F.col("severity_max").cast("bigint"))


_LATEST = (f"LEFT JOIN LATERAL (SELECT i.start_date, i.severity FROM {IV} i WHERE i.category = 'security' "
           f"AND {_ACTIVE} ORDER BY i.start_date DESC, i.ord DESC LIMIT 1) la ON true")


@query("asof_event", f"SELECT e.event_id, CAST(datediff('day', la.start_date, e.d) AS BIGINT) AS days_since_start, "
                     f"CAST(coalesce(la.severity, 0) AS BIGINT) AS event_severity FROM {EV} e {_LATEST}")
def q_asof_event(spark, sf):
    ev = events(spark, sf).select("event_id", "d")
    r = I.latest_active(ev, intervals(spark), "d", cats=["security"])
    return r.select("event_id", F.col("days_since_start").cast("bigint"), F.col("event_severity").cast("bigint"))


@query("range_self_count", f"""
SELECT e.event_id, CAST(CASE WHEN la.start_date IS NULL THEN 0 ELSE
  (SELECT count(*) FROM {EV} e2 WHERE e2.user_id = e.user_id AND e2.d BETWEEN la.start_date AND e.d) END AS BIGINT)
  AS n_since_start
FROM {EV} e {_LATEST}""")
def q_range_self_count(spark, sf):
    ev = events(spark, sf).select("event_id", "user_id", "d")
    la = I.latest_active(ev, intervals(spark), "d", cats=["security"])
    r = I.count_since_start(la, ["user_id"], "d", "event_start", out="n_since_start")
    return r.select("event_id", "n_since_start")


@query("per_interval", f"""
SELECT i.name, i.start_date, i.end_date, CAST(count(*) AS BIGINT) AS n, (avg(e.value)) AS mean_value,
       (avg(e.k)) AS mean_k
FROM {IV} i JOIN {EV} e ON {_ACTIVE}
WHERE i.category IN {_SEC_LIST} GROUP BY i.name, i.start_date, i.end_date""")
def q_per_interval(spark, sf):
    r = I.per_interval(events(spark, sf), intervals(spark), "d", ["value", "k"], cats=SEC_CATS)
    return r.select("name", "start_date", "end_date", F.col("n").cast("bigint"),
                    measure("mean_value").alias("mean_value"), measure("mean_k").alias("mean_k"))


@query("flagship", f"""
SELECT e.event_id, e.user_id, {_last_sql('season')} AS tag_season,
  CASE WHEN {_CONCAT_SQL} <> '—' THEN {_CONCAT_SQL} WHEN {_last_sql('holiday')} <> '—' THEN {_last_sql('holiday')}
       ELSE '—' END AS special_event,
  CAST(count(*) OVER w AS BIGINT) AS lag_n,
  (CASE WHEN e.value IS NOT NULL AND count(*) OVER w > 0 THEN coalesce(sum(e.value) OVER w, 0) / count(*) OVER w END)
    AS lag_mean
FROM {EV} e
WINDOW w AS (PARTITION BY e.user_id ORDER BY e.ts, e.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def q_flagship(spark, sf):
    """Ingest slice: interval tags (J4/J5/T18) + per-user expanding mean."""
    from ratecast.operators import windows as W
    from ratecast.plans.tables import EV_ORDER
    ev = events(spark, sf)
    t = I.tag_events(ev, intervals(spark), "d", season=["season"], holiday=["holiday"], security=SEC_CATS)
    r = W.expanding_mean(t, ["user_id"], "value", EV_ORDER, out="lag_mean", out_n="lag_n")
    return r.select("event_id", "user_id", "tag_season", "special_event", F.col("lag_n").cast("bigint"),
                    measure("lag_mean").alias("lag_mean"))
