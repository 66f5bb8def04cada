"""Scored requests and questions (M30, M31) with the slot-mean cascade as
the model, which SQL can follow to the last answer field.  Orders stand for
the series (customer, priority and start hour as program, status and slot),
27 years on, so that targets cross the reception ramp and the calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratecast.functions import scalars as S
from ratecast.functions import text as X
from ratecast.operators import joins as J
from ratecast.operators import scoring as SC
from ratecast.plans.q_functions import _any_sql, _text_date_sql
from ratecast.plans.registry import query
from ratecast.plans.tables import INTERVALS_SQL, SEC_CATS, intervals, table

SHIFT, CALENDAR_SHIFT = 324, 20     # months
HISTORY_END, TODAY = "2025-07-01", "2025-08-31"
PROGRAM = "קבינט שישי"
SLOTS = [["program", "dow", "h"], ["dow", "h"]]
# endings that questions get in turn, so that dates, programs and scenarios occur
PHRASES = ["", " מה הצפי לקבינט מחר", " קבינט ביום שישי", " קבינט 12/09/25 מבצע", " מחר", " קבינט", " שישי הבא אירוע", " קבינט שבוע מלחמה", " קבינט ראשון הבא ושני"]


def _series(spark, sf):
    o = table(spark, sf, "orders")
    o = o.select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("series"), F.col("o_totalprice").alias("cents"),
                 F.when(F.col("o_orderpriority") == "1-URGENT", PROGRAM).otherwise(F.col("o_orderpriority")).alias("program"),
                 F.add_months(F.to_date("o_orderdate"), SHIFT).alias("d"), F.pmod("o_orderkey", F.lit(24)).alias("h"))
    return (o.withColumn("value", F.col("cents") / 10000).withColumn("dow", F.dayofweek("d").cast("bigint")).drop("cents")
            .withColumn("start", F.concat(F.lpad(F.col("h").cast("string"), 2, "0"), F.lit(":50")))
            .withColumn("end", F.when(F.pmod("request_id", F.lit(5)) != 0, F.concat(
                F.lpad(F.pmod(F.col("request_id") * 7, F.lit(24)).cast("string"), 2, "0"), F.lit(":00"))))
            .withColumn("scenario", F.when(F.pmod("request_id", F.lit(3)) == 0, SC.SPECIAL).otherwise(SC.ROUTINE)))


def _calendar(spark):
    return (intervals(spark).withColumn("start_date", F.add_months("start_date", CALENDAR_SHIFT))
            .withColumn("end_date", F.add_months("end_date", CALENDAR_SHIFT)))


_SERIES_SQL = f"""so AS (SELECT o_orderkey AS request_id, o_custkey AS series, CASE WHEN o_orderpriority = '1-URGENT' THEN '{PROGRAM}' ELSE o_orderpriority END AS program,
    CAST(CAST(o_orderdate AS DATE) + INTERVAL {SHIFT} MONTH AS DATE) AS d, o_orderkey % 24 AS h, o_totalprice / 10000 AS value FROM orders),
al AS (SELECT *, CAST(dayofweek(d) + 1 AS BIGINT) AS dow FROM so),
hist AS (SELECT * FROM al WHERE d < DATE '{HISTORY_END}'),
cal AS (SELECT CAST(start_date + INTERVAL {CALENDAR_SHIFT} MONTH AS DATE) AS s, CAST(end_date + INTERVAL {CALENDAR_SHIFT} MONTH AS DATE) AS e
    FROM {INTERVALS_SQL} WHERE category IN ({', '.join(f"'{c}'" for c in SEC_CATS)}))"""


def _answers_sql(entity, fine):
    """CTE ``ans`` over ``rq`` (request_id, series, program, target, dow, h, scenario, duration)."""
    def trend(name, key):
        return f"""{name}m AS (SELECT {key} AS e, date_trunc('month', d) AS m, avg(value) AS mv FROM hist GROUP BY ALL),
{name}r AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY m DESC) AS r FROM {name}m),
{name}i AS (SELECT e, mv, CAST(row_number() OVER (PARTITION BY e ORDER BY m) - 1 AS DOUBLE) AS i FROM {name}r WHERE r <= 7),
{name} AS (SELECT e, CASE WHEN count(*) < 3 OR avg(mv) <= 0 THEN 0.0 ELSE greatest(least(regr_slope(mv, i) / avg(mv), 0.05), -0.05) END AS tr FROM {name}i GROUP BY e)"""
    fk = " AND ".join(f"f.{c} = rq.{c}" for c in fine)
    return f"""{trend('te', entity)}, {trend('tg', '1')},
sz AS (SELECT {entity} AS e, count(*) AS n FROM hist GROUP BY ALL),
l1 AS (SELECT program, dow, h, avg(value) AS m1, count(value) AS cn, stddev_samp(value) AS cs FROM hist GROUP BY ALL),
l2 AS (SELECT dow, h, avg(value) AS m2 FROM hist GROUP BY ALL),
f AS (SELECT {', '.join(fine)}, count(value) AS fn, stddev_samp(value) AS fs FROM hist GROUP BY ALL),
j AS (SELECT rq.*, coalesce(m1, m2, (SELECT avg(value) FROM hist)) AS raw, CASE WHEN coalesce(sz.n, 0) < 5 THEN (SELECT tr FROM tg) ELSE te.tr END AS tr,
    CAST(datediff('day', (SELECT max(d) FROM hist), target) AS BIGINT) AS days_ahead, CAST(coalesce(sz.n, 0) AS BIGINT) AS n_hist,
    round(CASE WHEN coalesce(fn, 0) >= 5 THEN fs WHEN coalesce(cn, 0) >= 10 THEN cs ELSE 0.263 END * 1.28, 3) AS half,
    CAST(CASE WHEN coalesce(fn, 0) >= 5 THEN fn WHEN coalesce(cn, 0) >= 10 THEN cn ELSE 0 END AS BIGINT) AS n_used,
    CASE WHEN coalesce(fn, 0) >= 5 THEN 'entity_slot' WHEN coalesce(cn, 0) >= 10 THEN 'slot' ELSE 'default' END AS unc_source,
    CASE WHEN target <= DATE '{S.RECEPTION_START}' THEN 0.65
      ELSE round(least(0.65 + 0.25 * datediff('day', DATE '{S.RECEPTION_START}', target) / 364, 0.95), 3) END AS rec,
    scenario = 'special_event' AND EXISTS (SELECT 1 FROM cal WHERE s <= target AND e >= target) AS active
  FROM rq LEFT JOIN te ON te.e = rq.{entity} LEFT JOIN sz ON sz.e = rq.{entity} LEFT JOIN l1 ON l1.program = rq.program AND l1.dow = rq.dow AND l1.h = rq.h
  LEFT JOIN l2 ON l2.dow = rq.dow AND l2.h = rq.h LEFT JOIN f ON {fk}),
k AS (SELECT *, greatest(CASE WHEN days_ahead > 0 THEN raw * pow(1 + tr, least(days_ahead / 30.0, 6.0)) ELSE raw END, 0.0) AS predicted FROM j),
ans AS (SELECT *, greatest(predicted - half, 0.0) AS low, predicted + half AS high, predicted * rec AS predicted_raw, CAST(rec AS DOUBLE) AS reception_used,
    CAST(round_even(predicted * rec * {S.HH_PER_POINT}, 0) AS BIGINT) AS households,
    CAST(round_even(round_even(predicted * rec * {S.HH_PER_POINT}, 0) * CAST({S.VIEWERS_PER_HH} AS DOUBLE), 0) AS BIGINT) AS viewers,
    CASE WHEN n_hist >= 20 THEN 'high' WHEN n_hist >= 5 THEN 'medium' ELSE 'cold_start' END AS reliability, n_hist < 5 AS cold_start,
    CASE WHEN active THEN 'special_event' ELSE 'routine' END AS scenario_effective FROM k)"""


def _slot_answers(spark, history, requests, entity, fine):
    r = SC.effective_scenario(requests, _calendar(spark), "target", "scenario", SEC_CATS)
    r = J.cascade_mean(history, r, SLOTS, "value", out="raw_pred")
    return SC.answer_fields(r, history, entity=entity, date="d", value="value", target="target", fine=fine, coarse=["program", "dow", "h"])


@query("score_requests_slot", f"""WITH {_SERIES_SQL},
rq AS (SELECT request_id, series, program, d AS target, dow, h, CASE WHEN request_id % 3 = 0 THEN 'special_event' ELSE 'routine' END AS scenario,
    CAST(CASE WHEN request_id % 5 = 0 THEN 130 ELSE ((request_id * 7 % 24) * 60 - (h * 60 + 50) + 1440) % 1440 END AS BIGINT) AS duration FROM al WHERE d >= DATE '{HISTORY_END}'),
{_answers_sql('series', ['series', 'dow'])}
SELECT request_id, duration, scenario_effective, {', '.join(SC.ANSWER)} FROM ans""")
def q_score_requests_slot(spark, sf):
    """M30 over a request table with start, end and scenario."""
    s = _series(spark, sf)
    req = s.where(F.col("d") >= F.lit(HISTORY_END).cast("date")).withColumnRenamed("d", "target").drop("value")
    req = req.withColumn("duration", S.duration_wrap("start", "end").cast("bigint"))
    a = _slot_answers(spark, s.where(F.col("d") < F.lit(HISTORY_END).cast("date")), req, "series", ["series", "dow"])
    return a.select("request_id", "duration", "scenario_effective", *SC.ANSWER)


_Q = "CASE CAST((conv_id + turn) % " + str(len(PHRASES)) + " AS INTEGER) " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES)) + " END"


@query("answers_scored", f"""WITH {_SERIES_SQL},
qs AS (SELECT conv_id, turn, coalesce(text, '') || {_Q} AS q FROM conversations WHERE role = 'user'),
pq AS (SELECT conv_id, turn, CASE WHEN {_any_sql('q', X.PROGRAM_WORDS)} THEN '{PROGRAM}' END AS program,
    coalesce(CAST({_text_date_sql('trim(q)', TODAY)} AS DATE), DATE '{TODAY}' + 7) AS target,
    CASE WHEN {_any_sql('q', X.SCENARIO_WORDS)} THEN 'special_event' ELSE 'routine' END AS scenario,
    CASE WHEN {_any_sql('q', X.PROGRAM_WORDS)} AND {_any_sql('q', [X.WORD_TOMORROW, X.WORD_TODAY, X.WORD_WEEK, *S.WEEKDAYS_HE])} THEN 'high'
         WHEN {_any_sql('q', X.PROGRAM_WORDS)} THEN 'medium' ELSE 'low' END AS confidence FROM qs),
rq AS (SELECT *, CAST(dayofweek(target) + 1 AS BIGINT) AS dow, CAST(19 AS BIGINT) AS h FROM pq WHERE program IS NOT NULL),
{_answers_sql('program', ['program', 'dow', 'h'])}
SELECT pq.conv_id, pq.turn, pq.program, pq.target, pq.scenario, pq.confidence, scenario_effective, {', '.join(c for c in SC.ANSWER if c != 'cold_start')}
FROM pq LEFT JOIN ans ON ans.conv_id = pq.conv_id AND ans.turn = pq.turn""")
def q_answers_scored(spark, sf):
    """M31 end to end: question -> request (19:50 to 22:00) -> answer fields;
    a question without a program keeps its parsed fields and gets no answer."""
    c = table(spark, sf, "conversations").where(F.col("role") == "user")
    ending = F.element_at(F.array(*map(F.lit, PHRASES)), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(PHRASES))) + 1).cast("int"))
    c = c.select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), ending).alias("q"))
    p = SC.parse_questions(c, "q", TODAY).drop("q")
    req = p.where(F.col("program").isNotNull()).withColumn("dow", F.dayofweek("target").cast("bigint")).withColumn("h", F.lit(19).cast("bigint"))
    hist = _series(spark, sf).where(F.col("d") < F.lit(HISTORY_END).cast("date"))
    a = _slot_answers(spark, hist, req, "program", ["program", "dow", "h"]).select("conv_id", "turn", "scenario_effective", *SC.ANSWER)
    return p.join(a, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "program", "target", "scenario", "confidence", "scenario_effective", *[c for c in SC.ANSWER if c != "cold_start"])
